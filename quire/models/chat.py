"""Chat models: the protocol, a scripted fake, an HTTP client, and the structured call with one correction."""

from __future__ import annotations

import json
import os
import urllib.request
from collections import defaultdict, deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from quire.errors import ChatParseFailed
from quire.functions.json_clean import read_strict

Message = tuple[str, str]  # role (system, user, assistant), content


class ChatModel(Protocol):
    def chat(self, messages: Sequence[Message], tags: Sequence[str] = ()) -> str: ...


@dataclass
class ScriptedModel:
    """Replies by tag, first in first out; the last of a tag stays; "{}" for a tag without replies."""

    replies: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        self.left = defaultdict(deque, {k: deque(v) for k, v in self.replies.items()})
        self.calls: list[tuple[tuple[Message, ...], tuple[str, ...]]] = []

    def chat(self, messages, tags=()):
        self.calls.append((tuple(messages), tuple(tags)))
        for tag in tags:
            if self.left[tag]:
                return self.left[tag].popleft() if len(self.left[tag]) > 1 else self.left[tag][0]
        return "{}"


@dataclass(frozen=True)
class RuleModel:
    """A deterministic stand-in: a function of the messages and tags."""

    rule: Callable[[Sequence[Message], Sequence[str]], str]

    def chat(self, messages, tags=()):
        return self.rule(messages, tags)


def joined_system(messages: Sequence[Message]) -> tuple[str, list[Message]]:
    """All system texts as one, and the other messages."""
    return "\n\n".join(c for r, c in messages if r == "system"), [m for m in messages if m[0] != "system"]


@dataclass(frozen=True)
class HttpModel:
    """A model behind an OpenAI- or Anthropic-style endpoint; no retry, errors are raised."""

    provider: str  # openai, anthropic or custom
    api_key: str
    model: str
    base_url: str
    temperature: float = 0.0
    max_tokens: int = 4096
    timeout: float = 120.0

    @classmethod
    def from_env(cls) -> HttpModel:
        provider = os.environ.get("LLM_PROVIDER", "openai").lower()
        key = os.environ.get("LLM_API_KEY") or os.environ.get("OPENAI_API_KEY") or os.environ.get("ANTHROPIC_API_KEY")
        if not key:
            raise ValueError("no API key is set")
        url = os.environ.get("LLM_BASE_URL") or {"anthropic": "https://api.anthropic.com/v1"}.get(provider, "https://api.openai.com/v1")
        return cls(provider, key, os.environ.get("LLM_MODEL", "gpt-4o"), url.rstrip("/"))

    def request(self, messages: Sequence[Message], structured: bool = False) -> tuple[str, dict, dict]:
        """Address, headers and body of a call."""
        if self.provider == "anthropic":
            system, rest = joined_system(messages)
            body = {"model": self.model, "max_tokens": self.max_tokens, "messages": [{"role": r, "content": c} for r, c in rest]}
            return f"{self.base_url}/messages", {"x-api-key": self.api_key, "anthropic-version": "2023-06-01"}, body | ({"system": system} if system else {})
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": r, "content": c} for r, c in messages]}
        if structured and self.provider == "openai":
            body["response_format"] = {"type": "json_object"}
        return f"{self.base_url}/chat/completions", {"Authorization": f"Bearer {self.api_key}"}, body

    def chat(self, messages, tags=()):
        url, headers, body = self.request(messages)
        call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
        with urllib.request.urlopen(call, timeout=self.timeout) as reply:
            got = json.load(reply)
        return got["content"][0]["text"] if self.provider == "anthropic" else got["choices"][0]["message"]["content"]


def structured(model: ChatModel, messages: Sequence[Message], hint: str, many: bool = False, tags: Sequence[str] = ()):
    """A reply as a dict, or a list of dicts; one correction is asked for, then ChatParseFailed."""
    shape = 'a JSON object {"items": [...]} whose items have' if many else "one JSON object with"
    asked = [("system", f"Reply with nothing but {shape} these fields: {hint}"), *messages]
    reply = model.chat(asked, tags)
    try:
        return read_strict(reply, many)
    except ValueError as broken:
        again = [*asked, ("assistant", reply), ("user", f"That could not be read ({broken}). Send the JSON alone, without any other text.")]
    try:
        return read_strict(model.chat(again, tags), many)
    except ValueError as broken:
        raise ChatParseFailed(str(broken)) from broken
