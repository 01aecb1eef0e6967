"""Errors of the single-document calls; batch calls carry the code in a column instead."""

from __future__ import annotations


class QuireError(Exception):
    status, code = 500, "ERROR"

    def __init__(self, message: str = ""):
        super().__init__(message or self.code)


class NoPages(QuireError):
    status, code = 400, "NO_PAGES_PROVIDED"


class DetectionFailed(QuireError):
    code = "STRUCTURE_DETECTION_FAILED"


class IndexNotFound(QuireError):
    status, code = 404, "INDEX_NOT_FOUND"


class SelectionParseFailed(QuireError):
    code = "NODE_SELECTION_PARSE_FAILED"


class ChatParseFailed(QuireError):
    code = "STRUCTURED_CHAT_PARSE_FAILED"
