"""Prompt texts by name, and their rendering."""

from __future__ import annotations

PROMPTS = {
    "regex-discovery": "These are sample pages of a document. Give the regular expressions that match its section headings, each with one group for the title, as a JSON array of {regex, level, description}.\n\n{{sample_pages_text}}",
    "toc-detection": "Does this page hold a table of contents? Answer as JSON {toc_detected: yes or no}.\n\n{{page_text}}",
    "toc-extraction": "Copy the table of contents out of this text, complete and unchanged.\n\n{{toc_text}}",
    "toc-completeness-check": "Is the second text a complete copy of the table of contents in the first? Answer as JSON {completed: yes or no}.\n\n{{raw_toc_text}}\n\n{{extracted_toc_text}}",
    "toc-transform": "Turn this table of contents into JSON {table_of_contents: [{structure, title, page}]}; page is null where none is printed.\n\n{{toc_text}}",
    "page-index-detection": "Are page numbers printed in this table of contents? Answer as JSON {page_index_given_in_toc: yes or no}.\n\n{{toc_content}}",
    "toc-page-matching": "The pages below carry tags <physical_index_N>. For each entry of this outline that starts on one of them, fill in physical_index with its tag; keep the others. Reply with a JSON array of {structure, title, physical_index}.\n\n{{structure_json}}\n\n{{pages_text}}",
    "structure-detection-init": "The pages below carry tags <physical_index_N>. Give their section outline as a JSON array of {structure, title, physical_index}.\n\n{{tagged_pages_text}}",
    "structure-detection-continue": "Continue this outline with the tagged pages that follow, in the same JSON form.\n\n{{previous_json}}\n\n{{tagged_pages_text}}",
    "structure-detection-merge": "Merge these two outlines: every (title, physical_index) once, by page, the first one's entries first.\n\n{{partial_json_a}}\n\n{{partial_json_b}}",
    "verification": "Does a section called {{title}} start on this page? Answer as JSON {thinking, answer: yes or no}.\n\n{{page_text}}",
    "fix": "On which of these tagged pages does a section called {{title}} start? Answer as JSON {thinking, physical_index}.\n\n{{pages_text}}",
    "summary": "Summarise each section. Reply with a list of {node_id, summary}.\n\n{{sections}}",
    "rollup-summary": "Summarise each section from the summaries of its parts. Reply with a list of {node_id, summary}.\n\n{{sections}}",
    "node-selection": "Choose at most {{max_nodes}} sections of this outline that answer the question.\n\n{{tree}}",
    "answer-generation": "Answer from these sections of the document.\n\n{{sections_text}}",
}


def render(name: str, **values: str) -> str:
    """The prompt with {{key}} replaced in the order given; unknown placeholders stay."""
    if name not in PROMPTS:
        raise KeyError(f"no prompt is called {name}")
    text = PROMPTS[name]
    for key, value in values.items():
        text = text.replace("{{" + key + "}}", str(value))
    return text
