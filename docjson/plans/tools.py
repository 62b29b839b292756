"""The tools a model is offered, and a planner that asks one."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from docjson.plans.extract import Message

_SOURCE = {"type": "string", "enum": ["document", "schema"], "default": "document", "description": "Whether to look at the document or at its schema."}
_PATH = {"type": "string", "default": "", "description": "A JSON Pointer; the empty one is the root."}


def _tool(name: str, description: str, required: tuple[str, ...] = (), **properties: dict) -> dict[str, Any]:
    return {"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": properties, "required": list(required)}}}


def _text(description: str) -> dict[str, Any]:
    return {"type": "string", "default": "", "description": description}


def _count(default: int, description: str) -> dict[str, Any]:
    return {"type": "integer", "default": default, "description": description}


# The names of tools and arguments, and the arguments' defaults.
TOOLS: list[dict[str, Any]] = [
    _tool("inspect_keys", "The keys of an object, or the length of an array.", source=_SOURCE, path=_PATH),
    _tool(
        "search_pointer",
        "Pointers to the keys or values that match a query. Search before you append, so that nothing is there twice.",
        ("query",),
        source=_SOURCE,
        query={"type": "string", "description": "What to look for."},
        type={"type": "string", "enum": ["key", "value"], "default": "value", "description": "Whether keys or values are looked at."},
        fuzzy_match={"type": "boolean", "default": False, "description": "Whether near matches count."},
        limit=_count(20, "Most matches."),
        max_value_length=_count(120, "Most characters of a value shown."),
    ),
    _tool(
        "read_value",
        "The value at a pointer, cut to size.",
        ("path",),
        source=_SOURCE,
        path={"type": "string", "description": "A JSON Pointer."},
        max_string_length=_count(160, "Most characters of a string."),
        max_depth=_count(6, "Most levels."),
        max_array_items=_count(50, "Most items of an array."),
        max_object_keys=_count(50, "Most keys of an object."),
    ),
    _tool(
        "apply_patches",
        "JSON Patch operations on the document, all or none. A path that ends in /- is behind the last item of an array.",
        ("patches",),
        patches={"type": "array", "items": {"type": "object"}, "description": "Operations of the form {op, path, value or from}."},
    ),
    _tool(
        "update_guidance",
        "Ends the chunk, with what the next one has to know. The only call of its answer.",
        last_path=_text("The pointer written last."),
        sections_snapshot=_text("The sections there are."),
        items_added=_text("What this chunk added."),
        open_section=_text("What is not finished."),
        text_excerpt=_text("The end of the text."),
        next_expectations=_text("What comes next."),
        pending_data=_text("What has no place yet."),
        extracted_entities_count=_count(0, "Things found in this chunk."),
    ),
]

#: ``chat(messages, tools=..., tool_choice=..., temperature=...)`` answers with ``{"tool_calls": [...], "content": ..., "usage": {...}}``.
Chat = Callable[..., dict[str, Any]]


@dataclass
class ChatPlanner:
    """Asks a model through ``chat``, which has to call a tool, at temperature 0; clients stay outside this package.

    Arguments of a call may be an object or its JSON text; text that is no object is a call without arguments.
    """

    chat: Chat
    tools: list[dict[str, Any]] = field(default_factory=lambda: TOOLS)
    temperature: float = 0.0

    def plan(self, messages: list[Message]) -> Message:
        asked = [{"role": m.role, "content": m.content, **({"tool_calls": m.tool_calls} if m.tool_calls else {}), **({"tool_call_id": m.tool_call_id} if m.tool_call_id else {})} for m in messages]
        told = self.chat(asked, tools=self.tools, tool_choice="required", temperature=self.temperature)
        calls = [{"id": c.get("id") or f"call-{i}", "name": c.get("name", ""), "args": _arguments(c.get("args"))} for i, c in enumerate(told.get("tool_calls") or [])]
        return Message("ai", told.get("content") or "", calls, usage=told.get("usage"))


def _arguments(given: Any) -> dict[str, Any]:
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except ValueError:
            return {}
    return given if isinstance(given, dict) else {}
