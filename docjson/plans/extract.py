"""The extraction fold: chunks in order, and for each a loop of planning and tool calls on the growing document.

A planner is a function of the messages so far to tool calls. Documents are independent rows; within a document every chunk
sees what the ones before it left, so the fold is sequential and runs inside one Arrow pass over whole rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docjson.functions.schema import Schema
from docjson.functions.truncate import truncate
from docjson.operators.chunking import Embedding, split_with_fallback
from docjson.operators.messages import SUMMARY, USAGE
from docjson.operators.patch import write
from docjson.operators.read import inspect_keys, read_value, search_pointer
from docjson.settings import Settings

GUIDANCE = ("last_path", "sections_snapshot", "items_added", "open_section", "text_excerpt", "next_expectations", "pending_data")


@dataclass
class Message:
    role: str
    content: str = ""
    tool_calls: list[dict] = field(default_factory=list)
    tool_call_id: str | None = None
    usage: dict[str, int] | None = None


class Planner(Protocol):
    """``plan(messages)`` answers with a message of role ``ai``; equal messages must give equal answers."""

    def plan(self, messages: list[Message]) -> Message: ...


@dataclass
class ScriptedPlanner:
    """Answers from a list, one for each call; an entry is a list of ``{name, args}`` calls or an exception to raise."""

    script: list[Any]
    at: int = 0

    def plan(self, messages: list[Message]) -> Message:
        step = self.script[self.at] if self.at < len(self.script) else []
        self.at += 1
        if isinstance(step, Exception):
            raise step
        calls = [{"id": f"c{self.at}-{i}", **c} for i, c in enumerate(step)]
        return Message("ai", tool_calls=calls, usage={"input_tokens": sum(len(m.content) for m in messages), "output_tokens": len(json.dumps(step)), "total_tokens": 0})


_CHUNK = re.compile(r'<TextChunk index="(\d+)" total="(\d+)">\n(.*)\n</TextChunk>', re.DOTALL)


@dataclass
class RulePlanner:
    """Patterns instead of a model: every match becomes an item of the array of its name.

    With a schema, arrays are not made on the way; told that one is missing, the planner makes it and tries once more.
    """

    rules: dict[str, str] = field(default_factory=lambda: {"emails": r"[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+", "addresses": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"})

    def plan(self, messages: list[Message]) -> Message:
        usage = {"input_tokens": sum(len(m.content) for m in messages), "output_tokens": 1, "total_tokens": sum(len(m.content) for m in messages) + 1}
        found = next(m for m in (_CHUNK.search(x.content) for x in messages if x.role == "human") if m)
        ops = [{"op": "add", "path": f"/{name}/-", "value": v} for name, pattern in self.rules.items() for v in re.findall(pattern, found[3])]
        n, rounds = len(ops), sum(m.role == "ai" for m in messages)
        if rounds == 1 and messages[-1].role == "tool" and "parent path does not exist" in messages[-1].content:
            lost = [name for name in self.rules if f'"pointer": "/{name}/-"' in messages[-1].content]
            ops = [{"op": "add", "path": f"/{name}", "value": []} for name in lost] + ops
        elif rounds:
            ops = []
        if not ops:
            args = {"items_added": str(n), "text_excerpt": found[3][-150:], "extracted_entities_count": n}
            return Message("ai", tool_calls=[{"id": f"g{found[1]}", "name": "update_guidance", "args": args}], usage=usage)
        return Message("ai", tool_calls=[{"id": f"p{found[1]}", "name": "apply_patches", "args": {"patches": ops}}], usage=usage)


def update_guidance(**given: Any) -> dict[str, Any]:
    """The record that one chunk leaves for the next."""
    return {"finalized": True, "guidance": {**{k: given.get(k, "") for k in GUIDANCE}, "extracted_entities_count": given.get("extracted_entities_count", 0)}}


def latest_guidance(chunks: DataFrame) -> DataFrame:
    """``doc_id, guidance``: what the last chunk of each document leaves, of ``chunks(doc_id, chunk_idx, args)``.

    ``args`` is the JSON text of the call; the last one of each document is picked by a partial aggregation, and only it
    becomes a record. Null, and what is no object, is a call without arguments.
    """

    def record(values: pd.Series) -> pd.Series:
        return values.map(lambda t: json.dumps(update_guidance(**_object(t))["guidance"], ensure_ascii=False))

    last = chunks.groupBy("doc_id").agg(F.max_by(F.struct("args"), "chunk_idx")["args"].alias("args"))
    return last.select("doc_id", F.pandas_udf(record, "string")("args").alias("guidance"))


def _object(text: str | None) -> dict[str, Any]:
    try:
        x = json.loads(text) if text else {}
    except (ValueError, RecursionError):
        return {}
    return x if isinstance(x, dict) else {}


def add_usage(current: dict | None, new: dict | None) -> dict:
    """Counters summed field by field; nothing plus nothing is nothing."""
    if not new:
        return current or {}
    return {k: (current or {}).get(k, 0) + new.get(k, 0) for k in USAGE}


def usage_of(*answers: Message) -> dict[str, int]:
    told = [m.usage for m in answers if m.usage]
    return {k: len(told) if k == "llm_calls" else sum(u.get(k, 0) for u in told) for k in USAGE}


def add_messages(current: list[Message], new: list[Message]) -> list[Message]:
    """New messages after the old ones, or instead of them if they begin with a system message."""
    return new if new and new[0].role == "system" else [*current, *new]


def trim_messages(messages: list[Message], keep: int = 2) -> list[Message] | None:
    """System messages, the first human one, a summary and the last ``keep`` rounds; None with no more rounds than that."""
    starts = [i for i, m in enumerate(messages) if m.role == "ai"]
    if len(starts) <= keep:
        return None
    head = messages[: starts[0]]
    first = next((m for m in head if m.role == "human"), None)
    stay = [m for m in head if m.role == "system" or m is first]
    note = Message("human", SUMMARY.format(len(starts) - keep))
    return [*stay, note, *(messages[starts[-keep] :] if keep else [])]


def system_prompt(schema: dict | None, guidance: dict | None, document: dict | None, s: Settings) -> str:
    """What the planner is told: its task, the schema in full, and guidance and document within their budgets."""
    rule = "Follow the TargetSchema." if schema is not None else "Infer a natural structure from the content."
    parts = {
        "TargetSchema": json.dumps(schema, indent=2) if schema else "null",
        "PreviousGuidance": truncate(guidance, s.truncate_guidance_limit, s.limits) if guidance else "null",
        "JsonSkeleton": truncate(document, s.truncate_skeleton_limit, s.limits) if document else "{}",
    }
    context = "\n".join(f"<{k}>\n{v}\n</{k}>" for k, v in parts.items())
    return f'<SystemPrompt>\nExtract the data of the TextChunk into the JSON Document by tool calls. {rule}\nAppend to arrays with "/-" and never overwrite them. End the chunk with update_guidance, alone.\n{context}\n</SystemPrompt>'


def user_message(chunk: str, i: int, total: int) -> str:
    return f'<TextChunk index="{i + 1}" total="{total}">\n{chunk}\n</TextChunk>'


@dataclass
class Run:
    """One document under extraction."""

    planner: Planner
    schema: dict | None = None
    settings: Settings = field(default_factory=Settings)
    document: Any = field(default_factory=dict)
    guidance: dict = field(default_factory=dict)
    usage: dict = field(default_factory=dict)
    error: str | None = None
    #: Is told of each step, as it is done.
    on_step: Callable[[dict], None] | None = None

    def __post_init__(self) -> None:
        self._compiled = Schema(self.schema) if self.schema is not None else None
        self._at = {"chunk_idx": 0, "total": 0, "attempt": 0, "iteration": 0}
        self._told: dict = {}

    def _step(self, node: str, tools: list[str] | None = None, **at: int) -> None:
        self._at |= at
        if self.on_step is not None:
            spent = {k: v - self._told.get(k, 0) for k, v in self.usage.items()}
            self._told = dict(self.usage)
            self.on_step({"node": node, **self._at, "tools": tools or [], "usage": {k: v for k, v in spent.items() if v}})

    def tool(self, name: str, args: dict) -> dict[str, Any]:
        """One tool call on the document; a write or a guidance takes effect at once."""
        readers: dict[str, Callable[[Any], dict]] = {
            "inspect_keys": lambda d: inspect_keys(d, args.get("path", "")),
            "search_pointer": lambda d: search_pointer(d, {"type": "value", "fuzzy_match": False, "limit": 20, "max_value_length": 120, **args}),
            "read_value": lambda d: read_value(d, {"path": "", **args}),
        }
        if name in readers:
            if args.get("source", "document") != "schema":
                return readers[name](self.document)
            if self.schema is None:
                raise ValueError("No target schema available. Use source='document' instead.")
            return readers[name](self.schema)
        if name == "apply_patches":
            result = write(self.document, args.get("patches"), self._compiled)
            self.document = result["finalDoc"]
            return result
        if name == "update_guidance":
            made = update_guidance(**args)
            self.guidance = made["guidance"]
            return made
        return {"error": f"Unknown tool: {name}"}

    def _ask(self, messages: list[Message]) -> list[Message]:
        """An answer; once more with trimmed messages if it fails or calls no tool."""
        try:
            answer = self.planner.plan(messages)
        except Exception:
            shorter = trim_messages(messages, self.settings.keep_rounds)
            if shorter is None:
                raise
            answer = self.planner.plan(shorter)
            self.usage = add_usage(self.usage, usage_of(answer))
            return [*shorter, answer]
        if not answer.tool_calls and (shorter := trim_messages(messages, self.settings.keep_rounds)) is not None:
            again = self.planner.plan(shorter)
            self.usage = add_usage(self.usage, usage_of(answer, again))
            return [*shorter, again]
        self.usage = add_usage(self.usage, usage_of(answer))
        return [answer]

    def _act(self, calls: list[dict]) -> tuple[list[Message], bool]:
        out, done = [], False
        for c in calls:
            try:
                result = self.tool(c["name"], c["args"])
                done |= c["name"] == "update_guidance"
            except (ValueError, KeyError, TypeError, RuntimeError) as e:
                result = {"error": f"Tool execution error: {e}"}
            shown = {k: v for k, v in result.items() if k != "finalDoc"}
            text = truncate(shown, self.settings.truncate_read_value_limit, self.settings.limits) if c["name"] == "read_value" else json.dumps(shown, ensure_ascii=False, default=str)
            out.append(Message("tool", text, tool_call_id=c["id"]))
        return out, done

    def chunk(self, text: str, i: int, total: int) -> None:
        """One chunk: up to ``max_iterations_per_chunk`` rounds, and as many retries of them as the settings allow."""
        for attempt in range(self.settings.max_chunk_retries + 1):
            human = user_message(text, i, total)
            if attempt:
                human += f"\n\n⚠️ RETRY ATTEMPT {attempt}/{self.settings.max_chunk_retries}: extract what remains and finalize this chunk with update_guidance."
            messages = [Message("system", system_prompt(self.schema, self.guidance, self.document, self.settings)), Message("human", human)]
            self._step("prepare_chunk", chunk_idx=i, total=total, attempt=attempt, iteration=0)
            for iteration in range(1, self.settings.max_iterations_per_chunk + 1):
                messages = add_messages(messages, self._ask(messages))
                calls = messages[-1].tool_calls
                self._step("call_model", [c["name"] for c in calls], iteration=iteration)
                done = not calls  # an answer without a call ends the chunk
                if calls:
                    said, done = self._act(calls)
                    messages += said
                    self._step("execute_tools")
                if done:
                    self._step("finalize_chunk")
                    return

    def all(self, chunks: list[str]) -> dict[str, Any]:
        for i, c in enumerate(chunks):
            self.chunk(c, i, len(chunks))
        return self.result(len(chunks))

    def result(self, total: int) -> dict[str, Any]:
        return {"json_document": self.document, "metadata": {"total_chunks": total, "final_guidance": self.guidance, "token_usage": self.usage}, "error": self.error}


def extract(text: str, planner: Planner, schema: dict | None = None, settings: Settings | None = None, embed: Embedding | None = None, on_step: Callable[[dict], None] | None = None) -> dict[str, Any]:
    """Extraction of one text on the spot; with an embedding, from semantic chunks, if they can be made."""
    s = settings or Settings()
    run = Run(planner, schema, s, on_step=on_step)
    if not text:
        run.error = "No text provided for processing."
        return run.result(0)
    return run.all(split_with_fallback(text, embed, s.chunk_size, s.chunk_overlap) if text.strip() else [])


RESULT = "doc_id long, json string, total_chunks int, guidance string, token_usage map<string,long>, error string"


def extract_documents(docs: DataFrame, planner: Callable[[int], Planner] | None = None, schema: dict | None = None, settings: Settings | None = None, embed: Embedding | None = None) -> DataFrame:
    """``doc_id, json, total_chunks, guidance, token_usage, error`` for every row of ``docs(doc_id, text)``.

    ``planner`` makes a planner for a document's id. A document whose planner fails is a row with an error, never a failed
    job. Nothing is shuffled: a row's chunks are made and folded where the row is.
    """
    make, s = planner or (lambda _: RulePlanner()), settings or Settings()
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.int64()), pa.string()]
    names = [c.split()[0] for c in RESULT.split(", ")]

    def one(doc_id: int, text: str | None) -> tuple:
        try:
            r = extract(text or "", make(doc_id), schema, s, embed)
        except Exception as e:
            r = {"json_document": {}, "metadata": {"total_chunks": 0, "final_guidance": {}, "token_usage": {}}, "error": f"{type(e).__name__}: {e}"}
        m = r["metadata"]
        return doc_id, json.dumps(r["json_document"], ensure_ascii=False), m["total_chunks"], json.dumps(m["final_guidance"], ensure_ascii=False), list(m["token_usage"].items()), r["error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
