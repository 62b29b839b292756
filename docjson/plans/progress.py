"""What an extraction does, step by step, and where it stands: events as rows, folded natively."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docjson.operators.chunking import Embedding
from docjson.operators.messages import USAGE
from docjson.plans.extract import Planner, RulePlanner, extract
from docjson.settings import Settings

EVENTS = "doc_id long, seq int, node string, chunk_idx int, total int, attempt int, iteration int, tools array<string>, usage map<string,long>, error string"
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.map_(pa.string(), pa.int64()), pa.string()]
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]


def extract_events(docs: DataFrame, planner: Callable[[int], Planner] | None = None, schema: dict | None = None, settings: Settings | None = None, embed: Embedding | None = None) -> DataFrame:
    """A row per step of each document's extraction, in order of ``seq``: its chunk, its attempt, its round, the tools it called and
    what the model's answers cost. An answer is counted once, also if the messages before it were trimmed.

    Steps are ``prepare_chunk``, ``call_model``, ``execute_tools``, ``finalize_chunk`` and ``failed``. A document without text has
    one step, ``failed``. Nothing is shuffled.
    """
    make, s = planner or (lambda _: RulePlanner()), settings or Settings()

    def steps(doc_id: int | None, text: str | None) -> list[tuple]:
        seen: list[dict] = []
        try:
            error = extract(text or "", make(doc_id), schema, s, embed, on_step=seen.append)["error"]
        except Exception as e:  # a planner can fail in any way
            error = f"{type(e).__name__}: {e}"
        last = seen[-1] if seen else {"chunk_idx": 0, "total": 0, "attempt": 0, "iteration": 0}
        if error:
            seen.append({**last, "node": "failed", "tools": [], "usage": {}, "error": error})
        return [(doc_id, i, e["node"], e["chunk_idx"], e["total"], e["attempt"], e["iteration"], e["tools"], list(e["usage"].items()), e.get("error")) for i, e in enumerate(seen)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in steps(i, t)]
            columns = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, EVENTS)


def shown_usage(usage: Column) -> Column:
    """Counters as they are shown: those of the cache only if they are not 0."""
    return F.map_filter(usage, lambda k, v: ~k.startswith("cache_") | (v != 0))


def progress(events: DataFrame) -> DataFrame:
    """Where each document stands: ``doc_id, node, chunk_idx, total, iteration, tools, usage, error``, from its events so far.

    ``tools`` counts the calls within the current chunk, ``usage`` sums over the whole document. One aggregation with
    partial sums: events are folded where they are.
    """
    now = F.max_by(F.struct("node", "chunk_idx", "total", "iteration", "error"), "seq")
    sums = [F.sum(F.coalesce(F.col("usage")[k], F.lit(0))).alias(k) for k in USAGE]
    by_chunk = events.groupBy("doc_id", "chunk_idx").agg(now.alias("now"), F.max("seq").alias("seq"), F.flatten(F.collect_list("tools")).alias("tools"), *sums)
    total = [F.sum(k).alias(k) for k in USAGE]
    last = by_chunk.groupBy("doc_id").agg(F.max_by("now", "seq").alias("now"), F.max_by("tools", "seq").alias("tools"), *total)
    names = F.array_sort(F.array_distinct("tools"))
    counts = F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter("tools", lambda t: t == n))))
    usage = F.map_from_arrays(F.array(*[F.lit(k) for k in USAGE]), F.array(*[F.col(k) for k in USAGE]))
    return last.select("doc_id", "now.node", "now.chunk_idx", "now.total", "now.iteration", counts.alias("tools"), shown_usage(usage).alias("usage"), "now.error")


def result_counts(extracted: DataFrame, document: str = "json", total: str = "total_chunks") -> DataFrame:
    """``doc_id, chunks, fields``: chunks of each document and fields at the top of what was made of it; 0 where it is no object."""
    return extracted.select("doc_id", F.col(total).alias("chunks"), F.coalesce(F.size(F.json_object_keys(document)), F.lit(0)).alias("fields"))


def observed(extracted: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``extracted`` with counters that are read once it has run: documents, failures, chunks and calls of the model.

    In a stream, a listener finds them under ``name`` in each batch's progress.
    """
    seen = Observation(name)
    calls = F.sum(F.coalesce(F.col("token_usage")["llm_calls"], F.lit(0))).alias("llm_calls")
    return extracted.observe(seen, F.count(F.lit(1)).alias("documents"), F.count("error").alias("failures"), F.sum("total_chunks").alias("chunks"), calls), seen
