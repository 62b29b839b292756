"""Extraction of chunks as they arrive: one state per document, chunks in order of their number whatever order they come in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from docjson.plans.extract import Planner, RulePlanner, Run
from docjson.settings import Settings

_STATE = "document string, guidance string, usage string, next int, waiting string, over boolean"
_OUT = "doc_id long, chunk_idx int, json string, done boolean, error string"


def extract_stream(chunks: DataFrame, planner: Callable[[int], Planner] | None = None, schema: dict | None = None, settings: Settings | None = None, keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A row per chunk of a stream of ``doc_id, chunk_idx, total, chunk``, once all chunks before it have come.

    ``json`` is the document after the chunk, ``done`` whether it was the last. A chunk that comes early waits in the state;
    one that comes again is ignored, also after its document is done. A planner that fails ends its document with a row that
    has the ``error``, never the query.

    State goes ``keep_ms`` after a document's last chunk came. If chunks were still missing then, a row says so. A chunk that
    comes later than that begins its document anew.
    """
    make, s = planner or (lambda _: RulePlanner()), settings or Settings()

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        document, guidance, usage, at, waiting, over = state.get if state.exists else ("{}", "{}", "{}", 0, "{}", False)
        if state.hasTimedOut:
            state.remove()
            late = [] if over else [(key[0], at, document, False, f"chunk {at} did not come")]
            yield pd.DataFrame(late, columns=["doc_id", "chunk_idx", "json", "done", "error"])
            return
        held = {int(k): v for k, v in json.loads(waiting).items()}
        for frame in frames:
            for i, total, text in zip(frame["chunk_idx"], frame["total"], frame["chunk"], strict=True):
                if not over and int(i) >= at:
                    held[int(i)] = (int(total), text)
        run = Run(make(key[0]), schema, s, json.loads(document), json.loads(guidance), json.loads(usage))
        rows: list[tuple] = []
        while at in held and not over:
            total, text = held.pop(at)
            error = None
            try:
                run.chunk(text, at, total)
            except Exception as e:  # a planner can fail in any way
                error = f"{type(e).__name__}: {e}"
            over = at + 1 == total or error is not None
            rows.append((key[0], at, json.dumps(run.document, ensure_ascii=False), over and error is None, error))
            at += 1
        # What is over leaves a mark, by which chunks that come again are known.
        state.update(("{}", "{}", "{}", at, "{}", True) if over else (json.dumps(run.document), json.dumps(run.guidance), json.dumps(run.usage), at, json.dumps(held), False))
        state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "json", "done", "error"])

    return chunks.groupBy("doc_id").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
