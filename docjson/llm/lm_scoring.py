"""A word n-gram model by deleted interpolation, and the log probability of every text under it.

Texts are encoded once, in chunks of a few million words with a vocabulary of their own, and stay where all executors can
read them. A chunk asks for the corpus counts of its distinct n-grams: each n-gram goes, as a packed hash with its counts
in the chunk, to the partition that owns it, and the totals come back in the order of the question. So an n-gram crosses
the network once per chunk, not once per occurrence, no count table is broadcast, and a frequent n-gram is one entry
per chunk. Words and n-grams are 64-bit hashes, cut to 48 bits and their owner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .text_hash import mix64, word_hashes

#: Words in a chunk; a longer text is a chunk of its own.
CHUNK = 1_200_000
#: Context-frequency buckets: powers of two.
BUCKETS = 64
#: Steps per factor of two in which probabilities are tabulated for the estimation of weights.
STEPS = 4
_NEVER = -9999
_END = np.uint64(0xE0D0C0B0A0908071)
_START = np.uint64(0x51A2B3C4D5E6F708)
_ODD = mix64(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
#: Which counts a document enters: those of the maximum-likelihood estimates, those held out for the weights, or none.
MAIN, DELETED, HELD_OUT = 0, 1, 2

_CHUNKS = "chunk long, fold int, ids binary, valid binary, lengths binary, folds binary, words binary, sequence binary"
_CHUNKS_ARROW = pa.schema([("chunk", pa.int64()), ("fold", pa.int32()), *[(n, pa.binary()) for n in ("ids", "valid", "lengths", "folds", "words", "sequence")]])
_ASKED = "part int, level int, chunk long, keys binary, main binary, deleted binary"
_ASKED_ARROW = pa.schema([("part", pa.int32()), ("level", pa.int32()), ("chunk", pa.int64()), *[(n, pa.binary()) for n in ("keys", "main", "deleted")]])
_TOLD = "chunk long, level int, part int, main binary, deleted binary, tokens_main long, tokens long, types long"
_TOLD_ARROW = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("main", pa.binary()), ("deleted", pa.binary()), ("tokens_main", pa.int64()), ("tokens", pa.int64()), ("types", pa.int64())])


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers below 2**63, byte plane by byte plane: a byte for the number of planes, and only as many as the largest needs."""
    wide = 4 if not len(x) or int(x.max()) < 2**32 else 8
    return bytes([wide]) + zstandard.compress(np.ascontiguousarray(x.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T).tobytes(), 3)


def _expand(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(memoryview(b)[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").ravel()


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to chunks; documents of the deleted fold have chunks of their own."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 24
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}

    def flush(kind: bool) -> pa.RecordBatch:
        nonlocal number
        docs = held[kind]
        words = np.concatenate([d[3] for d in docs])
        known, which, count = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = (number, int(kind), np.array([d[0] for d in docs], np.int64).tobytes(), np.array([d[1] for d in docs], np.uint8).tobytes(), np.array([len(d[3]) for d in docs], np.int32).tobytes(), np.array([d[2] for d in docs], np.uint8).tobytes(), known[order].tobytes(), _squeeze(rank[which]))
        number += 1
        held[kind], size[kind] = [], 0
        return _table(_CHUNKS_ARROW, [row])

    for batch in batches:
        valid = np.asarray(batch.column(0).is_valid())
        ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
        folds = np.asarray(batch.column(2)).astype(np.int64)
        for at, n_rows, words, rows in word_hashes(batch.column(1)):
            bounds = np.searchsorted(rows, np.arange(n_rows + 1))
            for r in range(n_rows):
                i = at + r
                kind = bool(folds[i] == DELETED)
                held[kind].append((ids[i], valid[i], folds[i], np.append(words[bounds[r] : bounds[r + 1]], _END)))
                size[kind] += int(bounds[r + 1] - bounds[r]) + 1
                if size[kind] >= CHUNK:
                    yield flush(kind)
    for kind in (False, True):
        if held[kind]:
            yield flush(kind)


class _Chunk:
    """The n-grams of a chunk: for each level, the n-gram at each place, and the hash of each distinct one."""

    def __init__(self, row: dict, order: int):
        self.ids, self.valid = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["valid"], np.uint8)
        self.lengths, self.folds = np.frombuffer(row["lengths"], np.int32), np.frombuffer(row["folds"], np.uint8)
        words, self.cur = np.frombuffer(row["words"], np.uint64), _expand(row["sequence"]).astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.first = self.ends - self.lengths
        self.fold_at = np.repeat(self.folds, self.lengths)
        starts = np.zeros(len(self.cur), bool)
        starts[self.first] = True
        self.starts = starts
        self.grams, self.keys = [self.cur], [mix64(words * _ODD[0])]
        start_key = mix64(np.array([_START]))[0]
        for level in range(2, order + 1):
            # The context of a place is the shorter n-gram that ends just before it; 0 stands for the start of the text.
            context = np.where(starts, 0, np.concatenate([[0], self.grams[-1][:-1] + 1]))
            code, first, gram = np.unique(context * len(words) + self.cur, return_index=True, return_inverse=True)
            before = np.concatenate([[start_key], self.keys[-1]])[context[first]]
            self.keys.append(mix64(before * _ODD[level - 1] + words[self.cur[first]] * _ODD[7] + np.uint64(level)))
            self.grams.append(gram)

    def owners(self, level: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The owner of each n-gram of a level, and the order in which owners are asked."""
        owner = ((self.keys[level] >> np.uint64(40)) % np.uint64(parts)).astype(np.uint16 if parts <= 65_536 else np.uint32)
        return owner, np.argsort(owner, kind="stable")


def _ask(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c, out = _Chunk(row, order), []
                for level in range(order):
                    keys, gram = c.keys[level], c.grams[level]
                    main, deleted = (np.bincount(gram[c.fold_at == f], minlength=len(keys)) for f in (MAIN, DELETED))
                    owner, by = c.owners(level, parts)
                    cuts = np.searchsorted(owner[by], np.arange(parts + 1))
                    for p in np.flatnonzero(np.diff(cuts)):
                        mine = by[cuts[p] : cuts[p + 1]]
                        out.append((int(p), level, row["chunk"], _pack48(keys[mine]), _squeeze(main[mine]), _squeeze(deleted[mine])))
                yield _table(_ASKED_ARROW, out)

    return run


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of the n-grams this task owns, back to each chunk that asked."""
    asked: dict[tuple[int, int], list[tuple]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            asked.setdefault((r["part"], r["level"]), []).append((r["chunk"], r["keys"], r["main"], r["deleted"]))
    for part, level in sorted(asked):
        rows = asked.pop((part, level))
        keys = [_unpack48(r[1]) for r in rows]
        cuts = np.cumsum([0, *map(len, keys)])
        found, which = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        main, deleted = (np.zeros(len(found), np.int64) for _ in range(2))
        for j, r in enumerate(rows):  # a question names an n-gram once
            mine = which[cuts[j] : cuts[j + 1]]
            main[mine] += _expand(r[2]).astype(np.int64)
            deleted[mine] += _expand(r[3]).astype(np.int64)
        for j, r in enumerate(rows):
            mine = which[cuts[j] : cuts[j + 1]]
            yield _table(_TOLD_ARROW, [(r[0], level, part, _squeeze(main[mine]), _squeeze(deleted[mine]), None, None, None)])
        if level == 0:
            both = main + deleted
            yield _table(_TOLD_ARROW, [(-1, level, part, None, None, int(main.sum()), int(both.sum()), int((both > 0).sum()))])


def _answered(chunk_row: dict, told: list[dict], order: int, parts: int) -> tuple[_Chunk, list[np.ndarray], list[np.ndarray]]:
    """A chunk with the corpus counts of its n-grams, for the main fold and for the deleted one."""
    c = _Chunk(chunk_row, order)
    main, deleted = ([np.zeros(len(k), np.int64) for k in c.keys] for _ in range(2))
    by_level: dict[int, list[dict]] = {}
    for t in told:
        by_level.setdefault(t["level"], []).append(t)
    for level, rows in by_level.items():
        owner, by = c.owners(level, parts)
        cuts = np.searchsorted(owner[by], np.arange(parts + 1))
        for t in rows:
            mine = by[cuts[t["part"]] : cuts[t["part"] + 1]]
            main[level][mine], deleted[level][mine] = _expand(t["main"]), _expand(t["deleted"])
    return c, main, deleted


def _estimates(c: _Chunk, counts: list[np.ndarray], n_docs: int, n_tokens: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Maximum-likelihood estimates at each place, shortest n-gram first, and the bucket of its longest context."""
    out, context = [counts[0][c.grams[0]] / max(n_tokens, 1)], np.full(len(c.cur), n_tokens)
    for level in range(1, len(counts)):
        shorter = counts[level - 1][c.grams[level - 1]]
        context = np.where(c.starts, n_docs, np.concatenate([[0], shorter[:-1]]))
        out.append(np.where(context > 0, counts[level][c.grams[level]] / np.maximum(context, 1), 0.0))
    return out, np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def fit_weights(cells: np.ndarray, count: np.ndarray, floor: float, order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights per bucket by expectation-maximisation.

    ``cells`` has a bucket and the tabulated estimates of each kind of held-out event, ``count`` how often it occurred.
    The mixture has ``order + 1`` parts, the first of which is uniform with probability ``floor``. The pooled weights start
    every bucket and count as one hundred events of it, so that rare buckets do not run to an extreme.
    """
    p = np.full((len(cells), order + 1), floor)
    p[:, 1:] = np.where(cells[:, 1:] == _NEVER, 0.0, 2.0 ** (cells[:, 1:] / STEPS))

    def climb(rows: np.ndarray, start: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = start.copy()
        for _ in range(rounds):
            joint = p[rows] * w
            share = joint / joint.sum(1, keepdims=True) * count[rows, None]
            w = share.sum(0) + prior
            w = np.maximum(w / w.sum(), 1e-6)
            w /= w.sum()
        return w

    even = np.full(order + 1, 1 / (order + 1))
    if not len(cells):
        return np.tile(even, (BUCKETS, 1))
    pooled = climb(np.arange(len(cells)), even, np.zeros(order + 1))
    return np.stack([climb(rows, pooled, 100 * pooled) if len(rows := np.flatnonzero(cells[:, 0] == b)) else pooled for b in range(BUCKETS)])


def score_texts(docs: DataFrame, order: int = 2, of: int = 7, held_out: int = 2, deleted: int = 3) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` and ``perplexity`` for every row of ``docs``.

    A row whose crc32 of the id as text leaves ``held_out`` by ``of`` takes no part in the counts. Of the others, those that
    leave ``deleted`` are held out a second time, to learn by expectation-maximisation how the estimates of each
    order, made from the rest, are best mixed in each bucket of context frequency. The final estimates use both.

    ``score`` is the log10 probability of the text, its end included; ``base_score`` that of an add-one unigram model.

    Args:
        docs: needs ``doc_id`` and ``text``; other columns are ignored.
        order: longest n-gram, 1 to 6.

    Defined cases: null, empty and blank texts consist of their end alone. A null ``doc_id`` counts as empty text in the
    crc32. Repeated rows are scored, and counted, each. Without training rows all counts are 0 and the mixture is
    uniform. An empty table gives an empty result. Words the training rows lack share the uniform part.
    """
    spark = docs.sparkSession
    parts = min(1 << 20, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of
    fold = F.when(left == held_out, HELD_OUT).when(left == deleted, DELETED).otherwise(MAIN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.cast("int").alias("fold"))
    chunks = materialise(rows.mapInArrow(_encode, _CHUNKS), "lm-chunks")
    asked = chunks.mapInArrow(_ask(order, parts), _ASKED)
    told = materialise(asked.repartitionById(parts, "part").mapInArrow(_tell, _TOLD), "lm-counts")
    n_main, n_all, types = (int(x or 0) for x in told.agg(F.sum("tokens_main"), F.sum("tokens"), F.sum("types")).first())
    answers = told.filter("chunk >= 0").drop("tokens_main", "tokens", "types")
    n_docs = rows.groupBy("fold").count().collect()  # three rows at most
    n_docs = {r["fold"]: r["count"] for r in n_docs}
    d_main, d_all = n_docs.get(MAIN, 0), n_docs.get(MAIN, 0) + n_docs.get(DELETED, 0)
    floor = 1.0 / (types + 1)

    names = ["bucket", *[f"q{k}" for k in range(1, order + 1)]]

    def tabulate(_, chunk: pa.Table, told_rows: pa.Table) -> pa.Table:
        schema = pa.schema([*[(n, pa.int32()) for n in names], ("n", pa.int64())])
        if not chunk.num_rows:
            return schema.empty_table()
        c, main, _d = _answered(chunk.to_pylist()[0], told_rows.to_pylist(), order, parts)
        estimates, bucket = _estimates(c, main, d_main, n_main)
        with np.errstate(divide="ignore"):
            steps = [np.where(e > 0, np.rint(np.log2(e) * STEPS), _NEVER).astype(np.int64) for e in estimates]
        cells, n = np.unique(np.column_stack([bucket, *steps]), axis=0, return_counts=True)
        return pa.table([*[pa.array(cells[:, i], pa.int32()) for i in range(order + 1)], pa.array(n, pa.int64())], schema=schema)

    weighing = chunks.filter(F.col("fold") == DELETED).groupBy("chunk").cogroup(answers.join(chunks.filter(F.col("fold") == DELETED).select("chunk"), "chunk", "left_semi").groupBy("chunk"))
    table = weighing.applyInArrow(tabulate, ", ".join(f"{n} int" for n in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))
    # The grid of buckets and steps bounds this table, whatever the input.
    events = np.array([tuple(r) for r in table.collect()], np.int64).reshape(-1, order + 2)
    weights = fit_weights(events[:, :-1], events[:, -1].astype(float), floor, order)

    def apply(_, chunk: pa.Table, told_rows: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _SCORED_ARROW.empty_table()
        c, main, second = _answered(chunk.to_pylist()[0], told_rows.to_pylist(), order, parts)
        counts = [a + b for a, b in zip(main, second, strict=True)]
        estimates, bucket = _estimates(c, counts, d_all, n_all)
        w = weights[bucket]
        p = w[:, 0] * floor
        for k, e in enumerate(estimates, 1):
            p += w[:, k] * e
        known = counts[0][c.cur]
        base = np.log10((known + 1.0) / (n_all + types + 1.0))
        sums = [np.add.reduceat(x, c.first) for x in (np.log10(p), base, (known > 0).astype(np.int64))]
        ids = pa.array(c.ids, pa.int64(), mask=c.valid == 0)
        return pa.table([ids, pa.array(c.folds == HELD_OUT), pa.array(c.lengths.astype(np.int64)), pa.array(sums[2]), pa.array(np.full(len(c.ids), n_all)), pa.array(sums[1]), pa.array(sums[0]), pa.array(10.0 ** (-sums[0] / c.lengths))], schema=_SCORED_ARROW)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, _SCORED)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
_SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])
