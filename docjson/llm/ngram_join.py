"""Exact Jaccard self-join of word n-gram sets with a token-group matrix.

Similar sets are partitioned into groups, each group stores the union of its tokens, and a set is compared with the
members of a group only if its overlap with that union could still reach the threshold. Three observations keep this
exact and small at scale:

* A token that one set alone holds cannot be in any overlap. One pass sends every set's hashed tokens, as packed arrays,
  to the partition that owns them, which counts in how many sets each occurs and sends back the shared ones only. A
  token that a great many sets hold has no owner: a sample shows them, and each set is told its figure at once.
* With tokens in order of frequency, rarest first, two sets that reach the threshold share a token among their first
  ``n - ceil(t * n) + 1``. Sets whose unshared tokens fill that prefix are done. Of the others, the shared prefix tokens are
  the rows of the matrix in which groups meet.
* Groups that meet others are packed into blocks of neighbours, and a pair of blocks is one row, however many sets they
  hold: bounded products of packed matrices inside a task settle it, and only a spanning forest of its links leaves.
  Groups that lie within one component already are not compared. A cluster that holds a third of all rows is a row of
  bounded groups tied to one anchor, never one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import materialise
from .text_hash import mix64, shingles, word_hashes
from .worker import trimmed

#: Tokens that a task holds before it sends them off.
HELD = 2_000_000
#: Members and bytes of a group, and open heads that a set is compared with while groups are formed.
GROUP, GROUP_BYTES, HEADS = 256, 2 << 20, 32
#: Groups and bytes of a block.
BLOCK, BLOCK_BYTES = 64, 4 << 20
#: Sets that are looked at for tokens that very many hold, and the sets among them that make a token one of these.
SAMPLE, OFTEN = 50_000, 50
#: Sets at least this similar to a group's head, as a fraction, go into the group.
ALIKE = (1, 2)
_LOW48 = np.uint64((1 << 48) - 1)

_PACKED = "part int, kind int, ids binary, sizes binary, runs binary, tokens binary, extra binary"
_PACKED_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("ids", "sizes", "runs", "tokens", "extra")]])
_SETS = "doc_id long, n long, digest binary, shared binary, prefix array<long>"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("shared", pa.binary()), ("prefix", pa.list_(pa.int64()))])
_GROUPS = "gid long, low int, high int, ids array<long>, sizes array<int>, sets array<binary>, joined binary, prefix array<long>, edges array<struct<a:long,b:long>>"
_GROUPS_ARROW = pa.schema([("gid", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("sets", pa.list_(pa.binary())), ("joined", pa.binary()), ("prefix", pa.list_(pa.int64())), ("edges", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])
_GROUP_FIELDS = "gid:long,comp:string,low:int,high:int,ids:array<long>,sizes:array<int>,sets:array<binary>,joined:binary,edges:array<struct<a:long,b:long>>,meets:array<long>"
_BLOCKS = f"bid long, low int, high int, cells array<struct<token:long,x:string,y:string>>, held array<struct<{_GROUP_FIELDS}>>"
_EDGES_TYPE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_GROUP_TYPE = [pa.field("gid", pa.int64()), pa.field("comp", pa.string()), pa.field("low", pa.int32()), pa.field("high", pa.int32()), pa.field("ids", pa.list_(pa.int64())), pa.field("sizes", pa.list_(pa.int32())), pa.field("sets", pa.list_(pa.binary())), pa.field("joined", pa.binary()), pa.field("edges", _EDGES_TYPE), pa.field("meets", pa.list_(pa.int64()))]
_CELLS_TYPE = pa.list_(pa.struct([("token", pa.int64()), ("x", pa.string()), ("y", pa.string())]))
_BLOCKS_ARROW = pa.schema([("bid", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("cells", _CELLS_TYPE), ("held", pa.list_(pa.struct(_GROUP_TYPE)))])
_SHARED, _META, _OFTEN = 0, 1, 2


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _home(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) % np.uint64(parts)).astype(_small(parts))


def _small(parts: int) -> type:
    """The narrowest type for partition numbers, as narrow ones sort faster."""
    return np.uint16 if parts <= 65_536 else np.uint32


def _own(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> np.uint64(40)) % np.uint64(parts)).astype(_small(parts))


def _named(tokens: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Tokens as sets hold them: 48 bits and the owner's number."""
    return mix64((tokens & _LOW48) ^ mix64(owners.astype(np.uint64)))


def _find_often(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that very many sets hold, sorted, with a figure for how many.

    No owner could hold all sets of such a token. They are found in a sample of at most about ``SAMPLE`` rows, so there are
    at most ``SAMPLE / OFTEN`` times as many as a set has tokens. A token that is missed goes to its owner like any other:
    the sample decides the way a token takes, never what is found.
    """
    total = rows.count()
    fraction = min(1.0, SAMPLE / max(total, 1))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merge() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(held or [seen[:0]]), return_counts=True)
            both, at = np.unique(np.concatenate([seen, new]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            for _, n_rows, words, row in word_hashes(batch.column(0)):
                hashes, bounds = shingles(words, row, n_rows, k)
                held += [np.unique(hashes[bounds[r] : bounds[r + 1]]) for r in range(n_rows)]
                if sum(map(len, held)) >= HELD:
                    (seen, counts), held = merge(), []
                    seen, counts = seen[counts > 1], counts[counts > 1]
        seen, counts = merge()
        seen, counts = seen[counts > 1], counts[counts > 1]
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(counts)], names=["token", "n"])

    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * fraction))).select("text")
    found = some.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN).collect()
    tokens, n = np.array([r["token"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], float)
    order = np.argsort(tokens)
    return tokens[order], np.minimum(n[order] / fraction, 2**31 - 1).astype(np.int32)


def _send_tokens(parts: int, k: int, often: np.ndarray, counts: np.ndarray):
    """Texts to packed tokens by owner, and each row's id, set size and set digest; tokens of very many sets go straight home."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # tokens, ids, sizes
        amount = 0

        def flush() -> pa.RecordBatch:
            tokens, ids, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            out = []
            if len(often):
                at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                hit = often[at] == tokens
                t, i, n = tokens[hit], ids[hit], counts[at[hit]]
                home = _home(i, parts)
                by = np.argsort(home, kind="stable")
                t, i, n, home = _named(t, _own(t, parts))[by], i[by], n[by], home[by]
                for s, m in zip(*_runs(home), strict=True):
                    rs, rn = _runs(i[s : s + m])
                    out.append((int(home[s]), _OFTEN, i[s : s + m][rs].tobytes(), None, rn.astype(np.int32).tobytes(), t[s : s + m].tobytes(), n[s : s + m].tobytes()))
                tokens, ids, sizes = tokens[~hit], ids[~hit], sizes[~hit]
            owner = _own(tokens, parts)
            order = np.argsort(owner, kind="stable")
            owner, tokens, ids, sizes = owner[order], tokens[order], ids[order], sizes[order]
            for s, n in zip(*_runs(owner), strict=True):
                here = ids[s : s + n]
                rs, rn = _runs(here)
                out.append((int(owner[s]), _SHARED, here[rs].tobytes(), sizes[s : s + n][rs].tobytes(), rn.astype(np.int32).tobytes(), _pack48(tokens[s : s + n] & _LOW48), None))
            held.clear()
            return _rows(_PACKED_ARROW, out)

        for batch in batches:
            doc_ids = batch.column(0)
            known = np.asarray(doc_ids.is_valid())
            ids = np.asarray(doc_ids.fill_null(0)).astype(np.int64)
            meta: list[tuple[int, int, int, bytes, bool]] = []
            for at, n_rows, words, rows in word_hashes(batch.column(1)):
                hashes, bounds = shingles(words, rows, n_rows, k)
                for r in range(n_rows):
                    one = np.unique(hashes[bounds[r] : bounds[r + 1]])
                    meta.append((int(ids[at + r]), len(one), bool(known[at + r]), hashlib.blake2b(one.tobytes(), digest_size=16).digest()))
                    if len(one) and known[at + r]:
                        held.append((one, np.full(len(one), ids[at + r]), np.full(len(one), len(one), np.int32)))
                        amount += len(one)
                        if amount >= HELD:
                            yield flush()
                            amount = 0
            if meta:
                m_ids = np.array([m[0] for m in meta], np.int64)
                home = _home(m_ids, parts)
                order = np.argsort(home, kind="stable")
                out = []
                for s, n in zip(*_runs(home[order]), strict=True):
                    mine = order[s : s + n]
                    out.append((int(home[mine[0]]), _META, m_ids[mine].tobytes(), np.array([meta[i][1] for i in mine], np.int32).tobytes(), np.array([meta[i][2] for i in mine], np.int32).tobytes(), None, b"".join(meta[i][3] for i in mine)))
                yield _rows(_PACKED_ARROW, out)
        if held:
            yield flush()

    return run


def _count_tokens(parts: int):
    """At a token's owner: the tokens of two or more sets, with how many, packed by the home of the set."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list[tuple[bytes, bytes, bytes, bytes]]] = {}
        for batch in batches:
            meta = []
            for row in batch.to_pylist():
                if row["kind"] != _SHARED:
                    meta.append(tuple(row.values()))
                else:
                    mine.setdefault(row["part"], []).append((row["ids"], row["sizes"], row["runs"], row["tokens"]))
            if meta:
                yield _rows(_PACKED_ARROW, meta)
        for part in sorted(mine):
            packed = mine.pop(part)
            runs = np.concatenate([np.frombuffer(p[2], np.int32) for p in packed])
            ids = np.repeat(np.concatenate([np.frombuffer(p[0], np.int64) for p in packed]), runs)
            tokens = np.concatenate([_unpack48(p[3]) for p in packed])
            del packed
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            starts, n = _runs(tokens)
            often = np.repeat(n, n)
            kept = often > 1
            tokens, ids, often = tokens[kept], ids[order][kept], np.minimum(often[kept], 2**31 - 1).astype(np.int32)
            home = _home(ids, parts)
            by = np.lexsort((ids, home))
            tokens, ids, often, home = _named(tokens[by], np.array([part])), ids[by], often[by], home[by]
            out = []
            for s, m in zip(*_runs(home), strict=True):
                rs, rn = _runs(ids[s : s + m])
                out.append((int(home[s]), _SHARED, ids[s : s + m][rs].tobytes(), None, rn.astype(np.int32).tobytes(), tokens[s : s + m].tobytes(), often[s : s + m].tobytes()))
            yield _rows(_PACKED_ARROW, out)

    return run


def _build_sets(num: int, den: int):
    """At a set's home: its shared tokens and which of them stand in its prefix."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, runs, tokens, often, meta = [], [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == _META:
                    meta.append((row["ids"], row["sizes"], row["runs"], row["extra"]))
                else:
                    ids.append(np.frombuffer(row["ids"], np.int64))
                    runs.append(np.frombuffer(row["runs"], np.int32))
                    tokens.append(np.frombuffer(row["tokens"], np.uint64))
                    often.append(np.frombuffer(row["extra"], np.int32))
        size: dict[int, int] = {}
        for p in meta:
            for i, n, ok in zip(np.frombuffer(p[0], np.int64).tolist(), np.frombuffer(p[1], np.int32).tolist(), np.frombuffer(p[2], np.int32).tolist(), strict=True):
                if ok:
                    size[i] = max(n, size.get(i, 0))
        found: dict[int, tuple[bytes, list[int]]] = {}
        if ids:
            owner = np.repeat(np.concatenate(ids), np.concatenate(runs))
            tok, cnt = np.concatenate(tokens), np.concatenate(often)
            ids, runs, tokens, often = [], [], [], []
            order = np.lexsort((tok, owner))
            owner, tok, cnt = owner[order], tok[order], cnt[order]
            for s, n in zip(*_runs(owner), strict=True):
                t, first = np.unique(tok[s : s + n], return_index=True)
                f, i = cnt[s : s + n][first], int(owner[s])
                all_n = max(size[i], len(t))
                room = all_n - -(-num * all_n // den) + 1 - (all_n - len(t))
                if room > 0:
                    found[i] = t.tobytes(), t[np.lexsort((t, f))[:room]].view(np.int64).tolist()
        out = []
        for p in meta:
            for j, (i, n, ok) in enumerate(zip(np.frombuffer(p[0], np.int64).tolist(), np.frombuffer(p[1], np.int32).tolist(), np.frombuffer(p[2], np.int32).tolist(), strict=True)):
                shared, prefix = found.pop(i, (None, None)) if ok else (None, None)
                out.append((i if ok else None, n, p[3][16 * j : 16 * j + 16], shared, prefix))
                if len(out) >= 2000:
                    yield _rows(_SETS_ARROW, out)
                    out = []
        if out:
            yield _rows(_SETS_ARROW, out)

    return run


def _linked(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, num: int, den: int) -> bool:
    """Whether two sets, given by their shared tokens and whole sizes, reach the threshold."""
    if den * min(n_a, n_b) < num * max(n_a, n_b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (n_a + n_b - both)


class _Forest:
    """Disjoint sets over places 0..n-1; ``join`` says whether it joined two."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _matrix(sets: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """Which of ``tokens`` (sorted) each set holds."""
    out = np.zeros((len(sets), len(tokens)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(tokens, s)
        at[at == len(tokens)] = 0
        out[i, at[tokens[at] == s] if len(tokens) else []] = 1
    return out


def _reach(both: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, num: int, den: int) -> np.ndarray:
    both = np.rint(both).astype(np.int64)
    return den * both >= num * (n_a[:, None] + n_b[None, :] - both)


class _Group:
    """Similar sets under one min-hash, with the links among them that have been found."""

    def __init__(self, doc_id: int, n: int, tokens: np.ndarray, prefix: list[int], anchor: tuple | None, num: int, den: int):
        self.gid, self.head, self.n = doc_id, tokens, n
        self.anchor = anchor or (doc_id, tokens, n)
        self.ids, self.sizes, self.sets, self.prefix, self.bytes, self.edges = [], [], [], set(), 0, []
        self.add(doc_id, n, tokens, prefix, num, den)

    def add(self, doc_id: int, n: int, tokens: np.ndarray, prefix: list[int], num: int, den: int) -> None:
        self.ids.append(doc_id), self.sizes.append(n), self.sets.append(tokens)
        self.prefix.update(prefix)
        self.bytes += tokens.nbytes
        other, t, m = self.anchor
        if other != doc_id and _linked(tokens, n, t, m, num, den):
            self.edges.append((doc_id, other))

    def full(self) -> bool:
        return len(self.ids) >= GROUP or self.bytes >= GROUP_BYTES

    def row(self, num: int, den: int) -> tuple:
        joined = np.unique(np.concatenate(self.sets))
        if len(self.ids) > 1:  # what the anchor did not settle
            place = {i: k for k, i in enumerate(self.ids)}
            forest, tied = _Forest(len(self.ids) + 1), len(self.ids)
            for i, _ in self.edges:
                forest.join(place[i], tied)
            if self.anchor[0] in place:
                forest.join(place[self.anchor[0]], tied)
            rest = len({forest.root(k) for k in range(len(self.ids))})
            if rest > 1:
                m, n = _matrix(self.sets, joined), np.array(self.sizes)
                for i, j in zip(*np.nonzero(np.triu(_reach(m @ m.T, n, n, num, den), 1)), strict=True):
                    if forest.join(int(i), int(j)):
                        self.edges.append((self.ids[i], self.ids[j]))
        return self.gid, min(self.sizes), max(self.sizes), self.ids, self.sizes, [s.tobytes() for s in self.sets], joined.tobytes(), list(self.prefix), [{"a": x, "b": y} for x, y in self.edges]


def _form_groups(num: int, den: int):
    """Rows in order of a min-hash: each set joins the first open group whose head is like it, or heads a new one.

    The first head of a row of groups is their anchor. Every member is compared with it, which links the parts of a
    cluster that fills more than one group.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, done = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key:
                    done += heads
                    key, heads = row["key"], []
                tokens = np.frombuffer(row["shared"], np.uint64)
                near = next((g for g in heads if _linked(g.head, g.n, tokens, row["n"], *ALIKE)), None)
                if near is not None and not near.full():
                    near.add(row["doc_id"], row["n"], tokens, row["prefix"], num, den)
                else:
                    if near is not None:
                        heads.remove(near)
                        done.append(near)
                    heads.insert(0, _Group(row["doc_id"], row["n"], tokens, row["prefix"], near.anchor if near is not None else None, num, den))
                    if len(heads) > HEADS:
                        done.append(heads.pop())
                if len(done) >= 500 or sum(g.bytes for g in done[-8:]) > GROUP_BYTES:
                    yield _rows(_GROUPS_ARROW, [g.row(num, den) for g in done])
                    done = []
        if done or heads:
            yield _rows(_GROUPS_ARROW, [g.row(num, den) for g in [*done, *heads]])

    return run


def _link_heads(num: int, den: int):
    """Heads in order of other min-hashes: links to the heads seen last under the same key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["salt"], row["key"]) != key:
                    key, heads = (row["salt"], row["key"]), []
                tokens = np.frombuffer(row["head"], np.uint64)
                near = next((h for h in heads if _linked(h[1], h[2], tokens, row["n"], num, den)), None)
                if near:
                    out.append((row["gid"], near[0]))
                else:
                    heads = [(row["gid"], tokens, row["n"]), *heads[: HEADS - 1]]
            yield _rows(schema, out)

    return run


def _between(a: dict, b: dict, num: int, den: int) -> list[tuple[int, int]]:
    """Links between two groups: bound each set's overlap with the other group's union, open what qualifies.

    Of the links, a spanning forest is kept.
    """
    joined = np.intersect1d(np.frombuffer(a["joined"], np.uint64), np.frombuffer(b["joined"], np.uint64), assume_unique=True)
    n_a, n_b = np.array(a["sizes"], np.int64), np.array(b["sizes"], np.int64)
    if den * len(joined) < num * n_a.min() or den * len(joined) < num * n_b.min():
        return []
    held = _matrix([np.frombuffer(x, np.uint64) for x in a["sets"]], joined)
    mine = np.flatnonzero((den * held.sum(1) >= num * n_a) & (den * n_b.max() >= num * n_a) & (den * n_a >= num * n_b.min()))
    if not len(mine):
        return []
    other = _matrix([np.frombuffer(x, np.uint64) for x in b["sets"]], joined)
    theirs = np.flatnonzero(den * other.sum(1) >= num * n_b)
    reach = _reach(held[mine] @ other[theirs].T, n_a[mine], n_b[theirs], num, den)
    if not reach.any():
        return []
    # What each group knows of its own links need not be said again.
    place: dict[int, int] = {}
    for i in [*a["ids"], *b["ids"], *[x for e in [*a["edges"], *b["edges"]] for x in (e["a"], e["b"])]]:
        place.setdefault(i, len(place))
    forest, out = _Forest(len(place)), []
    for e in [*a["edges"], *b["edges"]]:
        forest.join(place[e["a"]], place[e["b"]])
    for i, j in zip(*np.nonzero(reach), strict=True):
        x, y = a["ids"][mine[i]], b["ids"][theirs[j]]
        if forest.join(place[x], place[y]):
            out.append((x, y))
    return out


def _form_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups in order of a token in which they meet others: a bounded number of neighbours is a block."""
    held: list[dict] = []
    amount = 0

    def block() -> pa.RecordBatch:
        tokens: dict[int, set[str]] = {}
        for g in held:
            for t in g["meets"]:
                tokens.setdefault(t, set()).add(g["comp"])
        cells = [{"token": t, "x": min(c), "y": max(c)} for t, c in tokens.items()]
        row = (held[0]["gid"], min(g["low"] for g in held), max(g["high"] for g in held), cells, list(held))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS_ARROW, strict=True)], schema=_BLOCKS_ARROW)

    for batch in batches:
        for row in batch.to_pylist():
            size = sum(map(len, row["sets"])) + len(row["joined"]) + 8 * len(row["meets"])
            if held and (len(held) >= BLOCK or amount + size > BLOCK_BYTES):
                yield block()
                held, amount = [], 0
            held.append({f.name: row[f.name] for f in _GROUP_TYPE})
            amount += size
    if held:
        yield block()


def _open_blocks(num: int, den: int, pairs: bool):
    """Links between the groups of two blocks, or of one; ``a`` and ``b`` are the ends of a link.

    Groups are compared if they meet in a token of both prefixes, their sizes fit and nothing ties them together yet.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(left: list[dict], right: list[dict] | None) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        meets = [set(g["meets"]) for g in left]
        others = meets if right is None else [set(g["meets"]) for g in right]
        names = {c: i for i, c in enumerate({g["comp"] for g in [*left, *(right or [])]})}
        forest = _Forest(len(names))
        for i, a in enumerate(left):
            for j, b in enumerate(left[:i] if right is None else right):
                if den * a["high"] < num * b["low"] or den * b["high"] < num * a["low"] or meets[i].isdisjoint(others[j]):
                    continue
                x, y = names[a["comp"]], names[b["comp"]]
                if forest.root(x) == forest.root(y):
                    continue
                found = _between(a, b, num, den)
                out += found
                if found and a["comp"][0] == b["comp"][0] == "c":
                    forest.join(x, y)
        return out

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left = batch.column(0)[i].as_py()
                yield _rows(schema, links(left, batch.column(1)[i].as_py() if pairs else None))

    return run


def _min_hashes(column: str, *salts: int):
    """The smallest token of a set under one order per salt."""
    multipliers = [np.uint64(int(mix64(np.array([s + 1], np.uint64))[0]) | 1) for s in salts]

    def least(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [int(mix64(np.frombuffer(v, np.uint64) * m).min().view(np.int64)) for m in multipliers])

    return F.pandas_udf(least, "array<long>")(F.col(column))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``.

    Words are runs without ASCII white space, lower-cased in A-Z. A document's set holds its distinct runs of ``k`` words;
    with fewer words, its whole sequence. Two documents are linked when ``den * intersection >= num * union``.
    ``component_id`` is the smallest ``doc_id`` that links reach, a document itself included.

    Args:
        docs: needs ``doc_id`` (whole numbers) and ``text``; other columns are ignored.
        k, num, den: words in a shingle and the threshold ``num/den``, over 1/2.

    Defined cases: null, empty and blank texts have 0 shingles and link with nothing. A null ``doc_id`` keeps its row, with
    a null component, and links with nothing. Repeated rows are rows of one component; should rows with one id have
    different texts, they are one set that holds the shingles of all and counts as large as the largest. A text of any length is one set. An empty table gives an
    empty result. Tokens are 64-bit hashes cut to 48 bits and their owner, so a set may in theory gain a shared token
    by accident; the chance for a pair of 1,000-word texts is below 1e-8.
    """
    if not 1 < 2 * num / den <= 2:
        raise ValueError("the threshold must lie in (1/2, 1]")
    spark = docs.sparkSession
    parts = min(1 << 20, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(_send_tokens(parts, k, *_find_often(rows, k)), _PACKED)
    counted = packed.repartitionById(parts, "part").mapInArrow(_count_tokens(parts), _PACKED)
    sets = materialise(counted.repartitionById(parts, "part").mapInArrow(_build_sets(num, den), _SETS), "sets")

    candidates = sets.filter("shared is not null")
    classes = candidates.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    unique = candidates.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    ordered = (
        unique.select("doc_id", "n", "shared", "prefix", _min_hashes("shared", 0)[0].alias("key"))
        .repartitionByRange(parts, "key", "n", "doc_id")
        .sortWithinPartitions("key", "n", "doc_id")
    )
    groups = materialise(ordered.mapInArrow(_form_groups(num, den), _GROUPS), "groups")

    edges = groups.select(F.explode("edges").alias("e")).select("e.a", "e.b")
    heads = groups.select("gid", F.element_at("sets", 1).alias("head"), F.element_at("sizes", 1).alias("n"))
    by = heads.select("gid", "head", "n", F.posexplode(_min_hashes("head", 1, 2, 3)).alias("salt", "key"))
    by = by.repartitionByRange(parts, "salt", "key", "n", "gid").sortWithinPartitions("salt", "key", "n", "gid")
    edges = edges.union(by.mapInArrow(_link_heads(num, den), "a long, b long"))
    edges = materialise(edges, "links")
    known = components(edges)

    # A group within one component goes by its name; any other by a name of its own.
    members = groups.select("gid", F.explode("ids").alias("id")).join(known, F.col("id") == F.col("node"), "left")
    spans = members.groupBy("gid").agg(F.min(F.coalesce("component", "id")).alias("x"), F.max(F.coalesce("component", "id")).alias("y"))
    comp = F.when(F.col("x") == F.col("y"), F.concat(F.lit("c"), "x")).otherwise(F.concat(F.lit("g"), "gid"))
    names = spans.select("gid", comp.alias("comp"))
    # Rows of the matrix: prefix tokens by group. Only tokens in which two names meet say anything new.
    cells = materialise(groups.select("gid", F.explode("prefix").alias("token")).join(names, "gid"), "cells")
    meeting = cells.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
    meets = cells.join(meeting, "token", "left_semi").groupBy("gid").agg(F.first("comp").alias("comp"), F.collect_list("token").alias("meets"))
    # Groups that meet are packed into blocks, and pairs of blocks are compared: a token that many groups hold pairs blocks only.
    order = ("_near", "low", "gid")
    near = groups.drop("prefix").join(meets, "gid").withColumn("_near", F.array_min(F.transform("meets", lambda t: F.xxhash64(t))))
    blocks = materialise(near.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_form_blocks, _BLOCKS), "blocks")
    rows = blocks.select("bid", "low", "high", F.explode("cells").alias("c")).select("bid", "low", "high", "c.*")
    fits = (F.col("l.high") * den >= F.col("r.low") * num) & (F.col("r.high") * den >= F.col("l.low") * num)
    new = (F.least("l.x", "r.x") != F.greatest("l.y", "r.y")) & (F.col("l.bid") < F.col("r.bid"))
    pairs = rows.alias("l").join(rows.alias("r"), (F.col("l.token") == F.col("r.token")) & new & fits).select(F.col("l.bid").alias("p"), F.col("r.bid").alias("q")).distinct()
    sides = [blocks.select(F.col("bid").alias(x), F.col("held").alias(f"{x}_held")) for x in "pq"]
    apart = pairs.join(sides[0], "p").join(sides[1], "q").select("p_held", "q_held").mapInArrow(_open_blocks(num, den, True), "a long, b long")
    opened = blocks.select("held").mapInArrow(_open_blocks(num, den, False), "a long, b long").union(apart)
    final = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(opened))

    # From components to their members, the copies of these and the smallest id of all.
    reps = classes.join(final, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("_c"))
    return (
        sets.select("doc_id", "n", "digest")
        .join(reps, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the document of the smallest id left of each component; all columns stay."""
    found = jaccard_components(docs, **options)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
