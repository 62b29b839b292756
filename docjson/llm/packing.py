"""Packing token sequences along a space-filling curve."""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .text_hash import hash_spans, mix64, text_slices, word_bounds
from .worker import trimmed

#: Dimensions and bits each of the curve; its leading bits name the cells that are dealt to partitions.
DIMS, BITS, CELL_BITS = 3, 8, 12
_PRETOKEN = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Words whose split and lower case need no Unicode tables: printable ASCII and Latin letters up to U+017F.
_PLAIN = regex.compile("[\\n\\x21-\\x7eÀ-ÖØ-öø-įı-ňŊ-ž]+")
#: Words that a worker remembers.
_CACHE = 600_000
#: What :func:`word_bounds` returns.
Words = tuple[np.ndarray, np.ndarray, np.ndarray]


def _byte_letters() -> list[str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(extra)) for b in range(256)]


class WordEncoder:
    """A tokenizer applied word by word, each distinct word once.

    For vocabularies that drop white space and let no piece cross it, a text's ids are its words' ids in order. A word
    goes to the vocabulary's merge model after the split and lower-casing that the file declares; a word with letters
    beyond Latin, combining marks or what might be a special token goes to the whole tokenizer.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.words: dict[int, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _piece(self, p: str) -> bytes:
        spelt = p if p.isascii() else "".join(self.letters[b] for b in p.encode())
        found = array("H", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(self.pieces) >= _CACHE:
            self.pieces.clear()
        self.pieces[p] = found
        return found

    def _whole(self, word: str) -> bytes:
        return array("H", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> list[bytes]:
        """Ids of words in a text of one word a line: the split, the lower-casing and the look-ups are one pass."""
        out, now, get, make = [], [], self.pieces.get, self._piece
        for p in _PRETOKEN.findall(text.lower()):
            if p == "\n":
                out.append(b"".join(now))
                now = []
            else:
                found = get(p)
                now.append(make(p) if found is None else found)
        out.append(b"".join(now))
        return out

    def new_words(self, raw: list[bytes]) -> list[bytes]:
        if not raw:
            return []
        text = b"\n".join(raw).decode("utf-8", "replace")
        if "<|" not in text and _PLAIN.fullmatch(text):
            return self._plain(text)
        words = text.split("\n")
        odd = {i for i, w in enumerate(words) if "<|" in w or not _PLAIN.fullmatch(w)}
        plain = [w for i, w in enumerate(words) if i not in odd]
        done = iter(self._plain("\n".join(plain)) if plain else [])
        return [self._whole(w) if i in odd else next(done) for i, w in enumerate(words)]

    def encode(self, data: np.ndarray, offsets: np.ndarray, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data``, and the bounds of each text's."""
        starts, ends, rows = words or word_bounds(data, offsets)
        hashes, first, which = np.unique(hash_spans(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        keys, raw = hashes.tolist(), data.tobytes()
        ids = list(map(self.words.get, keys))
        missing = [k for k, b in enumerate(ids) if b is None]
        at, to = starts[first].tolist(), ends[first].tolist()
        made = self.new_words([raw[at[k] : to[k]] for k in missing])
        if len(self.words) + len(made) > _CACHE:
            self.words.clear()
        for k, b in zip(missing, made, strict=True):
            ids[k] = b
            self.words[keys[k]] = b
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat = np.frombuffer(b"".join(ids), np.uint16)
        each = size[which]
        ends_at = np.cumsum(each)
        begin = np.cumsum(size) - size
        total = int(ends_at[-1]) if len(each) else 0
        place = np.arange(total) + np.repeat(begin[which] - (ends_at - each), each)
        bounds = np.concatenate([[0], ends_at])[np.searchsorted(rows, np.arange(len(offsets)))]
        return flat[place], bounds


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of ``cells`` (whole numbers below ``2**bits``) on the Hilbert curve of that many dimensions.

    The transform turns coordinates into the curve's index one bit plane at a time: it undoes the reflections and
    exchanges of axes that each level of the curve has, then Gray-decodes.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(data: np.ndarray, offsets: np.ndarray, words: Words | None = None) -> np.ndarray:
    """Hilbert keys of texts: hashed bags of words under a random projection, each axis spread evenly over its cells."""
    starts, ends, rows = words or word_bounds(data, offsets)
    h = hash_spans(data, starts, ends)
    n_rows = len(offsets) - 1
    count = np.maximum(np.bincount(rows, minlength=n_rows), 1)
    axes = []
    for d in range(DIMS):
        part = ((h >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64) / 32768 - 1
        sums = np.bincount(rows, weights=part, minlength=n_rows) / np.sqrt(count / 3)
        even = 1 / (1 + np.exp(-1.702 * np.clip(sums, -30, 30)))
        axes.append(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
    return hilbert_key(np.column_stack(axes), BITS)


@trimmed
def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of text in each cell of the curve: one row per cell and task."""
    total = np.zeros(1 << CELL_BITS)
    for batch in batches:
        for _, data, offsets in text_slices(batch.column(0)):
            cell = curve_keys(data, offsets) >> (DIMS * BITS - CELL_BITS)
            total += np.bincount(cell, weights=np.diff(offsets) + 8, minlength=len(total))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells].astype(np.int64))], names=["cell", "bytes"])


def _deal(weights: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First partition and number of partitions of each cell: light cells share one, a heavy cell has several."""
    target = max(1.0, weights.sum() / max(parts, 1))
    first, ways = np.zeros(len(weights), np.int64), np.ones(len(weights), np.int64)
    part, filled = 0, 0.0
    for i, w in enumerate(weights):
        if filled and filled + w > 1.5 * target:
            part, filled = part + 1, 0.0
        first[i] = part
        if w > 1.5 * target:
            ways[i] = math.ceil(w / target)
            part, filled = part + int(ways[i]), 0.0
        else:
            filled += w
    return first, ways, part + 1


_TOKENS = "part int, key long, tie long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _tokenise(path: str, end_id: int, first: np.ndarray, ways: np.ndarray):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        context = TaskContext.get()
        seen = (context.partitionId() if context else 0) << 40
        for batch in batches:
            doc_ids = batch.column(0)
            # Rows without an id are told apart by their place, or all of them would go to one partition of their cell.
            numbers = np.where(np.asarray(doc_ids.is_valid()), np.asarray(doc_ids.fill_null(0)).astype(np.int64), -1 - seen - np.arange(len(doc_ids)))
            seen += len(doc_ids)
            for at, data, offsets in text_slices(batch.column(1)):
                words = word_bounds(data, offsets)
                keys = curve_keys(data, offsets, words)
                cell = keys >> (DIMS * BITS - CELL_BITS)
                n_rows = len(offsets) - 1
                tie = mix64(numbers[at : at + n_rows].astype(np.uint64)) >> np.uint64(1)
                part = first[cell] + (tie % ways[cell].astype(np.uint64)).astype(np.int64)
                ids, bounds = encoder.encode(data, offsets, words)
                blobs = [np.append(ids[bounds[r] : bounds[r + 1]], np.uint16(end_id)).tobytes() for r in range(n_rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(keys), pa.array(tie.astype(np.int64)), doc_ids.slice(at, n_rows), pa.array(np.diff(bounds) + 1, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["part", "key", "tie", "doc_id", "n", "ids"],
                )

    return run


class _Sequence:
    """The sequence being filled: pieces as (doc_id, start, ids, doc_tokens)."""

    def __init__(self, part: int):
        self.part, self.count, self.pieces, self.used = part, 0, [], 0

    def close(self) -> list[tuple]:
        rows, offset = [], 0
        number = (self.part << 40) | self.count
        for doc_id, start, ids, n in self.pieces:
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, number, offset))
            offset += len(ids)
        self.count, self.pieces, self.used = self.count + 1, [], 0
        return rows

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[2])

    def finish(self) -> list[tuple]:
        """The last sequence, cut at powers of two, largest first, so that none of its parts needs padding."""
        rest, rows = self.pieces, []
        left = self.used
        self.pieces, self.used = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc_id, start, ids, n = rest.pop(0)
                self.add((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    rest.insert(0, (doc_id, start + room, ids[room:], n))
                room -= min(room, len(ids))
            rows += self.close()
        return rows


def _pack(length: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Sequence | None = None
        out: list[tuple] = []
        for batch in batches:
            for part, doc_id, n, blob in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "doc_id", "n", "ids")), strict=True):
                if now is None or now.part != part:
                    out += now.finish() if now else []
                    now = _Sequence(part)
                ids, at = np.frombuffer(blob, np.uint16), 0
                while at < len(ids):
                    step = min(length - now.used, len(ids) - at)
                    now.add((doc_id, at, ids[at : at + step], n))
                    at += step
                    if now.used == length:
                        out += now.close()
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        yield _batch(out + (now.finish() if now else []))

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_PIECES_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_PIECES_ARROW)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, parts: int | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece of a document.

    Documents are laid out along a Hilbert curve through three random projections of their hashed words, so that
    neighbours share vocabulary, and their ids fill sequences of ``length`` in that order, cut wherever a sequence is
    full. A partition's last sequence is cut at powers of two, which need no padding; so no sequence does.

    The curve is range-partitioned from the bytes of text in each of its 4,096 cells, a table of fixed size. A cell that
    is too heavy for a partition, such as one large group of copies, is dealt over several by a hash of the id, or of the place
    of a row that has none.

    Args:
        docs: needs ``doc_id`` (whole numbers) and ``text``; other columns are ignored.
        tokenizer: path of a tokenizer file whose pieces do not cross white space, with fewer than 65,536 ids.
        end_id: closes every document.
        length: a power of two.
        parts: partitions of the curve; the session's number of shuffle partitions unless given.

    Defined cases: null and empty texts are documents of one id. A null ``doc_id`` is kept and packed. Repeated rows are
    each packed. A text longer than a sequence spans as many as it needs. An empty table gives an empty result.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = rows.select("text").mapInArrow(_weigh, "cell int, bytes long").groupBy("cell").agg(F.sum("bytes").alias("bytes"))
    weights = np.zeros(1 << CELL_BITS)
    for r in sums.collect():  # at most 4,096 rows
        weights[r["cell"]] = r["bytes"]
    first, ways, n_parts = _deal(weights, parts)
    tokens = rows.mapInArrow(_tokenise(tokenizer, end_id, first, ways), _TOKENS)
    dealt = tokens.repartitionById(n_parts, "part").sortWithinPartitions("part", "key", "tie", "doc_id")
    return dealt.select("part", "doc_id", "n", "ids").mapInArrow(_pack(length), _PIECES)
