"""Text to ordered chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes in characters, and the separators in the order they are tried.
CHUNK, OVERLAP, LEAST, PERCENTILE = 8000, 400, 500, 95.0
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
GLUE = "\n\n"
Embedding = Callable[[pd.Series], pd.Series]


def recursive_split(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does; neighbours share up to ``overlap``.

    A text that fits is one piece, as it is. Pieces keep their separator in front, are trimmed, and empty ones are left out.
    """
    if len(text) <= size:
        return [text] if text else []
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    parts = [p if i == 0 else mark + p for i, p in enumerate(text.split(mark))] if mark else list(text)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        joined = "".join(run).strip()
        if joined:
            out.append(joined)

    length = 0
    for p in parts:
        if len(p) > size:
            flush()
            run, length = [], 0
            out += recursive_split(p, size, overlap, finer or ("",))
            continue
        if length + len(p) > size:
            flush()
            while run and (length > overlap or length + len(p) > size):
                length -= len(run.pop(0))
        run.append(p)
        length += len(p)
    flush()
    return out


def merge_small(chunks: Column, least: int = LEAST) -> Column:
    """Chunks glued from the left until what is held has ``least`` characters; a short tail goes to the chunk before it.

    Native: a fold over the array, whose state is what is held and what is done.
    """
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, c: Column) -> Column:
        empty, short = s["held"] == "", F.length(s["held"]) < least
        held = F.when(empty, c).when(short, F.concat(s["held"], F.lit(GLUE), c)).otherwise(c)
        done = F.when(empty | short, s["done"]).otherwise(F.concat(s["done"], F.array(s["held"])))
        return F.struct(held.alias("held"), done.alias("done"))

    def finish(s: Column) -> Column:
        n = F.size(s["done"])
        tail = F.concat(F.element_at(s["done"], -1), F.lit(GLUE), s["held"])
        glued = F.concat(F.slice(s["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(tail))
        return F.when(s["held"] == "", s["done"]).when((n > 0) & (F.length(s["held"]) < least), glued).otherwise(F.concat(s["done"], F.array(s["held"])))

    return F.when(chunks.isNotNull(), F.aggregate(chunks, start, step, finish))


def hashed_embedding(values: pd.Series, dims: int = 64) -> pd.Series:
    """A unit vector of signed hashed word counts: the embedding where no model is given."""
    import zlib

    def one(text: str) -> list[float]:
        v = np.zeros(dims, np.float32)
        for w in (text or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dims] += 1 if h & 1 << 31 else -1
        return (v / max(float(np.linalg.norm(v)), 1e-9)).tolist()

    return values.map(one)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm).when(norm.isNotNull(), F.lit(1.0))


def breakpoints(points: DataFrame, key: str, order: str, vector: str, percentile: float = PERCENTILE) -> DataFrame:
    """``points`` with the ``distance`` of each to the one before it and whether it ``breaks``: farther than the percentile of its key."""
    w = Window.partitionBy(key).orderBy(order)
    near = points.withColumn("distance", cosine_distance(F.lag(vector).over(w), F.col(vector)))
    limit = F.percentile("distance", F.lit(percentile / 100)).over(Window.partitionBy(key))
    return near.withColumn("breaks", F.coalesce(F.col("distance") > limit, F.lit(False)))


def semantic_chunks(docs: DataFrame, embed=hashed_embedding, percentile: float = PERCENTILE, least: int = LEAST) -> DataFrame:
    """``doc_id, chunks``: sentences up to each break in meaning, short chunks glued; null and blank texts have no chunks.

    A document is one row from text to chunks, so nothing is shuffled. :func:`breakpoints` is the same over a table of points.
    """

    def split(values: pd.Series) -> pd.Series:
        return values.map(lambda t: semantic_split(t, embed, percentile, least) if t else [])

    return docs.select("doc_id", F.pandas_udf(split, "array<string>")(F.col("text")).alias("chunks"))


def semantic_split(text: str, embed: Embedding = hashed_embedding, percentile: float = PERCENTILE, least: int = LEAST) -> list[str]:
    """One text's sentences up to each break in meaning, short chunks glued as by :func:`merge_small`."""
    if not text.strip(" \t\n\r\f\v"):
        return []
    said = re.split(r"(?<=[.?!])\s+", text, flags=re.ASCII)
    points = np.array([np.asarray(v, np.float32) for v in embed(pd.Series(said))], np.float64)
    dot = lambda a, b: np.cumsum(a * b, axis=1)[:, -1]  # noqa: E731 (in order, as the columns add up)
    norm = np.sqrt(dot(points[1:], points[1:]) * dot(points[:-1], points[:-1]))
    far = np.where(norm > 0, 1 - dot(points[:-1], points[1:]) / np.where(norm > 0, norm, 1), 1.0)
    parts = [[said[0]]]
    if len(far):
        ranked, at = np.sort(far), (len(far) - 1) * (percentile / 100)
        low, high = int(np.floor(at)), int(np.ceil(at))
        limit = ranked[low] if ranked[low] == ranked[high] else (high - at) * ranked[low] + (at - low) * ranked[high]
        for sentence, breaks in zip(said[1:], far > limit, strict=True):
            if breaks:
                parts.append([])
            parts[-1].append(sentence)
    out, held = [], ""
    for chunk in (" ".join(p) for p in parts):
        if not held:
            held = chunk
        elif len(held) < least:
            held += GLUE + chunk
        else:
            out.append(held)
            held = chunk
    if held and out and len(held) < least:
        out[-1] += GLUE + held
    elif held:
        out.append(held)
    return out


def split_with_fallback(text: str, embed: Embedding | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Semantic chunks; if they fail for whatever reason, or without an embedding, those of :func:`recursive_split`."""
    if embed is not None:
        try:
            return semantic_split(text, embed)
        except Exception:  # the embedding is the caller's and can fail in any way
            pass
    return recursive_split(text, size, overlap)


def fallback_chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Pieces of :func:`recursive_split`; only texts over ``size`` cross to Python."""

    def split(values: pd.Series) -> pd.Series:
        return values.map(lambda t: recursive_split(t, size, overlap) if t is not None else None)

    long = F.when(F.length(text) > size, text)
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.length(text) > size, F.pandas_udf(split, "array<string>")(long)).when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array(text))


def chunk_documents(docs: DataFrame, embed: Embedding | None = None) -> DataFrame:
    """``doc_id, chunks, error``: chunks of every document; a null or empty text is an error.

    With an embedding, semantic chunks, and :func:`fallback_chunks` for a text on which it fails; without one, the latter.
    """

    def split(values: pd.Series) -> pd.Series:
        return values.map(lambda t: split_with_fallback(t, embed) if t else [])

    nothing = F.coalesce(F.length("text"), F.lit(0)) == 0
    chunks = fallback_chunks(F.col("text")) if embed is None else F.pandas_udf(split, "array<string>")(F.col("text"))
    return docs.select("doc_id", chunks.alias("chunks"), F.when(nothing, F.lit("No text provided for processing.")).alias("error"))


def explode_chunks(chunked: DataFrame) -> DataFrame:
    """``doc_id, chunk_idx, total, chunk``: a row per chunk."""
    return chunked.select("doc_id", F.size("chunks").alias("total"), F.posexplode("chunks").alias("chunk_idx", "chunk")).select("doc_id", "chunk_idx", "total", "chunk")


def user_message(chunk: Column, chunk_idx: Column, total: Column) -> Column:
    return F.concat(F.lit('<TextChunk index="'), (chunk_idx + 1).cast("string"), F.lit('" total="'), total.cast("string"), F.lit('">\n'), chunk, F.lit("\n</TextChunk>"))

