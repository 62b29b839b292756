"""Toxic passages as maximal scoring segments, with extreme-value calibration of the document's score."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .worker import trimmed

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = range(3, 9)
#: Words whose score a worker remembers.
_CACHE = 400_000
_EULER = 0.5772156649015329
#: The surprise of a text without any segment.
_NONE = -10.0


@dataclass(frozen=True)
class Model:
    """Tokens' log odds and evidence (|z|), what every token costs, and the calibration."""

    scores: dict[str, tuple[float, float]]
    cost: float
    lam: float
    log_k: float
    weights: tuple[float, ...]
    significant: float

    def dump(self) -> str:
        return json.dumps(asdict(self))


def features(word: str) -> list[str]:
    """A word, and its beginnings, which stand for words that share a stem."""
    return [word, *[f"{word[:n]}*" for n in _PREFIXES if n < len(word)]]


def maximal_segments(at: list[int], before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence, from the places with a positive score and the sums before and after each.

    The linear-time scan keeps a list of disjoint candidates with the cumulative score before and after each. A new
    candidate is joined with the nearest earlier one that starts lower and ends lower than it. Each candidate knows the nearest
    earlier one that starts lower than itself, so that a search skips all between; whoever is skipped by a lower start is
    never looked at again. Returns first place, last place and score, by place.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest that starts lower
    for place, low, high in zip(at, before, after, strict=True):
        first, j = place, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            first, low = found[j][0], found[j][2]
            below = found[j][4]
            del found[j:]
            j = below
        found.append((first, place, low, high, j))
    return [(a, b, h - lo) for a, b, lo, h, _ in found]


class _Scorer:
    def __init__(self, model: Model):
        self.m, self.cache = model, {}

    def word(self, w: str) -> float:
        """The log odds of the word or of the beginning that has the most evidence, less what every token costs."""
        s = self.cache.get(w)
        if s is None:
            known = self.m.scores
            s = max(((z, v) for f in features(w) if (e := known.get(f)) is not None for v, z in (e,)), default=(0.0, 0.0))[1] - self.m.cost
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            self.cache[w] = s
        return s

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        words = _WORD.findall(text.lower())
        cached, word = self.cache.get, self.word
        values = np.array([s if (s := cached(w)) is not None else word(w) for w in words])
        at = np.flatnonzero(values > 0)
        after = np.cumsum(values)
        return maximal_segments(at.tolist(), (after[at] - values[at]).tolist(), after[at].tolist()), len(words)

    def surprises(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """The segments with the Gumbel variable of each in a text of its length, and the number of words; over 3 is rarer than one in twenty."""
        segments, n = self.segments(text)
        less = self.m.log_k + math.log(max(n, 1))
        return [(a, b, self.m.lam * s - less) for a, b, s in segments], n

    def summary(self, text: str) -> tuple[float, float, int, int, list[tuple[int, int, float]]]:
        """Largest surprise, sum of the significant ones, their number, words, and the significant segments."""
        rated, n = self.surprises(text)
        sure = [r for r in rated if r[2] >= self.m.significant]
        return max((r[2] for r in rated), default=_NONE), sum(r[2] for r in sure), len(sure), n, sure


def _inputs(best: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.column_stack([np.ones(len(n)), np.clip(best, _NONE, 30) / 10, np.log1p(total), total / np.sqrt(n), np.log(n) / 10, (best > _NONE).astype(float)])


def probability(weights: tuple[float, ...], best: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(best, total, n) @ np.asarray(weights), -30, 30)))


@trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each feature in toxic and in other texts, a word once a text: what one text repeats is no evidence. Partial counts."""
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out: dict[str, list[int]] = {}
        for w, (clean, toxic) in counts.items():
            for f in features(w):
                c = out.setdefault(f, [0, 0])
                c[0] += clean
                c[1] += toxic
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([c[1] for c in out.values()], pa.int64()), pa.array([c[0] for c in out.values()], pa.int64())], names=["feature", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in set(_WORD.findall((text or "").lower())):
                counts.setdefault(w, [0, 0])[toxic] += 1
            if len(counts) > 100_000:
                yield flush()
    yield flush()


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 30_000, prior: float = 0.02, doubt: float = 0.5, least_z: float = 3.0, cost: float = 0.05) -> Model:
    """Learn token scores and their calibration from labelled documents.

    A token's score is the log odds ratio between toxic and other texts under a Dirichlet prior in proportion to the token's
    overall frequency, whichever its sign. Which tokens have one is decided under a heavier prior of the same kind: those
    whose |z| is ``least_z`` or more; all others count as even. Each token costs ``cost``, and more if clean text would not lose
    on average otherwise. The rate (lambda) of the extreme-value law that the best segments of clean text follow comes from the
    scores of clean tokens, prior included, its scale (K) from the segments; a logistic regression maps the surprise of a
    document's segments to a probability.

    Args:
        docs, labels: ``doc_id, text`` and ``doc_id, toxic``; rows without a label, id or partner are not used.
        most_labelled: at most so many labelled documents are used, those of the smallest hash of their id. This bounds
            the fit at every input size.
        prior, doubt: weights of the two Dirichlet priors, as shares of the tokens counted.
    """
    picked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked.select(F.col("doc_id").alias("_id"), "toxic")), F.col("doc_id") == F.col("_id"))
    sample = materialise(sample.select("text", F.least(F.col("toxic"), F.lit(1)).alias("toxic")), "labelled")
    counts = sample.mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0"))
    counts = materialise(counts, "features")
    words = counts.filter(~F.col("feature").endswith("*"))
    n1, n0 = (float(x or 0) for x in words.agg(F.sum("y1"), F.sum("y0")).first())
    if not n1 or not n0:
        return Model({}, 0.1, 1.0, 0.0, (-3.0, 0.0, 0.0, 0.0, 0.0, 0.0), 3.0)

    def odds(weight: float) -> tuple[Column, Column, Column]:
        """Log odds ratio under a prior of so many tokens per token counted, its z, and the prior's share of each token."""
        a0, a = weight * (n1 + n0), (F.col("y1") + F.col("y0")) * weight
        ratio = F.log((F.col("y1") + a) / (n1 + a0 - F.col("y1") - a)) - F.log((F.col("y0") + a) / (n0 + a0 - F.col("y0") - a))
        return ratio, ratio / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a)), a

    _, z, _ = odds(doubt)
    ratio, _, a = odds(prior)
    told = counts.select("feature", ratio.alias("score"), F.abs(z).alias("z")).filter(F.col("z") >= least_z)
    scores = {r["feature"]: (r["score"], r["z"]) for r in told.collect()}
    start = Model(scores, 0.0, 1.0, 0.0, (0.0,) * 6, 3.0)
    spread = _spread(words.select("feature", (F.col("y0") + a).alias("n")), start)
    mean = sum(v * c for v, c in spread.items()) / max(sum(spread.values()), 1)
    cost = max(cost, mean + 0.05)
    lam = _rate({v - cost: n for v, n in spread.items()})
    seen = _surprises(sample, Model(scores, cost, lam, 0.0, (0.0,) * 6, 3.0))
    log_k = seen.filter(f"y = 0 and best > {_NONE}").agg(F.avg("best")).first()[0]
    log_k = 0.0 if log_k is None else log_k - _EULER
    final = Model(scores, cost, lam, log_k, (0.0,) * 6, 3.0)
    best = F.when(F.col("best") > _NONE, F.col("best") - log_k).otherwise(F.lit(_NONE))
    sure = F.filter(F.transform("rated", lambda v: v - log_k), lambda v: v >= final.significant)
    rows = seen.select("y", best.alias("best"), F.aggregate(sure, F.lit(0.0), lambda s, v: s + v).alias("total"), "n").collect()
    x = np.array([tuple(r) for r in rows], float).reshape(-1, 4)
    return Model(scores, cost, lam, log_k, _logistic(_inputs(x[:, 1], x[:, 2], x[:, 3]), x[:, 0]), 3.0)


def _spread(words: DataFrame, model: Model) -> dict[float, float]:
    """How much of the other texts, prior included, has each score, to a hundredth."""
    dumped = model.dump()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, seen = _load(dumped), {}
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = round(scorer.word(w), 2)
                seen[s] = seen.get(s, 0.0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.float64())], names=["s", "n"])

    rows = words.mapInArrow(run, "s double, n double").groupBy("s").agg(F.sum("n").alias("n"))
    return {r["s"]: r["n"] for r in rows.collect()}


def _rate(spread: dict[float, float]) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1, by bisection."""
    total = sum(spread.values())
    s = np.array(list(spread))
    p = np.array(list(spread.values())) / max(total, 1)
    if not (p[s > 0] > 0).any():
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(80):
        lam = (low + high) / 2
        low, high = (lam, high) if float((p * np.exp(np.minimum(lam * s, 600.0))).sum()) < 1 else (low, lam)
    return low


def _surprises(sample: DataFrame, model: Model) -> DataFrame:
    """``y, best, n, rated``: label, largest surprise, words, and all surprises of each labelled text."""
    dumped = model.dump()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _load(dumped)
        for batch in batches:
            rows = [scorer.surprises(t or "") for t in batch.column(0).to_pylist()]
            rated = [[v for _, _, v in r] for r, _ in rows]
            columns = [[max(r, default=_NONE) for r in rated], [float(n) for _, n in rows]]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), *[pa.array(c, pa.float64()) for c in columns], pa.array(rated, pa.list_(pa.float64()))], names=["y", "best", "n", "rated"])

    return materialise(sample.mapInArrow(run, "y double, best double, n double, rated array<double>"), "surprises")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _load(dumped: str) -> _Scorer:
    raw = json.loads(dumped)
    return _Scorer(Model(**raw | {"weights": tuple(raw["weights"]), "scores": {w: tuple(e) for w, e in raw["scores"].items()}}))


_OUT = "score double, n_passages int, best double, passages array<struct<first:int,last:int,surprise:double>>"


def score(docs: DataFrame, model: Model, without_text: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``n_passages``, ``best`` (surprise of the best segment) and ``passages``.

    A passage is a significant maximal segment, in word places of the whole text (runs of letters, first and last
    inclusive). All columns of ``docs`` stay (but the text, if so asked), in place of any of the same names.

    Defined cases: null and empty texts get the score of a text without toxic words. Repeated rows get equal scores. Ties
    between segments are kept, each as its own passage. An empty table gives an empty result. The scan is linear in the
    text and holds one text at a time.
    """
    dumped = model.dump()
    keep = [c for c in docs.columns if c not in ("score", "n_passages", "best", "passages")]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _load(dumped)
        out = [c for c in keep if not (without_text and c == "text")]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("surprise", pa.float64())]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            rows = [scorer.summary(t or "") for t in texts]
            best, total, n = (np.array([r[i] for r in rows], float) for i in (0, 1, 3))
            p = probability(scorer.m.weights, best, total, n) if rows else np.zeros(0)
            more = [pa.array(p, pa.float64()), pa.array([r[2] for r in rows], pa.int32()), pa.array(best, pa.float64()), pa.array([[{"first": a, "last": b, "surprise": s} for a, b, s in r[4]] for r in rows], kind)]
            yield pa.RecordBatch.from_arrays([*[batch.column(keep.index(c)) for c in out], *more], names=[*out, "score", "n_passages", "best", "passages"])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if not (without_text and f.name == "text"))
    return kept.mapInArrow(run, f"{columns}, {_OUT}")


def held_out(doc_id: str = "doc_id", of: int = 4, remainder: int = 2):
    """Whether crc32 of the id as text leaves that remainder; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of) == remainder


def rate_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """:func:`fit` on the labels of rows that are not held out, then :func:`score` on all of ``docs``."""
    model = fit(docs, labels.filter(~held_out()), **options)
    rated = score(docs.select("doc_id", "text"), model, without_text=True)
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "best")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold; all columns stay."""
    model = fit(docs, labels.filter(~held_out()), **options)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    inner = docs.select(F.struct(*columns).alias("_row"), F.col("text"))
    return score(inner, model, without_text=True).filter(F.col("score") < threshold).select("_row.*")
