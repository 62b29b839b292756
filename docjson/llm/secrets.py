"""Secret scanning: rules, and a small character convolutional network over every candidate and what surrounds it."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{8,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What the network looks at: runs of key letters that are longer than words are, or do not look like words.
_RUN = re.compile(r"[A-Za-z0-9+/_=.@-]{8,}")
_LONG = 16
_UNLIKE_A_WORD = re.compile(r"[0-9+/_=]|(?<=[a-z])[A-Z]|[A-Z]{4}(?=.*[a-z])")
KINDS = ("assign", "access", "hex", "model")
#: Characters before, of, and after a candidate in a window; a longer candidate has overlapping windows from end to end.
BEFORE, INSIDE, AFTER = 24, 48, 8
STEP = INSIDE // 2
_WIDTH = BEFORE + INSIDE + AFTER
_ALPHABET = "\0 " + string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_.=-@:\"'#\n"
_CODE = {c: i for i, c in enumerate(_ALPHABET)}
_OTHER = len(_ALPHABET)
_MARK = _OTHER + 1  # offset of the codes inside the candidate, so that the network knows where it is
_CODES = 2 * _MARK


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the rules find, by start and then by kind; leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _is_candidate(run: str) -> bool:
    return len(run) >= _LONG or bool(_UNLIKE_A_WORD.search(run))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of eight or more key letters: all of sixteen or more, and those with a digit, a sign or capitals within."""
    return [m.span() for m in _RUN.finditer(text) if _is_candidate(m[0])]


class Covered:
    """Where any span of a text is, as disjoint stretches; looked up by place."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def rest(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """The parts of a run that are not covered and are candidates by themselves."""
        out, at, i = [], start, bisect_right(self.ends, start)
        while i < len(self.starts) and self.starts[i] < end:
            out.append((at, self.starts[i]))
            at = self.ends[i]
            i += 1
        return [(a, b) for a, b in [*out, (at, end)] if b - a >= 8 and _is_candidate(text[a:b])]


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """The windows' parts of a candidate: itself, or pieces of ``INSIDE`` characters that overlap by half."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in range(start, end - INSIDE, STEP)] + [(end - INSIDE, end)]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate, or a piece of one, and its surroundings, at fixed places."""
    get = _CODE.get
    left = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inner = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    right = text[end : end + AFTER].ljust(AFTER, "\0")
    return np.array([*[get(c, _OTHER) for c in left], *[get(c, _OTHER) + _MARK for c in inner], *[get(c, _OTHER) for c in right]], np.int64)


@dataclass
class Network:
    """Embedding, two convolutions with rectifiers, maximum and mean over places, and a logistic output.

    ``scale`` and ``shift`` calibrate the output on examples set aside; ``threshold`` is the largest calibrated probability at
    which the required recall is kept on them.
    """

    embed: np.ndarray
    conv1: np.ndarray
    bias1: np.ndarray
    conv2: np.ndarray
    bias2: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def new(cls, seed: int = 5, dim: int = 8, first: int = 16, second: int = 24) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.normal(size=s) * math.sqrt(2 / s[0])).astype(np.float32)
        return cls((r.normal(size=(_CODES, dim)) * 0.3).astype(np.float32), draw(5 * dim, first), np.zeros(first, np.float32), draw(3 * first, second), np.zeros(second, np.float32), draw(2 * second, 1) * 0.5, np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv1, self.bias1, self.conv2, self.bias2, self.out, self.bias]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.embed[x]
        u = _unfold(e, 5)
        h = np.maximum(u @ self.conv1 + self.bias1, 0)
        v = _unfold(h, 3)
        g = np.maximum(v @ self.conv2 + self.bias2, 0)
        top = g.argmax(1)
        pooled = np.concatenate([np.take_along_axis(g, top[:, None], 1)[:, 0], g.mean(1)], 1)
        return (pooled @ self.out + self.bias)[:, 0], (e, u, h, v, g, top, pooled)

    def probability(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z, (e, u, h, v, g, top, pooled) = self.forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(self.out.dtype)[:, None]
        d_out, d_bias = pooled.T @ d, d.sum(0)
        d_pool = d @ self.out.T
        n = g.shape[2]
        d_g = np.repeat(d_pool[:, None, n:] / g.shape[1], g.shape[1], 1)
        np.put_along_axis(d_g, top[:, None], np.take_along_axis(d_g, top[:, None], 1) + d_pool[:, None, :n], 1)
        d_g *= g > 0
        d_c2, d_b2 = v.reshape(-1, v.shape[2]).T @ d_g.reshape(-1, n), d_g.sum((0, 1))
        d_h = _fold(d_g @ self.conv2.T, 3, h.shape) * (h > 0)
        d_c1, d_b1 = u.reshape(-1, u.shape[2]).T @ d_h.reshape(-1, h.shape[2]), d_h.sum((0, 1))
        d_e = _fold(d_h @ self.conv1.T, 5, e.shape)
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, x.ravel(), d_e.reshape(-1, e.shape[2]))
        return [d_embed, d_c1, d_b1, d_c2, d_b2, d_out, d_bias]

    def dump(self) -> str:
        return json.dumps([*[p.tolist() for p in self.params()], self.scale, self.shift, self.threshold])

    @classmethod
    def load(cls, dumped: str) -> Network:
        raw = json.loads(dumped)
        return cls(*[np.array(p, np.float32) for p in raw[:7]], *raw[7:])


def _unfold(x: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` neighbours of each place, side by side."""
    return np.concatenate([x[:, i : x.shape[1] - width + 1 + i] for i in range(width)], 2)


def _fold(d: np.ndarray, width: int, shape: tuple) -> np.ndarray:
    out = np.zeros(shape, d.dtype)
    step, n = shape[2], d.shape[1]
    for i in range(width):
        out[:, i : i + n] += d[:, :, i * step : (i + 1) * step]
    return out


def train(x: np.ndarray, y: np.ndarray, recall: float = 0.98, epochs: int = 6, seed: int = 5) -> Network:
    """Adam on the cross-entropy, then calibration and threshold, each on a sixth of the examples that nothing else sees.

    The threshold is the largest at which the required share of the secrets among them is found, however low that is.
    """
    r = np.random.default_rng(seed)
    order = r.permutation(len(x))
    aside, judged, used = np.split(order, [len(x) // 6, 2 * (len(x) // 6)])
    net = Network.new(seed)
    first, second, t = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    for _ in range(epochs):
        for i in range(0, len(used), 64):
            rows = used[i : i + 64]
            t += 1
            for p, g, m, v in zip(net.params(), net.gradients(x[rows], y[rows]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 4e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        r.shuffle(used)
    z = np.concatenate([np.zeros(0), *[net.forward(x[aside[i : i + 512]])[0] for i in range(0, len(aside), 512)]]).astype(float)
    a, b = 1.0, 0.0
    for _ in range(200 if len(z) else 0):  # Platt's sigmoid, a little held back
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d = p - y[aside]
        a, b = a - 0.05 * ((d * z).mean() + 0.01 * (a - 1)), b - 0.05 * (d.mean() + 0.01 * b)
    net.scale, net.shift = float(a), float(b)
    good = np.sort(net.probability(x[judged])[y[judged] > 0.5])
    net.threshold = float(good[int((1 - recall) * len(good))]) if len(good) else 0.5
    return net


def invented_findings(n: int, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """``(text, start, end, label)`` from templates: keys of the usual forms, and look-alikes that are none."""
    r = random.Random(seed)
    some = lambda letters, k: "".join(r.choices(letters, k=k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    word = lambda: "".join(r.choices(["th", "er", "on", "an", "re", "ti", "es", "st", "en", "at", "ion", "ing"], k=r.randint(1, 4)))
    keys = [
        lambda: some(hexa, r.choice([32, 40, 64])), lambda: some(hexa, r.choice([32, 40])).upper(), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
        lambda: some(alnum, r.randint(24, 48)), lambda: "ghp_" + some(alnum, 36), lambda: "sk-" + some(alnum, r.randint(32, 48)), lambda: some(alnum + "+/", 42) + "==",
    ]
    others = [
        lambda: some(string.digits, 16), lambda: f"{word()}.{r.randint(10, 99)}@mail{r.randint(0, 9)}.example.com", lambda: f"{word()}{r.randint(1, 999)}.{word()}.example.org",
        lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 99)}-{word()}", lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{word()}-{word()}", lambda: f"{word()}/{word()}/{word()}{r.randint(0, 9)}/{word()}",
        lambda: ".".join(str(r.randint(10, 255)) for _ in range(5)), lambda: some(string.digits, r.randint(17, 24)), lambda: f"{word().title()}{word()}{word()}{word()}{r.randint(1, 9)}" + "=" * r.randint(0, 9),
        lambda: f"{word()}{word()}{r.randint(10, 99999)}", lambda: f"{word()}{word().title()}{word().title()}", lambda: "".join(word() for _ in range(r.randint(3, 8))), lambda: "".join(word() for _ in range(r.randint(2, 5))).upper(),
        lambda: f"{word()}_{word()}_{word()}", lambda: f"{word()}{word()}={r.randint(0, 9999)}.{r.randint(0, 99)}",
    ]
    near = lambda: r.choice(others)() if r.random() < 0.3 else word()  # noqa: E731 (look-alikes come in rows)
    names = ["key", "auth", "bearer", "client_secret", "credential", "access", "pwd", "token", "secret"]
    out = []
    for i in range(n):
        label = i % 2
        inner = r.choice(keys if label else others)()
        lead = " ".join(near() for _ in range(r.randint(0, 5)))
        if label and r.random() < 0.5:
            lead += f" {r.choice(names)}{r.choice([' = ', '=', ': ', ' '])}{r.choice(['', chr(34)])}"
        elif lead:
            lead += " "
        tail = r.choice(["", " ", '"', "###", "!!", "."]) + " ".join(near() for _ in range(2))
        out.append((lead + inner + tail, len(lead), len(lead) + len(inner), label))
    return out


def labelled_windows(docs: DataFrame, most_each: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of candidates in the corpus: what a finding of the rules touches is a secret, all else is not.

    At most ``most_each`` of either label are used, those of the smallest hash of their text, which bounds the fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task keeps the smallest hashes it has seen, so what it holds and sends is bounded too.
        best: dict[int, dict[int, list[int]]] = {0: {}, 1: {}}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spots = candidates(text or "")
                if not spots:
                    continue
                sure = Covered(base_spans(text))
                for a, b in (p for spot in spots for p in pieces(*spot)):
                    label = int(sure.touches(a, b))
                    w = window(text, a, b)
                    best[label][int.from_bytes(hashlib.blake2b(w.tobytes(), digest_size=7).digest())] = w.tolist()
                for label, kept in best.items():
                    if len(kept) > 4 * most_each:
                        best[label] = dict(sorted(kept.items())[:most_each])
        rows = [(label, h, w) for label, kept in best.items() for h, w in sorted(kept.items())[:most_each]]
        columns = zip(*rows, strict=True) if rows else [(), (), ()]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["label", "h", "w"])

    found = materialise(docs.select("text").mapInArrow(run, "label int, h long, w array<long>"), "findings")
    x, y = [], []
    for label in (0, 1):
        rows = found.filter(F.col("label") == label).select("h", "w").distinct().orderBy("h").limit(most_each).collect()
        x += [r["w"] for r in rows]
        y += [label] * len(rows)
    return np.array(x, np.int64).reshape(-1, _WIDTH), np.array(y, np.float32)


def fit(docs: DataFrame, most_each: int = 600, invented: int = 2400, recall: float = 0.98) -> Network:
    """A network from the corpus' own labelled findings and from invented ones.

    The name before a corpus finding is blanked in half of the examples, so that the network learns the look of a key
    and not only the word that the rules go by.
    """
    x, y = labelled_windows(docs, most_each)
    blank = np.random.default_rng(3).random(len(x)) < 0.5
    x[np.ix_(blank, np.arange(BEFORE))] = _CODE[" "]
    made = invented_findings(invented)
    more = np.array([window(t, a, b) for t, a, b, _ in made], np.int64).reshape(-1, _WIDTH)
    return train(np.concatenate([x, more]), np.concatenate([y, np.array([m[3] for m in made], np.float32)]), recall)


def scan(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, spans``: all findings of every row, as ``kind, start, end, score``, in code points, end exclusive.

    The network scores every candidate and every finding of the rules, piece by piece. Findings of the rules (``assign``,
    ``access``, ``hex``) always stay, whatever their score. Of the parts of candidates that no rule covers, the pieces
    that reach the threshold are ``model``, and those that touch are one finding; a finding's score is its best piece's.

    Defined cases: null and empty texts have no findings. A null ``doc_id`` stays null. Repeated rows get equal findings. Of
    findings with one start, the kinds come in the order above. A run of any length is scored from end to end. An empty
    table gives an empty result.
    """
    dumped = network.dump()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(dumped)
        for batch in batches:
            asked: list[tuple[int, str, int, int, list[tuple[int, int]]]] = []
            windows: list[np.ndarray] = []
            scores: list[np.ndarray] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                sure = base_spans(text)
                covered = Covered(sure)
                found = sure + [("model", *part) for c in candidates(text) for part in covered.rest(text, *c)]
                for k, a, b in found:
                    asked.append((i, k, a, b, pieces(a, b)))
                    for piece in asked[-1][4]:
                        windows.append(window(text, *piece))
                        if len(windows) == 4096:  # however long a text or a run is, no more is held
                            scores.append(net.probability(np.stack(windows)))
                            windows = []
            if windows:
                scores.append(net.probability(np.stack(windows)))
            p, at = np.concatenate([np.zeros(0), *scores]), 0
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, k, a, b, parts in asked:
                mine = p[at : at + len(parts)]
                at += len(parts)
                rows[i] += [{"kind": k, "start": a, "end": b, "score": float(mine.max())}] if k != "model" else _touching(parts, mine, net.threshold)
            for r in rows:
                r.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def _touching(parts: list[tuple[int, int]], scores: np.ndarray, threshold: float) -> list[dict]:
    out: list[dict] = []
    for (a, b), p in zip(parts, scores, strict=True):
        if p < threshold:
            continue
        if out and a <= out[-1]["end"]:
            out[-1] |= {"end": b, "score": max(out[-1]["score"], float(p))}
        else:
            out.append({"kind": "model", "start": a, "end": b, "score": float(p)})
    return out


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``: counts and fingerprints of :func:`scan`'s findings."""
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(write(base), 256).alias("base_sha256"), write(F.col("spans")).alias("spans"))
