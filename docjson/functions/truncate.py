"""Rendering a JSON value within a budget of characters.

The value is cut step by step until its rendering fits: long strings first, to the largest common length that fits; then, from
the deepest level up, arrays lose items from their middle; then objects lose keys. What is gone is shown as ``...``. The
rendering is for reading and is no JSON.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    # The defaults of the rendering.
    indent: int = 4
    string: int = 23
    ellipsis: int = 3
    items: int = 2
    keys: int = 2


@dataclass
class _Node:
    """A value under cutting. Once a container is cut, ``parts`` are those before the gap and ``after`` those behind it."""

    value: Any
    depth: int
    parts: deque[tuple[Any, _Node]] | None = None
    after: deque[tuple[Any, _Node]] | None = None
    up: _Node | None = None
    cut: int | None = None
    size: int = 0

    @classmethod
    def of(cls, x: Any, depth: int = 0, up: _Node | None = None) -> _Node:
        made = cls(x, depth, up=up)
        if isinstance(x, dict):
            made.value, made.parts = {}, deque((k, cls.of(v, depth + 1, made)) for k, v in x.items())
        elif isinstance(x, list):
            made.value, made.parts = [], deque((None, cls.of(v, depth + 1, made)) for v in x)
        return made

    def inner(self):
        yield from self.parts or ()
        yield from self.after or ()

    def walk(self):
        yield self
        for _, p in self.inner():
            yield from p.walk()

    def count(self) -> int:
        """Parts, the gap included."""
        return len(self.parts) + (0 if self.after is None else 1 + len(self.after))


class _Cutter:
    """Cuts until the rendering fits. Sizes of renderings are kept at the nodes, so a cut costs no more than its depth."""

    def __init__(self, root: _Node, limit: int, limits: Limits):
        self.root, self.limit, self.o = root, limit, limits

    def leaf(self, n: _Node) -> str:
        v = n.value
        if n.cut is not None and isinstance(v, str) and len(v) > n.cut:
            v = v[: max(0, n.cut - self.o.ellipsis)] + "..."
        return json.dumps(v, ensure_ascii=False)

    def render(self, n: _Node) -> str:
        if n.parts is None:
            return self.leaf(n)
        left, right = "{}" if isinstance(n.value, dict) else "[]"
        lines = [self._part(k, p) for k, p in n.parts]
        if n.after is not None:
            lines += ["...", *(self._part(k, p) for k, p in n.after)]
        if not lines:
            return left + right
        if lines == ["..."] and n.after is not None:
            return f"{left}...{right}"
        pad = " " * self.o.indent
        inner = ",\n".join(pad * (n.depth + 1) + x for x in lines)
        return f"{left}\n{inner}\n{pad * n.depth}{right}"

    def _part(self, key: Any, p: _Node) -> str:
        return self.render(p) if key is None else f'"{key}": {self.render(p)}'

    def _part_size(self, key: Any, p: _Node) -> int:
        return p.size if key is None else p.size + len(key) + 4

    def _frame(self, n: _Node, inner: int) -> int:
        """The size of a container whose parts, the gap included, have ``inner`` characters in all."""
        k = n.count()
        if not k:
            return 2
        if k == 1 and n.after is not None:
            return 5
        return 2 + 2 + self.o.indent * n.depth + inner + k * self.o.indent * (n.depth + 1) + 2 * (k - 1)

    def measure(self, n: _Node) -> int:
        if n.parts is None:
            n.size = len(self.leaf(n))
        else:
            inner = sum(self.measure(p) and self._part_size(k, p) for k, p in n.inner())
            n.size = self._frame(n, inner + (0 if n.after is None else 3))
        return n.size

    def fits(self) -> bool:
        return self.root.size <= self.limit

    def run(self) -> str:
        self.measure(self.root)
        if not self.fits() and not self._strings():
            self.measure(self.root)
            if not self.fits():
                self._thin(list, self.o.items) or self._thin(dict, self.o.keys)
        return self.render(self.root).replace("...,\n", "...\n")

    def _strings(self) -> bool:
        """Cut all long strings to one length, the largest that fits; whether any does."""
        long = [n for n in self.root.walk() if isinstance(n.value, str) and len(n.value) > self.o.string]
        if not long:
            return False
        rest = self.root.size - sum(n.size for n in long)

        def at(length: int) -> bool:
            total = rest
            for n in long:
                n.cut = length
                total += len(self.leaf(n))
            return total <= self.limit

        low, high = self.o.string, max(len(n.value) for n in long)
        if not at(low):
            for n in long:
                n.value, n.cut = n.value[: max(0, low - self.o.ellipsis)] + "...", None
            return False
        best = low
        while low <= high:
            middle = (low + high) // 2
            if at(middle):
                best, low = middle, middle + 1
            else:
                high = middle - 1
        at(best)
        return True

    def _thin(self, kind: type, least: int) -> bool:
        """From the deepest level up, one cut at a time in each container of a kind with more than one part; whether it fits now."""
        levels: dict[int, list[_Node]] = {}
        for n in self.root.walk():
            if isinstance(n.value, kind) and n.parts is not None and n.count() > 1:
                levels.setdefault(n.depth, []).append(n)
        for depth in sorted(levels, reverse=True):
            open_ = levels[depth]
            while open_:
                for n in open_:
                    self._cut(n, least)
                if self.fits():
                    return True
                open_ = [n for n in open_ if n.count() > 1]
        return False

    def _cut(self, n: _Node, least: int) -> None:
        k, frame = n.count(), self._frame(n, 0)
        if n.after is None:
            n.after = deque(list(n.parts)[k // 2 + 1 :])
            for _ in n.after:
                n.parts.pop()
            gone = self._part_size(*n.parts.pop()) - 3
        elif k - 1 > least:
            gone = self._part_size(*(n.parts.pop() if len(n.parts) > len(n.after) else n.after.popleft()))
            gone += 3 if k == 2 else 0  # the gap alone is part of the frame
        else:
            gone = sum(self._part_size(*p) for p in n.inner()) + 3
            n.parts.clear()
            n.after.clear()
        less = gone + frame - self._frame(n, 0)
        at: _Node | None = n
        while at is not None:
            at.size -= less
            at = at.up


def truncate(data: Any, limit: int, limits: Limits | None = None) -> str:
    """``data`` rendered in at most ``limit`` characters, or as few as its smallest rendering has."""
    return "null" if data is None else _Cutter(_Node.of(data), limit, limits or Limits()).run()


def json_truncate(document: Column, limit: int, limits: Limits | None = None) -> Column:
    """:func:`truncate` of JSON text, Arrow-batched; null, what is no JSON and what is nested too deep for the parser give null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else truncate(json.loads(text), limit, limits)
        except (ValueError, RecursionError):
            return None

    def batch(values: pd.Series) -> pd.Series:
        return values.map(one)

    return F.pandas_udf(batch, "string")(document)
