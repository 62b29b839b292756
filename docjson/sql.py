"""The operators as SQL functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docjson.functions.schema import Schema
from docjson.functions.truncate import truncate
from docjson.operators.patch import write
from docjson.operators.read import inspect_keys, read_value, search_pointer


def _dumps(x) -> str:
    return json.dumps(x, ensure_ascii=False, default=str)


def _guarded(function, *columns) -> pd.Series:
    out = []
    for row in zip(*columns, strict=True):
        try:
            out.append(None if any(v is None for v in row) else function(*row))
        except (ValueError, RecursionError):
            out.append(None)
    return pd.Series(out, dtype=object)


def register(spark: SparkSession) -> None:
    """``json_inspect(doc, ptr)``, ``json_read(doc, request)``, ``json_search(doc, request)``, ``json_patch(doc, ops)``,
    ``json_validate(doc, schema)`` and ``json_truncate(doc, limit)``; requests, operations and schemas are JSON text.

    A null argument, or one that is no JSON or nested too deep for the parser, gives null.
    """

    def inspect(doc: pd.Series, ptr: pd.Series) -> pd.Series:
        return _guarded(lambda d, p: _dumps(inspect_keys(json.loads(d), p)), doc, ptr)

    def read(doc: pd.Series, request: pd.Series) -> pd.Series:
        return _guarded(lambda d, r: _dumps(read_value(json.loads(d), json.loads(r))), doc, request)

    def search(doc: pd.Series, request: pd.Series) -> pd.Series:
        return _guarded(lambda d, r: _dumps(search_pointer(json.loads(d), json.loads(r))), doc, request)

    def patch(doc: pd.Series, ops: pd.Series) -> pd.Series:
        return _guarded(lambda d, o: _dumps(write(json.loads(d), json.loads(o))), doc, ops)

    def validate(doc: pd.Series, schema: pd.Series) -> pd.Series:
        made: dict[str, Schema] = {}

        def one(d: str, s: str) -> str:
            if s not in made:
                made[s] = Schema(json.loads(s))
            return _dumps([{"pointer": p, "message": m} for p, m in made[s].problems(json.loads(d))])

        return _guarded(one, doc, schema)

    def cut(doc: pd.Series, limit: pd.Series) -> pd.Series:
        return _guarded(lambda d, n: truncate(json.loads(d), int(n)), doc, limit)

    for name, f in (("json_inspect", inspect), ("json_read", read), ("json_search", search), ("json_patch", patch), ("json_validate", validate), ("json_truncate", cut)):
        spark.udf.register(name, F.pandas_udf(f, "string"))
