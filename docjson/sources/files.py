"""Texts and schemas in, JSON out."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inline(spark: SparkSession, *texts: str) -> DataFrame:
    """``doc_id, text`` from strings at hand."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text, file``: a row per file; the id is a hash of the file's name, so that it stays the same."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("file"))
    return whole.select(F.xxhash64("file").alias("doc_id"), "text", "file")


def schema_file(spark: SparkSession, path: str) -> dict[str, Any]:
    """A schema from a file; ValueError if it is no JSON object."""
    raw = spark.read.text(path, wholetext=True).first()
    found = json.loads(raw[0]) if raw else None
    if not isinstance(found, dict):
        raise ValueError(f"no JSON object in {path}")
    return found


def write_json(extracted: DataFrame, path: str, column: str = "json") -> None:
    """One document per line."""
    extracted.select(F.col(column).alias("value")).write.text(path)


def pretty(document: str, indent: int | None = 2) -> str:
    return json.dumps(json.loads(document), indent=indent, ensure_ascii=False)
