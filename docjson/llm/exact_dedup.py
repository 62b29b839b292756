"""Exact deduplication by content hash, with a byte comparison inside each hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs`` with the group of byte-equal texts it belongs to.

    Rows are grouped by a 128-bit content hash and, inside a hash, by the bytes themselves, so that two texts with one
    hash never share a group. Both steps are one hash aggregation: every map task first reduces its own copies to one
    row, so a group that holds a third of all rows costs one row per task. The per-row answer comes from a join on
    the pair of hashes that carries no text. Should two different texts agree in both hashes, the query stops instead
    of merging them.

    Args:
        docs: needs ``doc_id`` and ``text``; other columns are ignored, whatever their names.
        keep: ``smallest`` or ``largest`` stable id of a group stays.

    Returns:
        ``doc_id, keep_id, group_size, kept, text_sha256``.

    Defined cases: a null text counts as empty, and all empty texts form one group. A null ``doc_id`` never becomes
    ``keep_id`` unless the whole group has none. Rows repeated with the same id and text each give a row, of which one
    at most is kept. An empty table gives an empty result. Letter case, spacing and Unicode form are not touched.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    pick = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text")).select(
        "doc_id", "_text", F.unhex(F.md5("_text")).alias("_h"), F.sha2("_text", 256).alias("text_sha256")
    )
    groups = (
        rows.groupBy("_h", "text_sha256", "_text")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .groupBy("_h", "text_sha256")
        .agg(
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
            F.count(F.lit(1)).alias("_variants"),
        )
        .filter("group_size > 1 or _variants > 1")
        .withColumn(
            "group_size",
            F.when(F.col("_variants") == 1, F.col("group_size")).otherwise(
                F.raise_error(F.lit("two different texts agree in both content hashes"))
            ),
        )
        .drop("_variants")
    )
    # As a table of its own it is dealt anew for the join, which lets Spark split a large group's partition.
    groups = materialise(groups, "copies")
    # Repeated (id, text) rows are counted, so that exactly one of them can be the one that stays.
    # They are dealt by id: dealt by hash, a large group would be one task's, with a count above that forbids splitting it.
    light = rows.select("doc_id", "_h", "text_sha256").repartition("doc_id")
    ids = light.groupBy("doc_id", "_h", "text_sha256").agg(F.count(F.lit(1)).alias("_n"))
    return (
        ids.join(groups, ["_h", "text_sha256"], "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            "text_sha256",
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"),
        )
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row left of each group of byte-equal texts; all columns stay.

    The row that stays is the one of the smallest (or largest) ``doc_id``; of rows that repeat an id and text, one. Rows are
    grouped by hash and bytes as in :func:`exact_groups`, and the row that stays is carried along, so that texts move once
    and copies are reduced before they move.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in rest], F.col("text").isNull().alias("_no_text"))
    # Rows without an id stay only where no row has one; other columns break ties between repeated ids.
    known = F.col("doc_id").isNull() if keep == "smallest" else F.col("doc_id").isNotNull()
    order = F.struct(known, F.col("doc_id"), F.xxhash64(F.to_json(row)))
    pick = F.min_by if keep == "smallest" else F.max_by
    rows = docs.select(F.unhex(F.md5(text)).alias("_h"), text.alias("_text"), row.alias("_row"), order.alias("_order"))
    kept = rows.groupBy("_h", "_text").agg(pick("_row", "_order").alias("_row"))
    back = {c: F.col("_row").getField(c).alias(c) for c in rest}
    back["text"] = F.when(~F.col("_row._no_text"), F.col("_text")).alias("text")
    return kept.select(*[back[c] for c in docs.columns])
