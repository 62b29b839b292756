"""The node table: one row per JSON value, addressed by pointer. Read operators become filters and aggregates over it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docjson.functions.pointer import escape
from docjson.operators.read import comparable, kind_of

_SHAPE = "doc_id long, ptr string, parent_ptr string, depth int, ord int, key string, idx int, kind string, scalar string, n_children int"
_NAMES = [c.split()[0] for c in _SHAPE.split(", ")]


def native_nodes(docs: DataFrame, document: str = "json") -> DataFrame:
    """``doc_id, ptr, depth, key, idx, kind, scalar`` by a recursive query over variants, without Python.

    Levels are expanded in bulk, so order is that of depth and not of the document, and numbers are in variant form.
    ``docs(doc_id, json)``; what is no JSON has no nodes. The parser's own limit of 1,000 levels is that of the recursion. The
    session's limit on rows of a recursion, made for endless ones, is lifted: this one ends with the deepest value.
    """
    view = f"_docjson_nodes_{uuid.uuid4().hex}"
    docs.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    docs.select("doc_id", F.expr(f"try_parse_json(`{document}`)").alias("v")).filter("v is not null").createOrReplaceTempView(view)
    return docs.sparkSession.sql(f"""
        WITH RECURSIVE n(doc_id, ptr, depth, key, idx, v) MAX RECURSION LEVEL 1000 AS (
          SELECT doc_id, '', 0, CAST(NULL AS STRING), CAST(NULL AS INT), v FROM {view}
          UNION ALL
          SELECT n.doc_id, concat(n.ptr, '/', replace(replace(coalesce(c.key, CAST(c.pos AS STRING)), '~', '~0'), '/', '~1')),
            n.depth + 1, c.key, CASE WHEN c.key IS NULL THEN c.pos END, c.value
          FROM n, LATERAL variant_explode(n.v) AS c)
        SELECT doc_id, ptr, depth, key, idx,
          CASE WHEN is_variant_null(v) THEN 'null' WHEN t LIKE 'OBJECT%' THEN 'object' WHEN t LIKE 'ARRAY%' THEN 'array' WHEN t = 'STRING' THEN 'string'
            WHEN t = 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind,
          CASE WHEN is_variant_null(v) THEN 'null' WHEN t LIKE 'OBJECT%' OR t LIKE 'ARRAY%' THEN NULL ELSE CAST(v AS STRING) END AS scalar
        FROM (SELECT *, schema_of_variant(v) AS t FROM n)""")


def ordered_nodes(docs: DataFrame, document: str = "json") -> DataFrame:
    """The node table in document order, with number text as Python writes it; one Arrow pass, no shuffle.

    What is no JSON, or nested too deep for the parser, has no nodes.
    """

    def rows(doc_id: int | None, root: object) -> Iterator[tuple]:
        count = 0
        todo: list[tuple] = [("", None, 0, None, None, root)]
        while todo:
            ptr, parent, depth, key, idx, x = todo.pop()
            kind = kind_of(x)
            inner = list(x.items()) if kind == "object" else list(enumerate(x)) if kind == "array" else []
            yield doc_id, ptr, parent, depth, count, key, idx, kind, None if kind in ("object", "array") else comparable(x), len(inner)
            count += 1
            for k, v in reversed(inner):
                todo.append((f"{ptr}/{escape(k)}", ptr, depth + 1, k if kind == "object" else None, k if kind == "array" else None, v))

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]

    def pack(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    root = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    continue
                if text is None:
                    continue
                for r in rows(doc_id, root):
                    held.append(r)
                    if len(held) >= 20_000:
                        yield pack(held)
                        held = []
        yield pack(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{document}`")).mapInArrow(run, _SHAPE)


def col_leaves(document: Column) -> Column:
    """How many values of JSON text are no containers, counted in its row inside the JVM.

    Strings are shortened to one letter each, whether key or value; what is no container is then a token without a colon
    after it. Null, what is no JSON, and what the variant parser refuses (over 1,000 levels, a key twice) give null.
    """
    short = F.regexp_replace(document, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "s")
    count = F.regexp_count(short, F.lit(r"s(?!\s*:)|true|false|null|-?[0-9][0-9.eE+-]*")).cast("long")
    return F.when(F.try_parse_json(document).isNotNull(), count)


def leaf_counts(table: DataFrame) -> DataFrame:
    """``doc_id, leaves``: values that are no containers."""
    return table.groupBy("doc_id").agg(F.count_if(~F.col("kind").isin("object", "array")).alias("leaves"))


def resolve(table: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(doc_id, ptr)`` with ``found`` and, where found, the node's kind and scalar; an equi-join."""
    here = table.select("doc_id", "ptr", "kind", "scalar").withColumn("found", F.lit(True))
    return asked.join(here, ["doc_id", "ptr"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def search(table: DataFrame, query: str, by_key: bool = False, limit: int | None = None) -> DataFrame:
    """Exact search over a whole collection: ``doc_id, ptr, ...`` and whether a document's list was ``truncated``.

    ``limit`` is per document, in document order.
    """
    from pyspark.sql import Window

    hit = (F.col("key") == query) if by_key else ((F.col("scalar") == query) & (F.col("depth") > 0))
    found = table.filter(hit)
    if limit is None:
        return found.withColumn("truncated", F.lit(False))
    w = Window.partitionBy("doc_id").orderBy("ord")
    ranked = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    return ranked.withColumn("truncated", F.max("_n").over(Window.partitionBy("doc_id")) >= limit).drop("_n")
