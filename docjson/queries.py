"""Queries over the operators, and what DuckDB's SQL has for each."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docjson.functions import formats, pointer
from docjson.functions.schema import problem_count
from docjson.functions.truncate import json_truncate
from docjson.operators import chunking, messages, nodes, patch, read
from docjson.plans.extract import ScriptedPlanner, extract_documents, latest_guidance
from docjson.plans.progress import extract_events, progress
from docjson.plans.progress import result_counts as result_counts_of
from docjson.settings import Settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, json``: each customer with an array of their orders, whole numbers and strings only."""
    orders = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))).alias("orders")
    )
    c = _t(spark, sf, "customer").join(orders, "c_custkey", "left")
    body = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.coalesce("orders", F.array()).alias("orders"))
    return c.select(F.col("c_custkey").alias("doc_id"), F.to_json(body).alias("json"))


_CUSTOMERS = """
c AS (SELECT c_custkey AS doc_id, c_name AS name, c_mktsegment AS segment FROM customer),
o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus, o_orderpriority) - 1 AS i FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
"""

# Pointers.


@query("""SELECT p_partkey, '/' || replace(replace(k, '~', '~0'), '/', '~1') AS ptr, k AS token, 1 AS depth FROM (SELECT p_partkey, p_brand || '/~' || p_type AS k FROM part)""")
def pointer_codec(spark: SparkSession, sf: str) -> DataFrame:
    token = F.concat("p_brand", F.lit("/~"), "p_type")
    ptr = pointer.col_join(F.lit(""), token)
    return _t(spark, sf, "part").select("p_partkey", ptr.alias("ptr"), pointer.col_tokens(ptr)[0].alias("token"), F.size(pointer.col_tokens(ptr)).alias("depth"))


@query("""SELECT n_nationkey, 'a%20b+c/' || n_name AS token, CASE WHEN n_nationkey % 2 = 0 THEN 2 END AS strict, 2 AS lenient FROM nation""")
def pointer_dialects(spark: SparkSession, sf: str) -> DataFrame:
    slash = F.when(F.col("n_nationkey") % 2 == 0, "/").otherwise("")
    path = F.concat(slash, F.lit("x/"), "n_name")
    coded = F.concat(F.lit("a%2520b+c~1"), "n_name")
    return _t(spark, sf, "nation").select("n_nationkey", pointer.col_unescape_url(coded).alias("token"), F.size(pointer.col_tokens(path)).alias("strict"), F.size(pointer.col_tokens(path, lenient=True)).alias("lenient"))


@query(f"""WITH {_CUSTOMERS} SELECT c.doc_id, '/orders/0/status' AS ptr, o.s IS NOT NULL AS found, CASE WHEN o.s IS NOT NULL THEN 'string' END AS kind, o.s AS scalar
FROM c LEFT JOIN o ON c.doc_id = o.doc_id AND o.i = 0""")
def pointer_resolve(spark: SparkSession, sf: str) -> DataFrame:
    docs = _customers(spark, sf)
    asked = docs.select("doc_id", F.lit("/orders/0/status").alias("ptr"))
    return nodes.resolve(nodes.native_nodes(docs), asked)


# Node table.

_NODES = f"""WITH {_CUSTOMERS}, n AS (
SELECT doc_id, '' AS ptr, 0 AS depth, 'object' AS kind, NULL AS scalar FROM c
UNION ALL SELECT doc_id, '/name', 1, 'string', name FROM c UNION ALL SELECT doc_id, '/segment', 1, 'string', segment FROM c
UNION ALL SELECT doc_id, '/orders', 1, 'array', NULL FROM c
UNION ALL SELECT doc_id, '/orders/' || i, 2, 'object', NULL FROM o
UNION ALL SELECT doc_id, '/orders/' || i || '/key', 3, 'number', CAST(k AS VARCHAR) FROM o
UNION ALL SELECT doc_id, '/orders/' || i || '/status', 3, 'string', s FROM o
UNION ALL SELECT doc_id, '/orders/' || i || '/priority', 3, 'string', p FROM o)
"""


@query(_NODES + "SELECT doc_id, ptr, depth, kind, scalar FROM n")
def node_table(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.native_nodes(_customers(spark, sf)).select("doc_id", "ptr", "depth", "kind", "scalar")


@query(_NODES + """, x AS (SELECT *, CASE ptr WHEN '' THEN 0 WHEN '/name' THEN 1 WHEN '/segment' THEN 2 WHEN '/orders' THEN 3 ELSE
  4 + 4 * CAST(split_part(ptr, '/', 3) AS INTEGER) + CASE split_part(ptr, '/', 4) WHEN '' THEN 0 WHEN 'key' THEN 1 WHEN 'status' THEN 2 ELSE 3 END END AS ord FROM n)
SELECT doc_id, ptr, ord, depth, kind, scalar FROM x""")
def node_table_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.ordered_nodes(_customers(spark, sf)).select("doc_id", "ptr", "ord", "depth", "kind", "scalar")


@query(_NODES + "SELECT doc_id, count(*) FILTER (kind NOT IN ('object', 'array')) AS leaves FROM n GROUP BY doc_id")
def leaf_count(spark: SparkSession, sf: str) -> DataFrame:
    return _customers(spark, sf).select("doc_id", nodes.col_leaves(F.col("json")).alias("leaves"))


@query(_NODES + "SELECT doc_id, count(*) FILTER (kind NOT IN ('object', 'array')) AS leaves FROM n GROUP BY doc_id")
def leaf_count_of_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.leaf_counts(nodes.native_nodes(_customers(spark, sf)))


# Read operators.


@query(f"""WITH {_CUSTOMERS} SELECT c.doc_id, 'object' AS kind, 3 AS count, 'name,segment,orders' AS keys FROM c""")
def inspect_keys_root(spark: SparkSession, sf: str) -> DataFrame:
    seen = _customers(spark, sf).select("doc_id", F.from_json(read.json_inspect(F.col("json")), "type string, count int, keysPreview array<string>").alias("r"))
    return seen.select("doc_id", F.col("r.type").alias("kind"), "r.count", F.array_join("r.keysPreview", ",").alias("keys"))


@query(f"""WITH {_CUSTOMERS} SELECT c.doc_id, CAST(count(o.k) AS INTEGER) AS length, CAST(least(count(o.k), 20) AS INTEGER) AS previewed, count(o.k) > 20 AS truncated
FROM c LEFT JOIN o ON c.doc_id = o.doc_id GROUP BY c.doc_id""")
def inspect_array_length(spark: SparkSession, sf: str) -> DataFrame:
    seen = _customers(spark, sf).select("doc_id", F.from_json(read.json_inspect(F.col("json"), "/orders"), "length int, previewCount int, truncated boolean").alias("r"))
    return seen.select("doc_id", "r.length", F.col("r.previewCount").alias("previewed"), "r.truncated")


@query("SELECT event_id, false AS found, 'object' AS container, 'k' AS keys FROM events")
def inspect_missing_key(spark: SparkSession, sf: str) -> DataFrame:
    seen = _t(spark, sf, "events").select("event_id", F.from_json(read.json_inspect(F.col("props"), "/nope"), "found boolean, containerType string, availableKeysPreview array<string>").alias("r"))
    return seen.select("event_id", "r.found", F.col("r.containerType").alias("container"), F.array_join("r.availableKeysPreview", ",").alias("keys"))


@query("""SELECT doc_id, CASE WHEN length(text) > 160 THEN left(text, 160) || '…' ELSE text END AS value, length(text) > 160 AS cut, CAST(length(text) AS INTEGER) AS length FROM documents WHERE text IS NOT NULL""")
def read_value_string(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").filter("text is not null")
    got = docs.select("doc_id", F.from_json(read.json_read(F.to_json(F.struct("text")), "/text"), "value string, valueTruncated boolean, stats struct<length:int,originalLength:int>").alias("r"))
    return got.select("doc_id", "r.value", F.col("r.valueTruncated").alias("cut"), F.coalesce("r.stats.length", "r.stats.originalLength").alias("length"))


@query(f"""WITH {_CUSTOMERS}, f AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY i) FILTER (i < 5) AS keys FROM o GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS original, CAST(least(coalesce(n, 0), 5) AS INTEGER) AS returned, coalesce(n, 0) > 5 AS cut, coalesce(keys, '') AS keys FROM c LEFT JOIN f ON c.doc_id = f.doc_id""")
def read_value_array_cut(spark: SparkSession, sf: str) -> DataFrame:
    shape = "value array<struct<key:long>>, valueTruncated boolean, stats struct<originalLength:int,returnedLength:int>"
    got = _customers(spark, sf).select("doc_id", F.from_json(read.json_read(F.col("json"), "/orders", max_array_items=5), shape).alias("r"))
    keys = F.array_join(F.transform("r.value", lambda x: x["key"].cast("string")), ",")
    return got.select("doc_id", F.col("r.stats.originalLength").alias("original"), F.col("r.stats.returnedLength").alias("returned"), F.col("r.valueTruncated").alias("cut"), keys.alias("keys"))


@query(f"""WITH {_CUSTOMERS} SELECT doc_id, '/orders/' || i || '/priority' AS ptr, p AS scalar FROM o WHERE p = '1-URGENT'""")
def search_value_exact(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.search(nodes.native_nodes(_customers(spark, sf)), "1-URGENT").select("doc_id", "ptr", "scalar")


@query(f"""WITH {_CUSTOMERS} SELECT doc_id, '/orders/' || i || '/status' AS ptr FROM o""")
def search_key(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.search(nodes.native_nodes(_customers(spark, sf)), "status", by_key=True).select("doc_id", "ptr")


@query(f"""WITH {_CUSTOMERS}, m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM o WHERE s = 'F')
SELECT doc_id, '/orders/' || i || '/status' AS ptr, total >= 3 AS truncated FROM m WHERE n <= 3""")
def search_limit_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.search(nodes.ordered_nodes(_customers(spark, sf)), "F", limit=3).select("doc_id", "ptr", "truncated")


@query(f"""WITH {_CUSTOMERS}, m AS (SELECT doc_id, i FROM o WHERE s = 'F'), n AS (SELECT doc_id, least(count(*), 4) AS n, count(*) >= 4 AS t FROM m GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(t, false) AS truncated FROM c LEFT JOIN n ON c.doc_id = n.doc_id""")
def search_pointer_tool(spark: SparkSession, sf: str) -> DataFrame:
    got = _customers(spark, sf).select("doc_id", F.from_json(read.json_search(F.col("json"), "F", limit=4), "count int, truncated boolean").alias("r"))
    return got.select("doc_id", F.col("r.count").alias("n"), "r.truncated")


_FUZZY = """SELECT p_partkey, p_name FROM part, (SELECT lower(trim('{q}')) AS q) WHERE contains(lower(trim(p_name)), q) OR contains(q, lower(trim(p_name)))
OR (greatest(length(trim(p_name)), length(q)) <= 64 AND levenshtein(lower(trim(p_name)), q) <= CASE WHEN least(length(trim(p_name)), length(q)) < 6 THEN 1 WHEN least(length(trim(p_name)), length(q)) < 9 THEN 2 ELSE 3 END)"""


@query(_FUZZY.format(q="Red wigdet"))
def search_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").filter(read.col_alike(F.col("p_name"), F.lit("Red wigdet"))).select("p_partkey", "p_name")


@query("""SELECT doc_id, contains(lower(strip_accents(trim(text))), 'cion') AS hit FROM documents WHERE text IS NOT NULL""")
def search_fuzzy_accents(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").filter("text is not null").select("doc_id", F.to_json(F.struct(F.col("text").alias("t"))).alias("json"))
    got = docs.select("doc_id", F.from_json(read.json_search(F.col("json"), "CIÓN", fuzzy_match=True), "count int").alias("r"))
    return got.select("doc_id", (F.col("r.count") > 0).alias("hit"))


# Write operators.


def _op(op: str, path: Column | str, value: Column | None = None, source: str | None = None) -> Column:
    """One operation as JSON text; ``value`` is JSON text too."""
    quoted = F.to_json(F.struct(F.lit(op).alias("op"), (F.lit(path) if isinstance(path, str) else path).alias("path"), *([F.lit(source).alias("from")] if source else [])))
    return quoted if value is None else F.concat(F.regexp_replace(quoted, r"\}$", ""), F.lit(', "value": '), value, F.lit("}"))


def _batch(*ops: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *ops), F.lit("]"))


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.array(F.lit(1), F.lit(2)).alias("list"))).alias("json"))


@query("""SELECT n_nationkey, true AS ok, '{"name": "' || n_name || '", "region": 99, "list": [1, 5, 2, 9], "new": {"k": ' || n_nationkey || '}}' AS final_doc FROM nation""")
def patch_add_replace(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    ops = _batch(_op("add", "/list/1", F.lit("5")), _op("add", "/list/-", F.lit("9")), _op("replace", "/region", F.lit("99")), _op("add", "/new", F.concat(F.lit('{"k": '), key, F.lit("}"))))
    return patch.patch_documents(_nations(spark, sf).withColumn("patches", ops)).select("n_nationkey", "ok", "final_doc")


@query("""SELECT n_nationkey, true AS ok, '{"region": ' || n_regionkey || ', "list": [2], "title": "' || n_name || '", "copy": [2]}' AS final_doc FROM nation""")
def patch_remove_move_copy(spark: SparkSession, sf: str) -> DataFrame:
    ops = _batch(_op("remove", "/list/0"), _op("move", "/title", source="/name"), _op("copy", "/copy", source="/list"))
    return patch.patch_documents(_nations(spark, sf).withColumn("patches", ops)).select("n_nationkey", "ok", "final_doc")


@query("""SELECT n_nationkey, n_regionkey = 1 AS ok, CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END AS n_errors FROM nation""")
def patch_test_op(spark: SparkSession, sf: str) -> DataFrame:
    got = patch.patch_documents(_nations(spark, sf).withColumn("patches", _batch(_op("test", "/region", F.lit("1.0")))))
    return got.select("n_nationkey", "ok", F.size("errors").alias("n_errors"))


@query("""SELECT n_nationkey, '{"a": {"b": [{"c": "' || n_name || '"}]}}' AS final_doc FROM nation""")
def patch_autovivify(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "nation").select("n_nationkey", F.lit("{}").alias("json"), _batch(_op("add", "/a/b/0/c", F.concat(F.lit('"'), "n_name", F.lit('"')))).alias("patches"))
    return patch.patch_documents(docs).select("n_nationkey", "final_doc")


@query(f"""WITH {_CUSTOMERS}, f AS (SELECT doc_id, count(DISTINCT p) AS items, count(*) - count(DISTINCT p) AS skipped FROM o GROUP BY doc_id)
SELECT doc_id, CAST(items AS INTEGER) AS items, CAST(skipped AS INTEGER) AS skipped FROM f""")
def patch_duplicates_skipped(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    ops = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: F.concat(F.lit('{"op": "add", "path": "/p/-", "value": "'), x["o_orderpriority"], F.lit('"}'))), ", "), F.lit("]"))
    docs = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(ops.alias("patches")).withColumn("json", F.lit("{}"))
    got = patch.patch_documents(docs)
    return got.select("doc_id", F.size(F.from_json("final_doc", "p array<string>")["p"]).alias("items"), F.size("duplicates_skipped").alias("skipped"))


@query("""SELECT o_custkey AS doc_id, '/p' AS array_ptr, o_orderpriority AS item, min(o_orderkey) AS op_idx FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey, o_orderpriority""")
def dedup_appends(spark: SparkSession, sf: str) -> DataFrame:
    new = _t(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit("/p").alias("array_ptr"), F.col("o_orderkey").alias("op_idx"), F.col("o_orderpriority").alias("item"))
    old = new.select("doc_id", "array_ptr", F.lit("5-LOW").alias("item")).distinct()
    return patch.dedup_appends(new, old)


_GUARDED = {
    "invalid_path": ('{"op":"add","path":"name","value":1}', "Invalid JSON Pointer"),
    "add_on_array": ('{"op":"add","path":"/orders","value":[1]}', "DESTRUCTIVE OVERWRITE"),
    "scalar_on_array": ('{"op":"add","path":"/orders","value":1}', "TYPE DOWNGRADE"),
    "add_at_root": ('{"op":"add","path":"/","value":{}}', "DESTRUCTIVE"),
    "replace_array": ('{"op":"replace","path":"/orders","value":[]}', "DESTRUCTIVE REPLACE"),
    "remove_array": ('{"op":"remove","path":"/orders"}', "DATA LOSS"),
    "replace_scalar": ('{"op":"replace","path":"/name","value":"x"}', ""),
}


def _guard_query(ops: str, marker: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        got = patch.patch_documents(_customers(spark, sf).withColumn("patches", F.lit(f"[{ops}]")))
        said = F.coalesce(F.try_element_at("errors", F.lit(1))["message"], F.lit("")) if marker else F.lit("")
        return got.select("doc_id", "ok", F.when(said.startswith(marker), F.lit(marker)).otherwise(F.lit("")).alias("marker"))

    return run


for _name, (_ops, _marker) in _GUARDED.items():
    _some = "n > 0" if _name in ("replace_array", "remove_array") else "true"
    _bad = "false" if not _marker else _some
    query(f"""WITH {_CUSTOMERS}, f AS (SELECT c.doc_id, count(o.k) AS n FROM c LEFT JOIN o ON c.doc_id = o.doc_id GROUP BY c.doc_id)
SELECT doc_id, NOT ({_bad}) AS ok, CASE WHEN {_bad} THEN '{_marker}' ELSE '' END AS marker FROM f""", f"guard_{_name}")(_guard_query(_ops, _marker))  # fmt: skip


@query(f"""WITH {_CUSTOMERS}, f AS (SELECT c.doc_id, 2 + 3 * count(o.k) AS old FROM c LEFT JOIN o ON c.doc_id = o.doc_id GROUP BY c.doc_id)
SELECT doc_id, NOT (old > 10 AND 1 < old * 0.5) AS ok FROM f""")
def guard_shrinkage(spark: SparkSession, sf: str) -> DataFrame:
    # Only the empty path slips past the guards that look at one operation; what it would lose is seen afterwards.
    docs = _customers(spark, sf).withColumn("patches", F.lit('[{"op":"replace","path":"","value":{"a":1}}]'))
    return patch.patch_documents(docs).select("doc_id", "ok")


# Schemas and formats.


def _event_docs(spark: SparkSession, sf: str) -> DataFrame:
    body = F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.when(F.col("event_id") % 3 == 0, F.lit("x")).alias("tag"))
    return _t(spark, sf, "events").select("event_id", F.to_json(body).alias("json"))


@query("""SELECT event_id, CAST((event_type NOT IN ('click', 'view'))::INT + (user_id > 50)::INT + (event_id % 3 <> 0)::INT AS INTEGER) AS problems FROM events""")
def schema_object(spark: SparkSession, sf: str) -> DataFrame:
    schema = {"type": "object", "required": ["tag"], "properties": {"type": {"type": "string", "enum": ["click", "view"]}, "user": {"type": "integer", "minimum": 0, "maximum": 50}}}
    docs = _event_docs(spark, sf)
    return docs.select("event_id", problem_count(schema, F.col("json")).alias("problems"))


@query("""SELECT event_id, CAST(CASE WHEN (user_id <= 30)::INT + (user_id >= 20)::INT = 1 THEN 0 ELSE 1 END AS INTEGER) AS one_of,
CAST(CASE WHEN user_id <= 10 OR user_id >= 90 THEN 0 ELSE 1 END AS INTEGER) AS any_of, CAST((user_id < 5)::INT + (user_id > 80)::INT AS INTEGER) AS all_of FROM events""")
def schema_composition(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda s: {"properties": {"user": s}}
    docs, doc = _event_docs(spark, sf), F.col("json")
    return docs.select(
        "event_id",
        problem_count(at({"oneOf": [{"maximum": 30}, {"minimum": 20}]}), doc).alias("one_of"),
        problem_count(at({"anyOf": [{"maximum": 10}, {"minimum": 90}]}), doc).alias("any_of"),
        problem_count(at({"allOf": [{"minimum": 5}, {"maximum": 80}]}), doc).alias("all_of"),
    )


@query("""SELECT n_nationkey, CAST(CASE WHEN length(r_name) <= 4 THEN 1 ELSE 0 END AS INTEGER) AS problems FROM nation JOIN region ON n_regionkey = r_regionkey""")
def schema_ref(spark: SparkSession, sf: str) -> DataFrame:
    schema = {"definitions": {"R": {"type": "object", "properties": {"name": {"type": "string", "pattern": "^.{5,}$"}, "in": {"$ref": "#/definitions/R"}}}}, "properties": {"region": {"$ref": "#/definitions/R"}}}
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.to_json(F.struct(F.struct(F.col("r_name").alias("name")).alias("region")))
    return n.select("n_nationkey", problem_count(schema, body).alias("problems"))


_WORDS = "SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents"
_FORMATS = {
    "email": r"[^\s@]+@[^\s@]+\.[^\s@]+",
    "ipv4": r"((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}",
    "time": r"([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?",
    "uri": r"[A-Za-z][A-Za-z0-9+.-]*:(.|\n)*",
    "json-pointer": r"(/([^~]|~[01])*)?",
    "relative-json-pointer": r"(0|[1-9][0-9]*)(#|/([^~]|~[01])*)?",
}


def _format_query(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        words = _t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
        return words.groupBy("doc_id").agg(F.count_if(formats.col_matches(name, F.col("w"))).alias("n"))

    return run


for _name, _pattern in _FORMATS.items():
    _key = f"format_{_name.replace('-', '_')}"
    query(f"SELECT doc_id, count(*) FILTER (regexp_full_match(w, '{_pattern}')) AS n FROM ({_WORDS}) GROUP BY doc_id", _key)(_format_query(_name))


@query("""SELECT o_orderkey, try_cast(d AS DATE) IS NOT NULL AND regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS good FROM
(SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2024-02-' || CAST(25 + o_orderkey % 8 AS VARCHAR) END AS d FROM orders)""")
def format_date(spark: SparkSession, sf: str) -> DataFrame:
    d = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.lit("2024-02-"), (25 + F.col("o_orderkey") % 8).cast("string")))
    return _t(spark, sf, "orders").select("o_orderkey", formats.col_matches("date", d).alias("good"))


@query("""SELECT page_id, regexp_full_match(h, '[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)*') AND length(h) <= 253 AS good FROM (SELECT page_id, split_part(url, '/', 3) AS h FROM pages)""")
def format_hostname(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", formats.col_matches("hostname", F.split_part("url", F.lit("/"), F.lit(3))).alias("good"))



#: Per format, values that are of it and values that are not; every nation gets one of the first kind if its key is even.
_SAMPLES = {
    "email": (["user@example.com", "a@sub.domain.org"], ["not-email", "@missing.user", "a b@c.de"]),
    "idn-email": (["üser@exämple.com"], ["üser", "ü@x"]),
    "date-time": (["2024-01-15T10:30:00Z", "2024-01-15t10:30:00.25+03:00"], ["2024-01-15", "2024-13-01T00:00:00Z", "2024-01-15T10:30:00"]),
    "duration": (["P1D", "PT5M", "P2W", "P1Y2M3DT4H5M6.5S"], ["P", "PT", "1D", "P1S"]),
    "uri": (["https://example.com", "ftp://files.org/doc"], ["not a uri", "//host/path"]),
    "uri-reference": (["/a/b", "#top", "?q=1", "x/y"], ["http://[::1", "x://]a"]),
    "uri-template": (["/x/{id}", "/x{?a,b*}", "{+path:3}/y", "plain"], ["/x/{id", "/x/}", "{a{b}}", "{}"]),
    "iri": (["http://exämple.com/ü"], ["exämple", "/ü"]),
    "iri-reference": (["/ü", "#ü", "http://ü.de"], ["ü/x", "x"]),
    "hostname": (["example.com", "a-b.c"], ["-a.com", "a..b", "a_b.c"]),
    "idn-hostname": (["exämple.de", "a.b"], ["-ä.de", "ä-.de", "a..b"]),
    "ipv6": (["::1", "2001:db8::8a2e:370:7334"], ["::g", "1:2:3", "12345::"]),
    "regex": (["^a+$", "[a-z]{2}"], ["(", "[", "a{2,1}"]),
    "unknown": (["anything"], []),
}


def _sample_query(name: str) -> Query:
    good, bad = _SAMPLES[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("n_nationkey") % len(values) + 1).cast("int"))
        value = F.when(F.col("n_nationkey") % 2 == 0, at(good)).otherwise(at(bad or good))
        return _t(spark, sf, "nation").select("n_nationkey", formats.col_matches(name, value).alias("good"))

    return run


for _name, (_, _bad_values) in _SAMPLES.items():
    query(f"SELECT n_nationkey, {'n_nationkey % 2 = 0' if _bad_values else 'true'} AS good FROM nation", f"format_samples_{_name.replace('-', '_')}")(_sample_query(_name))


@query(f"""WITH {_CUSTOMERS}, f AS (SELECT doc_id, count(*) FILTER (s <> 'F') AS n FROM o GROUP BY doc_id) SELECT c.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS items, 1 AS extra, 0 AS fine, CAST(coalesce(n, 0) AS INTEGER) AS more
FROM c LEFT JOIN f ON c.doc_id = f.doc_id""")
def schema_items(spark: SparkSession, sf: str) -> DataFrame:
    order = {"type": "object", "properties": {"status": {"enum": ["F"]}}}
    docs, doc = _customers(spark, sf), F.col("json")
    return docs.select(
        "doc_id",
        problem_count({"properties": {"orders": {"type": "array", "items": order}}}, doc).alias("items"),
        problem_count({"properties": {"name": {}, "orders": {}}, "additionalProperties": False}, doc).alias("extra"),
        problem_count({"properties": {"name": {}}, "additionalProperties": True}, doc).alias("fine"),
        problem_count({"properties": {"name": {}, "segment": {}}, "additionalProperties": {"items": order}}, doc).alias("more"),
    )


@query("""SELECT n_nationkey, CAST(1 AS INTEGER) AS never, CAST(0 AS INTEGER) AS always, CAST((n_nationkey % 2)::INT AS INTEGER) AS email FROM nation""")
def schema_boolean_and_format(spark: SparkSession, sf: str) -> DataFrame:
    mail = F.when(F.col("n_nationkey") % 2 == 0, F.lit("a@b.org")).otherwise(F.lit("none"))
    docs, doc = _t(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(mail.alias("mail"))).alias("json")), F.col("json")
    return docs.select("n_nationkey", problem_count(False, doc).alias("never"), problem_count(True, doc).alias("always"), problem_count({"properties": {"mail": {"format": "email"}}}, doc).alias("email"))


#: By region: a batch, and what the refusal says, if there is one. The documents follow this schema before.
_STRICT = {"type": "object", "additionalProperties": False, "required": ["name", "list"], "properties": {"name": {"type": "string"}, "region": {"type": "integer", "minimum": 0}, "list": {"type": "array", "items": {"type": "integer"}}, "in": {"$ref": "#/definitions/In"}}, "definitions": {"In": {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}, "in": {"$ref": "#/definitions/In"}}}}}
_STRICT_CASES = {
    "unknown_property": ('{"op": "add", "path": "/other", "value": 1}', "not allowed"),
    "wrong_type": ('{"op": "replace", "path": "/region", "value": "x"}', "incompatible with schema"),
    "below_minimum": ('{"op": "replace", "path": "/region", "value": -1}', "minimum"),
    "remove_required": ('{"op": "remove", "path": "/name"}', "required"),
    "wrong_item": ('{"op": "add", "path": "/list/-", "value": "x"}', "integer"),
    "bad_index": ('{"op": "add", "path": "/list/9", "value": 1}', "index"),
    "missing_path": ('{"op": "replace", "path": "/in", "value": {"a": "x"}}', "does not exist"),
    "wrong_test": ('{"op": "test", "path": "/name", "value": 1}', "incompatible with schema"),
    "through_reference": ('{"op": "add", "path": "/in", "value": {"a": 1}}', "incompatible with schema"),
    "whole_document": ('{"op": "replace", "path": "", "value": {"name": "x"}}', "required"),
    "unsupported": ('{"op": "merge", "path": "/name", "value": 1}', "merge"),
    "good_value": ('{"op": "add", "path": "/in", "value": {"a": "x", "in": {"a": "y"}}}', ""),
    "good_item": ('{"op": "add", "path": "/list/-", "value": 3}', ""),
}


def _strict_query(ops: str, marker: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        got = patch.patch_documents(_nations(spark, sf).withColumn("patches", F.lit(f"[{ops}]")), schema=_STRICT)
        said = F.lower(F.array_join(F.transform("errors", lambda e: e["message"]), " "))
        same = F.col("final_doc") == F.regexp_replace(F.regexp_replace("json", '":', '": '), ',', ', ')
        return got.select("n_nationkey", "ok", F.contains(said, F.lit(marker.lower())).alias("said"), same.alias("untouched"))

    return run


for _name, (_ops, _marker) in _STRICT_CASES.items():
    query(f"SELECT n_nationkey, {str(not _marker).lower()} AS ok, true AS said, {str(bool(_marker)).lower()} AS untouched FROM nation", f"strict_{_name}")(_strict_query(_ops, _marker))


@query("""SELECT n_nationkey, false AS ok, true AS said FROM nation""")
def guard_no_patches(spark: SparkSession, sf: str) -> DataFrame:
    got = patch.patch_documents(_nations(spark, sf).withColumn("patches", F.lit("[]")))
    return got.select("n_nationkey", "ok", F.element_at("errors", 1)["message"].startswith(patch.NO_PATCHES).alias("said"))


# Rendering and chunking.


@query("""WITH q AS (SELECT doc_id, text, CAST(to_json(text) AS VARCHAR) AS whole FROM documents)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(whole) <= 102 THEN whole
  ELSE CAST(to_json(left(text, list_max(list_filter(range(0, 98), lambda k: length(CAST(to_json(left(text, k) || '...') AS VARCHAR)) <= 102))) || '...') AS VARCHAR) END AS shown FROM q""")
def truncate_flat_string(spark: SparkSession, sf: str) -> DataFrame:
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    return _t(spark, sf, "documents").select("doc_id", json_truncate(quoted, 102).alias("shown"))


@query()
def truncate_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _customers(spark, sf).select("doc_id", json_truncate(F.col("json"), 300).alias("shown"))


@query("""SELECT doc_id, coalesce(length(text), 0) <= 8000 AS single, true AS bounded, CASE WHEN text = '' OR length(text) > 8000 THEN NULL ELSE text END AS whole FROM documents""")
def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    chunked = chunking.chunk_documents(_t(spark, sf, "documents")).withColumn("n", F.size("chunks"))
    bounded = F.forall("chunks", lambda c: (F.length(c) <= 8000) & (F.length(c) > 0))
    return chunked.select("doc_id", (F.col("n") <= 1).alias("single"), bounded.alias("bounded"), F.when(F.col("n") == 1, F.try_element_at("chunks", F.lit(1))).alias("whole"))


@query()
def chunk_all_texts(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.explode_chunks(chunking.chunk_documents(_t(spark, sf, "documents"))).select("doc_id", "chunk_idx", "total", F.length("chunk").alias("n_chars"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
f(doc_id, a, i, held, done) AS (SELECT doc_id, a, 1, a[1], CAST([] AS VARCHAR[]) FROM p
UNION ALL SELECT doc_id, a, i + 1, CASE WHEN held = '' THEN a[i + 1] WHEN length(held) < 500 THEN held || chr(10) || chr(10) || a[i + 1] ELSE a[i + 1] END,
  CASE WHEN held = '' OR length(held) < 500 THEN done ELSE list_append(done, held) END FROM f WHERE i < len(a))
SELECT doc_id, CAST(CASE WHEN held = '' OR (len(done) > 0 AND length(held) < 500) THEN len(done) ELSE len(done) + 1 END AS INTEGER) AS chunks,
  CASE WHEN held = '' THEN len(list_aggregate(done, 'string_agg', '')) WHEN len(done) > 0 AND length(held) < 500 THEN length(list_aggregate(done, 'string_agg', '')) + 2 + length(held) ELSE length(coalesce(list_aggregate(done, 'string_agg', ''), '')) + length(held) END::INTEGER AS n_chars
FROM f WHERE i = len(a)""")
def chunk_merge_small(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").filter("text is not null")
    merged = docs.select("doc_id", chunking.merge_small(F.split("text", "\n")).alias("c"))
    return merged.select("doc_id", F.size("c").alias("chunks"), F.length(F.array_join("c", "")).alias("n_chars"))


@query("""WITH e AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
d AS (SELECT *, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(before AS DOUBLE[])) AS distance FROM e),
q AS (SELECT label, quantile_cont(distance, 0.95) AS cut FROM d GROUP BY label)
SELECT vec_id, coalesce(distance > cut, false) AS breaks FROM d JOIN q ON d.label = q.label""")
def semantic_breakpoints(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.breakpoints(_t(spark, sf, "embeddings"), "label", "vec_id", "embedding").select("vec_id", "breaks")


@query()
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.semantic_chunks(_t(spark, sf, "documents")).select("doc_id", F.size("chunks").alias("chunks"))


@query("""SELECT doc_id, length(text) <= 8000 AS single, CASE WHEN length(text) <= 8000 THEN '<TextChunk index="1" total="1">' || chr(10) || text || chr(10) || '</TextChunk>' END AS message FROM documents WHERE length(text) > 0""")
def user_message(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunking.explode_chunks(chunking.chunk_documents(_t(spark, sf, "documents")))
    told = chunks.select("doc_id", "total", "chunk_idx", chunking.user_message(F.col("chunk"), F.col("chunk_idx"), F.col("total")).alias("message"))
    return told.filter("chunk_idx = 0").select("doc_id", (F.col("total") == 1).alias("single"), F.when(F.col("total") == 1, F.col("message")).alias("message"))


@query()
def user_message_of_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunking.explode_chunks(chunking.chunk_documents(_t(spark, sf, "documents")))
    return chunks.select("doc_id", "chunk_idx", chunking.user_message(F.col("chunk"), F.col("chunk_idx"), F.col("total")).alias("message"))


# Message logs.


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


@query("""WITH r AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM conversations),
m AS (SELECT *, max(round) OVER (PARTITION BY conv_id) AS rounds, min(CASE WHEN role = 'user' AND round = 0 THEN turn END) OVER (PARTITION BY conv_id) AS first FROM r)
SELECT conv_id, CAST(turn AS BIGINT) AS seq, role, false AS is_summary FROM m WHERE rounds > 2 AND ((round = 0 AND (role = 'system' OR turn = first)) OR round > rounds - 2)
UNION ALL SELECT conv_id, CAST(max(turn) AS BIGINT), 'user', true FROM m WHERE rounds > 2 AND round > 0 AND round <= rounds - 2 GROUP BY conv_id""")
def trim_messages(spark: SparkSession, sf: str) -> DataFrame:
    return messages.trim(_log(spark, sf), ai="assistant", human="user").select("conv_id", "seq", "role", "is_summary")


@query("SELECT conv_id, arg_max(text, turn) AS content, max(turn) AS seq FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_ai_message(spark: SparkSession, sf: str) -> DataFrame:
    return messages.last_ai(_log(spark, sf), ai="assistant")


@query("""SELECT c.conv_id, c.turn AS seq, c.role FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'system' GROUP BY conv_id) s ON c.conv_id = s.conv_id WHERE s.last IS NULL OR c.turn >= s.last""")
def messages_reset(spark: SparkSession, sf: str) -> DataFrame:
    return messages.since_reset(_log(spark, sf)).select("conv_id", "seq", "role")


@query("""SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(1) AS BIGINT) AS output_tokens, CAST(sum(length(text) + 1) AS BIGINT) AS total_tokens, count(*) AS llm_calls,
CAST(0 AS BIGINT) AS cache_creation_input_tokens, CAST(sum(CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END) AS BIGINT) AS cache_read_input_tokens FROM conversations GROUP BY conv_id""")
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    calls = _t(spark, sf, "conversations").select("conv_id", F.length("text").cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), (F.length("text") + 1).cast("long").alias("total_tokens"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("cache_read_input_tokens"))
    return messages.token_usage(calls, "conv_id")


@query("SELECT user_id, event_type AS tool, count(*) AS n FROM events GROUP BY user_id, event_type")
def tool_counts(spark: SparkSession, sf: str) -> DataFrame:
    return messages.tool_counts(_t(spark, sf, "events").select("user_id", F.col("event_type").alias("tool")), "user_id")


@query("""SELECT o_orderkey, CASE WHEN k >= 1000000 THEN printf('%.1fM', round(k / 1000000, 1)) WHEN k >= 1000 THEN printf('%.1fk', round(k / 1000, 1)) ELSE CAST(k AS VARCHAR) END AS shown FROM (SELECT o_orderkey, o_orderkey * 37 AS k FROM orders)""")
def short_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").select("o_orderkey", messages.short_number(F.col("o_orderkey") * 37).alias("shown"))


# Extraction.

_MAIL, _ADDRESS = r"[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"


_FOUND = f"SELECT doc_id, text, list_distinct(regexp_extract_all(text, '{_MAIL}')) AS m, list_distinct(regexp_extract_all(text, '{_ADDRESS}')) AS a FROM documents"


@query(f"""WITH d AS ({_FOUND}) SELECT doc_id, CAST(coalesce(len(m), 0) AS INTEGER) AS emails, CAST(coalesce(len(a), 0) AS INTEGER) AS addresses,
CASE WHEN length(text) <= 8000 AND text <> '' THEN 1 END AS one_chunk, coalesce(text, '') <> '' AS fine FROM d""")
def extract_counts(spark: SparkSession, sf: str) -> DataFrame:
    got = extract_documents(_t(spark, sf, "documents"))
    j = F.from_json("json", "emails array<string>, addresses array<string>")
    count = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c))
    return got.select("doc_id", count(j["emails"]).alias("emails"), count(j["addresses"]).alias("addresses"), F.when(F.col("total_chunks") == 1, 1).alias("one_chunk"), F.col("error").isNull().alias("fine"))


@query()
def extract_flagship(spark: SparkSession, sf: str) -> DataFrame:
    return extract_documents(_t(spark, sf, "documents"), embed=chunking.hashed_embedding).select("doc_id", "json", "total_chunks", "guidance", "error")


@query()
def chunk_semantic_first(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.explode_chunks(chunking.chunk_documents(_t(spark, sf, "documents"), chunking.hashed_embedding)).select("doc_id", "chunk_idx", "total", F.length("chunk").alias("n_chars"))


@query(f"WITH d AS ({_FOUND}) SELECT doc_id, CAST(coalesce(len(m) + len(a), 0) AS BIGINT) AS leaves FROM d")
def extracted_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return extract_documents(_t(spark, sf, "documents")).select("doc_id", nodes.col_leaves(F.col("json")).alias("leaves"))


@query(f"""WITH d AS ({_FOUND}) SELECT doc_id, CASE WHEN length(text) <= 8000 AND text <> '' THEN 1 END AS one_chunk,
CAST((coalesce(len(m), 0) > 0)::INT + (coalesce(len(a), 0) > 0)::INT AS INTEGER) AS fields FROM d""")
def result_counts(spark: SparkSession, sf: str) -> DataFrame:
    got = result_counts_of(extract_documents(_t(spark, sf, "documents")))
    return got.select("doc_id", F.when(F.col("chunks") == 1, 1).alias("one_chunk"), "fields")


def _call(name: str, **args) -> dict:
    return {"name": name, "args": args}


def _scripted(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("text"))


def _script(doc_id: int) -> ScriptedPlanner:
    """A look at the keys, two writes, an unknown tool, and a guidance that names what was done."""
    write = _call("apply_patches", patches=[{"op": "add", "path": "/list/-", "value": doc_id}, {"op": "add", "path": "/list/-", "value": doc_id}])
    return ScriptedPlanner([[_call("inspect_keys")], [write, _call("no_such_tool")], [_call("update_guidance", last_path=f"/list/{doc_id}", extracted_entities_count=1)]])


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '{"list": [' || n_nationkey || ']}' AS json, 1 AS total_chunks, '/list/' || n_nationkey AS last_path, CAST(3 AS BIGINT) AS llm_calls, NULL::VARCHAR AS error FROM nation""")
def extract_scripted(spark: SparkSession, sf: str) -> DataFrame:
    got = extract_documents(_scripted(spark, sf), _script)
    return got.select("doc_id", "json", "total_chunks", F.get_json_object("guidance", "$.last_path").alias("last_path"), F.col("token_usage")["llm_calls"].alias("llm_calls"), "error")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '{}' AS json, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 6 ELSE 1 END AS BIGINT) AS llm_calls FROM nation""")
def extract_retries(spark: SparkSession, sf: str) -> DataFrame:
    # Who only ever looks is stopped after two rounds and asked twice more; an answer without a call ends the chunk at once.
    bounds = Settings(max_iterations_per_chunk=2, max_chunk_retries=2)
    got = extract_documents(_scripted(spark, sf), lambda i: ScriptedPlanner([[_call("inspect_keys")]] * 99 if i % 2 == 0 else []), settings=bounds)
    return got.select("doc_id", "json", F.col("token_usage")["llm_calls"].alias("llm_calls"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CASE WHEN n_nationkey % 3 = 0 THEN 'RuntimeError: down' END AS error, CASE WHEN n_nationkey % 3 = 0 THEN '{}' ELSE '{"list": [' || n_nationkey || ']}' END AS json FROM nation""")
def extract_failures(spark: SparkSession, sf: str) -> DataFrame:
    got = extract_documents(_scripted(spark, sf), lambda i: ScriptedPlanner([RuntimeError("down")]) if i % 3 == 0 else _script(i))
    return got.select("doc_id", "error", "json")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, seq, node, iteration, tools FROM nation, (VALUES (0, 'prepare_chunk', 0, ''), (1, 'call_model', 1, 'inspect_keys'), (2, 'execute_tools', 1, ''),
(3, 'call_model', 2, 'apply_patches,no_such_tool'), (4, 'execute_tools', 2, ''), (5, 'call_model', 3, 'update_guidance'), (6, 'execute_tools', 3, ''), (7, 'finalize_chunk', 3, '')) AS v(seq, node, iteration, tools)""")
def progress_events(spark: SparkSession, sf: str) -> DataFrame:
    return extract_events(_scripted(spark, sf), _script).select("doc_id", "seq", "node", "iteration", F.array_join("tools", ",").alias("tools"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'finalize_chunk' AS node, 0 AS chunk_idx, 1 AS total, 3 AS iteration, 'apply_patches=1,inspect_keys=1,no_such_tool=1,update_guidance=1' AS tools,
CAST(3 AS BIGINT) AS llm_calls, 'input_tokens,llm_calls,output_tokens,total_tokens' AS counters FROM nation""")
def progress_fold(spark: SparkSession, sf: str) -> DataFrame:
    got = progress(extract_events(_scripted(spark, sf), _script))
    tools = F.array_join(F.array_sort(F.transform(F.map_entries("tools"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    counters = F.array_join(F.array_sort(F.map_keys("usage")), ",")
    return got.select("doc_id", "node", "chunk_idx", "total", "iteration", tools.alias("tools"), F.col("usage")["llm_calls"].alias("llm_calls"), counters.alias("counters"))


@query("""SELECT conv_id AS doc_id, arg_max(text, turn) AS last_path, '' AS open_section, max(turn) AS extracted FROM conversations GROUP BY conv_id""")
def guidance_latest(spark: SparkSession, sf: str) -> DataFrame:
    # Every turn is a chunk that leaves a guidance; the next one replaces it as a whole.
    turns = _t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_idx"), F.to_json(F.struct(F.col("text").alias("last_path"), F.col("turn").alias("extracted_entities_count"))).alias("args"))
    got = latest_guidance(turns)
    j = F.from_json("guidance", "last_path string, open_section string, extracted_entities_count long")
    return got.select("doc_id", j["last_path"].alias("last_path"), j["open_section"].alias("open_section"), j["extracted_entities_count"].alias("extracted"))
