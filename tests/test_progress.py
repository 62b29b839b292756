import json
import time

from pyspark.sql import functions as F

from docjson.functions.truncate import truncate
from docjson.operators import nodes, read
from docjson.plans import progress
from docjson.plans.extract import RulePlanner, ScriptedPlanner, extract, extract_documents, latest_guidance
from docjson.plans.tools import TOOLS, ChatPlanner
from docjson.settings import Settings
from docjson.sql import register
from docjson.streaming.incremental import extract_stream

DEEP = "[" * 60_000 + "]" * 60_000


def look(**args):
    return [{"name": "inspect_keys", "args": args}]


DONE = [{"name": "update_guidance", "args": {}}]


def test_tokens_are_counted_once_although_messages_are_trimmed(spark):
    """The answer before a trim is sent again with the shorter messages; it is not paid for again."""
    script = [look(), look(), look(), [], DONE]
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    events = progress.extract_events(docs, lambda _: ScriptedPlanner(list(script)))
    rows = sorted((r for r in events.collect() if r["doc_id"] == 1), key=lambda r: r["seq"])
    assert [r["node"] for r in rows] == ["prepare_chunk", *["call_model", "execute_tools"] * 4, "finalize_chunk"]
    want = extract("x", ScriptedPlanner(list(script)))["metadata"]["token_usage"]
    now = {r["doc_id"]: r for r in progress.progress(events).collect()}
    assert now[1]["usage"] == {k: v for k, v in want.items() if not k.startswith("cache_")} and want["llm_calls"] == 5
    assert now[1]["tools"] == {"inspect_keys": 3, "update_guidance": 1} and (now[1]["chunk_idx"], now[1]["total"]) == (0, 1)
    assert now[2]["node"] == "failed" and now[2]["error"] and now[2]["tools"] == {}
    assert progress.progress(events.limit(0)).count() == 0


def test_tools_are_those_of_the_current_chunk(spark):
    text = ("word " * 1500 + "\n\n") * 2
    script = [look(), look(), DONE, DONE]
    events = progress.extract_events(spark.createDataFrame([(1, text)], "doc_id long, text string"), lambda _: ScriptedPlanner(list(script)))
    now = progress.progress(events).first()
    assert (now["chunk_idx"], now["total"], now["iteration"]) == (1, 2, 1) and now["tools"] == {"update_guidance": 1} and now["usage"]["llm_calls"] == 4


def test_counts_and_observation(spark):
    docs = spark.createDataFrame([(1, "to a.b@c.example.com from 10.0.0.1"), (2, ""), (3, "nothing")], "doc_id long, text string")
    df, seen = progress.observed(extract_documents(docs), "extraction")
    got = {r["doc_id"]: (r["chunks"], r["fields"]) for r in progress.result_counts(df).collect()}
    assert got == {1: (1, 2), 2: (0, 0), 3: (1, 0)}
    assert seen.get["documents"] == 3 and seen.get["failures"] == 1 and seen.get["chunks"] == 2 and seen.get["llm_calls"] >= 2


def test_a_model_is_asked_with_tools():
    asked = []

    def chat(messages, **how):
        asked.append((messages, how))
        if len(asked) == 1:
            return {"tool_calls": [{"id": "1", "name": "apply_patches", "args": json.dumps({"patches": [{"op": "add", "path": "/a", "value": 1}]})}], "usage": {"input_tokens": 7}}
        return {"tool_calls": [{"name": "update_guidance", "args": "no object"}]}

    r = extract("hello", ChatPlanner(chat))
    assert r["json_document"] == {"a": 1} and r["metadata"]["token_usage"]["input_tokens"] == 7
    assert asked[0][1] == {"tools": TOOLS, "tool_choice": "required", "temperature": 0.0} and [m["role"] for m in asked[1][0]] == ["system", "human", "ai", "tool"]
    assert [t["function"]["name"] for t in TOOLS] == ["inspect_keys", "search_pointer", "read_value", "apply_patches", "update_guidance"]
    assert TOOLS[1]["function"]["parameters"]["properties"]["limit"]["default"] == 20 and TOOLS[2]["function"]["parameters"]["required"] == ["path"]


def test_last_guidance_wins(spark):
    rows = [(1, 0, '{"last_path": "/a", "open_section": "s"}'), (1, 1, '{"last_path": "/b"}'), (2, 0, None), (3, 5, "[1]")]
    got = {r["doc_id"]: json.loads(r["guidance"]) for r in latest_guidance(spark.createDataFrame(rows, "doc_id long, chunk_idx int, args string")).collect()}
    assert got[1]["last_path"] == "/b" and got[1]["open_section"] == "" and got[2]["last_path"] == got[3]["last_path"] == ""


def test_deep_documents_fail_no_job(spark):
    register(spark)
    docs = spark.createDataFrame([(1, DEEP), (2, '{"a": [1, {"b": "x"}], "c": "[,{\\"", "d": {}}'), (3, "no"), (4, None), (5, "1"), (6, '{"a": 1, "a": 2}')], "doc_id long, json string")
    docs.createOrReplaceTempView("deep_docs")
    seen = {r["doc_id"]: r for r in spark.sql("select doc_id, json_inspect(json, '') i, json_truncate(json, 50) t, json_search(json, '{\"query\": \"x\"}') s, json_validate(json, '{}') v from deep_docs").collect()}
    assert all(seen[1][c] is None for c in "its") and all(seen[2][c] for c in "its") and seen[2]["v"] == "[]"
    assert {r["doc_id"] for r in docs.select("doc_id", read.json_inspect(F.col("json")).alias("x")).collect() if r["x"]} == {2, 5, 6}
    assert {r["doc_id"] for r in nodes.ordered_nodes(docs).select("doc_id").distinct().collect()} == {2, 5, 6}
    assert {r["doc_id"]: r["n"] for r in docs.select("doc_id", nodes.col_leaves(F.col("json")).alias("n")).collect()} == {1: None, 2: 3, 3: None, 4: None, 5: 1, 6: None}


def test_native_leaf_counts_equal_those_of_the_nodes(spark):
    values = [{"k\\\"": ["a\\", "", -1.5e-7, True, None, [], {}], "null": {"true": [False]}}, [], {}, "x:", ["s", {"s": "s : 1"}], 12, {"é": "ü\n", "u": "\u0001"}]
    docs = spark.createDataFrame([(i, json.dumps(v, indent=i % 3 or None)) for i, v in enumerate(values)], "doc_id long, json string")
    want = {r["doc_id"]: r["leaves"] for r in nodes.leaf_counts(nodes.ordered_nodes(docs)).collect()}
    assert {r["doc_id"]: r["n"] for r in docs.select("doc_id", nodes.col_leaves(F.col("json")).alias("n")).collect()} == want
    assert {r["doc_id"]: r["leaves"] for r in nodes.leaf_counts(nodes.native_nodes(docs)).collect()} == want


def test_rendering_takes_linear_time():
    began = time.perf_counter()
    shown = truncate({"a": list(range(40_000)), "b": {f"k{i}": "x" * 50 for i in range(2000)}}, 500)
    assert len(shown) <= 500 and time.perf_counter() - began < 20


def test_stream_bears_failures_and_repeats(spark, tmp_path):
    class Down:
        def plan(self, messages):
            raise OSError("down")

    shape = "doc_id long, chunk_idx int, total int, chunk string"
    batches = [[(1, 0, 1, "10.0.0.1"), (2, 0, 2, "x")], [(1, 0, 1, "10.0.0.2"), (2, 1, 2, "x"), (3, 1, 2, "late")]]
    for b in batches:
        spark.createDataFrame(b, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = extract_stream(source, lambda i: Down() if i == 2 else RulePlanner(), settings=Settings(max_chunk_retries=0))
    q = out.writeStream.format("memory").queryName("failures_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    rows = [(r["doc_id"], r["chunk_idx"], r["done"], r["error"]) for r in spark.sql("select * from failures_out").collect()]
    assert sorted(rows, key=str) == [(1, 0, True, None), (2, 0, False, "OSError: down")]


def test_stream_lets_go_of_what_never_comes(spark, tmp_path):
    shape = "doc_id long, chunk_idx int, total int, chunk string"
    spark.createDataFrame([(3, 1, 2, "late")], shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    q = extract_stream(source, keep_ms=500).writeStream.format("memory").queryName("expired_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            rows = spark.sql("select * from expired_out").collect()
            if rows:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r["doc_id"], r["chunk_idx"], r["done"], r["error"]) for r in rows] == [(3, 0, False, "chunk 0 did not come")]
