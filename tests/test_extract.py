import json
import time

import pytest

from docjson import cli
from docjson.plans.extract import Message, RulePlanner, Run, ScriptedPlanner, add_messages, add_usage, extract, extract_documents, system_prompt, trim_messages, update_guidance
from docjson.settings import Settings
from docjson.sources import files
from docjson.sql import register
from docjson.streaming.incremental import extract_stream


def call(name, **args):
    return {"name": name, "args": args}


DONE = [call("update_guidance", last_path="/a")]


def patches(*ops):
    return [call("apply_patches", patches=list(ops))]


def add(path, value):
    return {"op": "add", "path": path, "value": value}


def test_scripted_rounds():
    r = extract("hello", ScriptedPlanner([[call("inspect_keys")], patches(add("/a", 1)), DONE]))
    assert r["json_document"] == {"a": 1} and r["metadata"]["token_usage"]["llm_calls"] == 3 and r["metadata"]["final_guidance"]["last_path"] == "/a"


def test_empty_and_blank():
    assert extract("", RulePlanner())["error"] == "No text provided for processing."
    blank = extract("  ", RulePlanner())
    assert blank["error"] is None and blank["metadata"]["total_chunks"] == 0


def test_no_call_ends_a_chunk_and_is_not_retried():
    p = ScriptedPlanner([[]])
    extract("x", p)
    assert p.at == 1


def test_retries_and_bounds():
    s = Settings(max_iterations_per_chunk=2, max_chunk_retries=1)
    p = ScriptedPlanner([[call("inspect_keys")]] * 10)
    extract("x", p, settings=s)
    assert p.at == 4


def test_failure_is_trimmed_and_tried_again():
    looks = [[call("inspect_keys")]] * 3
    p = ScriptedPlanner([*looks, RuntimeError("too long"), DONE])
    assert extract("x", p)["error"] is None and p.at == 5
    with pytest.raises(RuntimeError):
        extract("x", ScriptedPlanner([RuntimeError("at once")]))


def test_tools_in_one_answer_see_each_other():
    p = ScriptedPlanner([[*patches(add("/l", [])), *patches(add("/l/-", 1)), call("no_such_tool"), call("read_value", path="/l"), call("inspect_keys", source="schema")], DONE])
    assert extract("x", p)["json_document"] == {"l": [1]}


def test_schema_needs_one_root_write():
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string"}, "b": {"type": "string"}}}
    one = ScriptedPlanner([patches(add("/a", "x"), add("/b", "y")), patches(add("", {"a": "x", "b": "y"})), DONE])
    assert extract("x", one, schema)["json_document"] == {"a": "x", "b": "y"}


def test_reducers_and_trim():
    s, h, a, t = (Message(r, r) for r in ("system", "human", "ai", "tool"))
    assert add_messages([h], [a]) == [h, a] and add_messages([h], [s, h]) == [s, h] and add_messages([h], []) == [h]
    assert add_usage({}, {}) == {} and add_usage({"input_tokens": 1}, {"input_tokens": 2, "llm_calls": 1})["input_tokens"] == 3
    assert trim_messages([s, h, a, t, a, t]) is None
    out = trim_messages([s, h, Message("human", "old"), *[a, t] * 4], 1)
    assert [m.role for m in out] == ["system", "human", "human", "ai", "tool"] and "3 previous iteration" in out[2].content


def test_guidance_and_prompt():
    assert update_guidance(last_path="/x")["guidance"] == {"last_path": "/x", "sections_snapshot": "", "items_added": "", "open_section": "", "text_excerpt": "", "next_expectations": "", "pending_data": "", "extracted_entities_count": 0}
    p = system_prompt({}, {"last_path": "/x"}, {"a": "y" * 9000}, Settings())
    assert "<TargetSchema>\nnull" in p and "/x" in p and len(p) < 8000


def test_frames(spark):
    docs = spark.createDataFrame([(1, "to a.b@c.example.com from 10.0.0.1 to a.b@c.example.com"), (2, None), (3, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in extract_documents(docs).collect()}
    assert json.loads(got[1]["json"]) == {"emails": ["a.b@c.example.com"], "addresses": ["10.0.0.1"]} and got[2]["error"] and got[3]["json"] == "{}"

    class Broken:
        def plan(self, messages):
            raise OSError("down")

    bad = extract_documents(docs.filter("doc_id = 1"), lambda _: Broken()).first()
    assert "down" in bad["error"]


def test_stream_equals_batch(spark, tmp_path):
    chunks = [(1, 1, 2, "x@y.example.com"), (1, 0, 2, "10.0.0.1"), (2, 0, 1, "none"), (3, 1, 2, "10.1.1.1")]
    shape = "doc_id long, chunk_idx int, total int, chunk string"
    for i, c in enumerate(chunks):
        spark.createDataFrame([c], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05 if i else 0)
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = extract_stream(source).writeStream.format("memory").queryName("chunks_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {(r["doc_id"], r["chunk_idx"]): r for r in spark.sql("select * from chunks_out").collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0)} and rows[(1, 1)]["done"]
    run = Run(RulePlanner())
    assert json.loads(rows[(1, 1)]["json"]) == run.all(["10.0.0.1", "x@y.example.com"])["json_document"]


def test_sql_functions(spark):
    register(spark)
    one = lambda q: spark.sql(f"select {q} as x").first()["x"]
    assert json.loads(one("""json_patch('{"a":1}', '[{"op":"add","path":"/b","value":2}]')"""))["finalDoc"] == {"a": 1, "b": 2}
    assert json.loads(one("""json_read('{"a":1}', '{"path":"/a"}')"""))["value"] == 1
    assert json.loads(one("""json_search('{"a":1}', '{"query":"1"}')"""))["count"] == 1
    assert json.loads(one("""json_inspect('{"a":1}', '')"""))["count"] == 1
    assert json.loads(one("""json_validate('{"a":1}', '{"properties":{"a":{"type":"string"}}}')"""))[0]["pointer"] == "/a"
    assert one("json_truncate('[1,2,3,4,5,6]', 10)") == "[...]" and one("json_truncate('no', 10)") is None


def test_sources_and_cli(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("mail x@y.example.com", encoding="utf-8")
    (tmp_path / "s.json").write_text('{"type": "object"}')
    got = files.text_files(spark, str(tmp_path / "a.txt")).first()
    assert got["text"] == "mail x@y.example.com" and files.schema_file(spark, str(tmp_path / "s.json")) == {"type": "object"}
    assert files.inline(spark, "a", "b").count() == 2
    files.write_json(extract_documents(files.inline(spark, "x@y.example.com")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["emails"] == ["x@y.example.com"]
    assert cli.main(["-f", str(tmp_path / "a.txt"), "-s", str(tmp_path / "s.json"), "-o", str(tmp_path / "d/o.json"), "-p", "-q"]) == 0
    assert json.loads((tmp_path / "d/o.json").read_text())["emails"] == ["x@y.example.com"]
    assert cli.main(["-f", str(tmp_path / "none.txt")]) == 1 and cli.main(["-t", "hi"]) == 0
    assert "{}" in capsys.readouterr().out
    assert files.pretty('{"a":1}') == '{\n  "a": 1\n}'
