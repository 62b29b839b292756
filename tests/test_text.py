import json

import pytest
from pyspark.sql import functions as F

from docjson.functions.truncate import Limits, truncate
from docjson.operators import chunking, messages


def test_fitting_is_untouched():
    assert truncate({"a": 1}, 100) == '{\n    "a": 1\n}' and truncate(None, 5) == "null" and truncate([], 5) == "[]"


def test_strings_are_cut_to_the_largest_length_that_fits():
    out = truncate("y" * 200, 80)
    assert len(out) == 80 and out.endswith('..."')
    both = truncate({"a": "x" * 300, "b": "z" * 100}, 120)
    assert len(both) <= 120 and both.count("...") == 2


def test_arrays_and_objects():
    assert truncate(list(range(50)), 60).count("...") == 1 and len(truncate(list(range(50)), 60)) <= 60
    assert truncate({str(i): i for i in range(20)}, 80).splitlines()[-1] == "}"
    assert truncate({"a": [1, 2, 3, 4]}, 20) == '{\n    "a": [...]\n}'
    tight = Limits(2, 10, 3, 1, 1)
    assert len(truncate({"k": {"l": ["v" * 40] * 10}}, 200, tight)) <= 250
    assert "__TRUNCATED__" in truncate(["__TRUNCATED__"], 100)


@pytest.mark.parametrize("n", [30, 60, 200, 1000])
def test_fits_or_cannot_shrink(n):
    data = {"a": ["text " * 30] * 20, "b": {f"k{i}": {"x": i, "y": [i] * 5} for i in range(15)}}
    out = truncate(data, n)
    assert len(out) <= n or out == "{...}"


@pytest.mark.parametrize(
    ("parts", "want"),
    [([], []), (["small", "a" * 200, "b" * 200], 2), (["a" * 200, "b" * 200, "tiny"], 2), (["s"] * 5, 1), (["a" * 200], 1), (["", "a" * 200], 1)],
)
def test_merge_small(spark, parts, want):
    df = spark.createDataFrame([(parts,)], "c array<string>").select(chunking.merge_small(F.col("c"), 100).alias("m"))
    got = df.first()["m"]
    assert len(got) == (want if isinstance(want, int) else 0)
    if parts and all(parts):
        assert chunking.GLUE.join(got) == chunking.GLUE.join(parts)


def test_recursive_split():
    text = "Hello world. " * 1000
    pieces = chunking.recursive_split(text, 500, 50)
    assert all(0 < len(p) <= 500 for p in pieces) and len(pieces) > 20
    assert chunking.recursive_split("short", 500) == ["short"] and chunking.recursive_split("", 5) == []
    solid = chunking.recursive_split("x" * 1000, 300, 0)
    assert "".join(solid) == "x" * 1000
    nested = chunking.recursive_split("para one\n\n" + "word " * 200, 100, 10)
    assert nested[0] == "para one" and all(len(p) <= 100 for p in nested)


def test_chunk_documents(spark):
    docs = spark.createDataFrame([(1, "short"), (2, ""), (3, None), (4, "word " * 4000), (5, "   ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunking.chunk_documents(docs).collect()}
    assert got[1]["chunks"] == ["short"] and got[1]["error"] is None
    assert got[2]["chunks"] == [] == got[3]["chunks"] and got[2]["error"] == got[3]["error"] == "No text provided for processing."
    assert len(got[4]["chunks"]) >= 3 and all(len(c) <= 8000 for c in got[4]["chunks"])
    sem = {r["doc_id"]: r["chunks"] for r in chunking.semantic_chunks(docs, least=1).collect()}
    assert sem[5] == [] and sem[3] == [] and sem[1] == ["short"]


def log(spark, rounds):
    rows = [(1, 0, "system", "s"), (1, 1, "human", "task"), (1, 2, "human", "older summary")]
    for i in range(rounds):
        rows += [(1, 3 + 2 * i, "ai", f"a{i}"), (1, 4 + 2 * i, "tool", f"t{i}")]
    return spark.createDataFrame(rows, "conv_id long, seq long, role string, content string")


def test_trim(spark):
    assert messages.trim(log(spark, 2)).count() == 0
    got = messages.trim(log(spark, 4), keep=1).orderBy("seq").collect()
    assert [r["content"] for r in got if not r["is_summary"]] == ["s", "task", "a3", "t3"]
    note = next(r for r in got if r["is_summary"])
    assert "3 previous iteration" in note["content"] and note["seq"] == 8


def test_usage_and_resets(spark):
    calls = spark.createDataFrame([(1, 5, 2), (1, None, None), (2, 1, 1)], "k long, input_tokens long, output_tokens long")
    got = {r["k"]: r for r in messages.token_usage(calls, "k").collect()}
    assert got[1]["input_tokens"] == 5 and got[1]["llm_calls"] == 1 and got[1]["cache_read_input_tokens"] == 0
    rows = spark.createDataFrame([(1, 0, "system", "a"), (1, 1, "ai", "b"), (1, 2, "system", "c"), (1, 3, "ai", "d")], "conv_id long, seq long, role string, content string")
    assert [r["content"] for r in messages.since_reset(rows).orderBy("seq").collect()] == ["c", "d"]
    assert messages.last_ai(rows).first()["content"] == "d"
    shown = spark.createDataFrame([(1234567,), (3400,), (12,)], "n long").select(messages.short_number(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in shown] == ["1.2M", "3.4k", "12"]
    assert json.dumps(None) == "null"
