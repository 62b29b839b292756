"""Queries over whole texts, held against brute force on a small fixture."""

import json
import re
import unicodedata

import pytest

from docjson import queries as own
from docjson.operators import chunking
from docjson.operators.chunking import recursive_split
from docjson.plans.extract import RulePlanner, extract, extract_documents

GOOD = ["a@b.org", "10.0.0.255", "123e4567-e89b-12d3-a456-426614174000", "23:59:60Z", "urn:x", "/a~1b/~0", "0/a", "12#", "7"]
BAD = ["a@b", "10.0.0.256", "/a~2", "01/a", "0#a", "25:00:00", ":x", "/a~"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    far = "lorem ipsum " * 300
    rows = [far + " ".join(GOOD + BAD), " ".join(GOOD), "x" * 1999 + " " + "y" * 50, far + "a  b", "", "/" + "a/" * 60_000, "0/" + "a\n" * 60_000 + "~", "no pointer " + "~0" * 60_000]
    rows += [far + "la canción", "canciÓn " + far, far + "cancian", None]
    at = str(tmp_path_factory.mktemp("whole"))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    docs.write.parquet(f"{at}/documents.parquet")
    return at, rows


@pytest.mark.parametrize("name", own._FORMATS)
def test_formats_read_whole_texts(spark, texts, name):
    at, rows = texts
    pattern = re.compile(own._FORMATS[name])
    want = {i: sum(pattern.fullmatch(w) is not None for w in t.split(" ")) for i, t in enumerate(rows) if t is not None}
    got = {r["doc_id"]: r["n"] for r in own.QUERIES[f"format_{name.replace('-', '_')}"](spark, at).collect()}
    assert got == want and got[0] > 0


def test_search_reads_whole_texts(spark, texts):
    at, rows = texts
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).lower()
    want = {i: "cion" in plain(t) for i, t in enumerate(rows) if t}
    got = {r["doc_id"]: r["hit"] for r in own.QUERIES["search_fuzzy_accents"](spark, at).collect()}
    assert {i: v for i, v in got.items() if rows[i]} == want and got[8] and got[9] and not got[10]


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    mail = lambda a, b: " ".join(f"mail m{i}@x.org from 10.0.0.{i % 200}." for i in range(a, b))
    rows = [mail(0, 900), mail(0, 3), 'a "quoted"\t\\ line\n' * 30, "short", "", None, "  ", "plain words " * 5000 + "\n\n" + mail(0, 2)]
    at = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at, rows


def test_flat_strings_of_any_kind(spark, long_texts):
    at, rows = long_texts

    def cut(t):
        best = [json.dumps(t[:k] + "...", ensure_ascii=False) for k in range(min(len(t), 120))]
        whole = json.dumps(t, ensure_ascii=False)
        return whole if len(whole) <= 102 else max((x for x in best if len(x) <= 102), key=len)

    got = {r["doc_id"]: r["shown"] for r in own.QUERIES["truncate_flat_string"](spark, at).collect()}
    assert got == {i: None if t is None else cut(t) for i, t in enumerate(rows)}


def test_messages_and_extraction_of_all_documents(spark, long_texts):
    at, rows = long_texts
    chunks = {i: recursive_split(t or "") for i, t in enumerate(rows)}
    assert len(chunks[0]) > 1 and all(len(c) <= 8000 for cs in chunks.values() for c in cs)
    got = {(r["doc_id"], r["chunk_idx"]): r["message"] for r in own.QUERIES["user_message_of_chunks"](spark, at).collect()}
    assert got == {(i, k): f'<TextChunk index="{k + 1}" total="{len(cs)}">\n{c}\n</TextChunk>' for i, cs in chunks.items() for k, c in enumerate(cs)}
    found = {i: [len({x for c in cs for x in re.findall(p, c)}) for p in (own._MAIL, own._ADDRESS)] for i, cs in chunks.items()}
    got = {r["doc_id"]: r for r in own.QUERIES["extract_counts"](spark, at).collect()}
    assert {i: [r["emails"], r["addresses"]] for i, r in got.items()} == found and found[0][0] >= 900 and found[7] == [2, 2]
    assert {i: (r["one_chunk"], r["fine"]) for i, r in got.items()} == {i: (1 if len(cs) == 1 and t.strip() else None, bool(t)) for (i, cs), t in zip(chunks.items(), rows, strict=True)}
    total = {r["doc_id"]: r["total_chunks"] for r in extract_documents(spark.read.parquet(f"{at}/documents.parquet")).collect()}
    assert total == {i: len(cs) if rows[i] and rows[i].strip() else 0 for i, cs in chunks.items()}
    pieces = {(r["doc_id"], r["chunk_idx"]): r["n_chars"] for r in own.QUERIES["chunk_all_texts"](spark, at).collect()}
    assert pieces == {(i, k): len(c) for i, cs in chunks.items() for k, c in enumerate(cs)}
    leaves = {r["doc_id"]: r["leaves"] for r in own.QUERIES["extracted_leaves"](spark, at).collect()}
    assert leaves == {i: sum(n) for i, n in found.items()}


def test_extraction_takes_semantic_chunks_first(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: r["chunks"] for r in chunking.semantic_chunks(docs).collect()}
    got = {r["doc_id"]: r["chunks"] for r in chunking.chunk_documents(docs, chunking.hashed_embedding).collect()}
    assert got == want and sum(len(c) > 1 for c in want.values()) > 20
    runs = {r["doc_id"]: r["total_chunks"] for r in own.QUERIES["extract_flagship"](spark, sf).collect()}
    assert runs == {i: len(c) for i, c in want.items()}
    total = {(r["doc_id"], r["total"]) for r in own.QUERIES["chunk_semantic_first"](spark, sf).collect()}
    assert total == {(i, len(c)) for i, c in want.items() if c}


def test_recursive_chunks_where_the_embedding_fails(spark):
    def down(values):
        raise OSError("down")

    text = "One sentence. " * 2000
    assert extract(text, RulePlanner(), embed=down)["metadata"]["total_chunks"] == len(recursive_split(text)) > 1
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunking.chunk_documents(docs, down).collect()}
    assert got[1]["chunks"] == recursive_split(text) and got[2]["chunks"] == got[3]["chunks"] == [] and got[3]["error"]
