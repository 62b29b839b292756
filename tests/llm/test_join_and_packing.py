import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docjson.llm import ngram_join, packing
from docjson.llm.components import components
from docjson.llm.text_hash import shingles, word_hashes

import pyarrow as pa

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute(rows, k, num):
    s = sets_of([r for r in rows if r[0] is not None], k)
    up = {i: i for i in s}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= num * (len(s[a]) + len(s[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(s[i]), root(i)) for i in ids}


def family(rng, n, edits, length=60):
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    texts = family(rng, 60, 3) + family(rng, 40, 8) + family(rng, 12, 1, 200)
    texts += [" ".join(f"u{rng.randint(0, 400)}" for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts += ["a b", "A  b", "a b c", "x", "X", "", None, " "]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, k=4, num=85).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want) - 50


def test_full_groups_are_tied(spark, monkeypatch):
    """Groups so small that a cluster fills many of them still make one component."""
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 40, 2) + family(rng, 30, 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, k=3, num=80).collect()}
    assert got == brute(rows, 3, 80)


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_and_frequent_tokens(spark, monkeypatch, block):
    """Small groups in small blocks, and tokens that many sets hold, which take the short way: no link is lost."""
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "OFTEN", 6)
    rng = random.Random(12)
    common = " ".join(f"c{i}" for i in range(25))
    texts = family(rng, 40, 12) + family(rng, 30, 4) + [f"{t} {common}" for t in family(rng, 30, 14, 40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(ngram_join._find_often(docs.select("doc_id", "text"), 3)[0]) > 20
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, k=3, num=80).collect()}
    assert got == brute(rows, 3, 80)


def test_join_odd_rows(odd, empty):
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    at = {r["doc_id"]: r for r in got}
    assert at[2]["component_id"] == 1 and at[7]["component_id"] == 6 and at[10]["component_id"] == 9
    assert at[3]["n_shingles"] == at[4]["n_shingles"] == at[5]["n_shingles"] == 0 and at[3]["component_id"] == 3
    assert at[None]["component_id"] is None and at[None]["n_shingles"] == 1
    left = ngram_join.keep_one_of_each(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 3, 4, 5, 6, 8, 9]
    assert ngram_join.jaccard_components(empty).count() == 0
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(empty, num=40)


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 300), (300, 200), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 300: 200}
    assert components(edges.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\tÄé", max_size=12), min_size=1, max_size=6), st.integers(1, 4))
def test_shingles_equal_sets(texts, k):
    want = [len(s) for s in sets_of(enumerate(texts), k).values()]
    got = []
    for _, n, words, rows in word_hashes(pa.array(texts)):
        hashes, bounds = shingles(words, rows, n, k)
        got += [len(np.unique(hashes[bounds[r] : bounds[r + 1]])) for r in range(n)]
    assert got == want


def check_pack(rows, pieces, length):
    whole = Tokenizer.from_file(PATH)
    want = sorted(tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    docs, sequences = {}, {}
    for p in pieces:
        docs.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        at = 0
        for p in s:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == length or at < length and at & (at - 1) == 0
    return want, docs


def test_packing_is_a_partition_of_all_ids(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "Quick!!", "naïve", "it's", "x" * 30, "日本", "42"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.pack(docs, PATH, length=64).collect()
    _, _ = check_pack(rows, pieces, 64)
    whole = Tokenizer.from_file(PATH)
    for i, t in rows:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        at = 0
        for p in mine:
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_packing_odd_rows(odd, empty):
    pieces = packing.pack(odd, PATH).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want, _ = check_pack(rows, pieces, 2048)
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    assert sum(p["start"] == 0 for p in pieces) == len(rows)
    assert packing.pack(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, PATH, length=100)


def test_heavy_cells_are_split():
    first, ways, parts = packing._deal(np.array([1.0, 100.0, 1.0, 1.0]), 4)
    assert ways[1] >= 3 and parts >= ways[1] and first[2] >= first[1] + ways[1]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_hilbert_is_a_walk_through_all_cells(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_key(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAzß'sé1 .#日İσΣ́ <|>"), max_size=10), max_size=4))
def test_words_encode_like_texts(texts):
    encoder, whole = packing.WordEncoder.of(PATH), Tokenizer.from_file(PATH)
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    ids, bounds = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids
