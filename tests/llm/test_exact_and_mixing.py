import hashlib
from collections import Counter, defaultdict

import pytest

from docjson.llm import exact_dedup, mixing


def by_text(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return groups


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups_equal_brute_force(odd, keep):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    groups = by_text(rows)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (min if keep == "smallest" else max)(known) if known else None
        for i in ids:
            want[(i, stays, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exact_dedup.exact_groups(odd, keep).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_drop_keeps_one_and_all_columns(odd, empty):
    out = exact_dedup.drop_exact_copies(odd)
    assert out.columns == odd.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == len(by_text([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert (2, "the quick brown fox jumps over the lazy dog") not in got and (3, None) in got
    twice = odd.filter("doc_id = 2")
    assert exact_dedup.drop_exact_copies(twice).count() == 1
    assert exact_dedup.drop_exact_copies(empty).count() == 0 == exact_dedup.exact_groups(empty).count()
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(odd, "newest")


def reshared(sizes: dict, weights=(1, 2, 3), most=3.0):
    """Targets by handing the excess on until none is above its cap."""
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        free = [n for n in names if n not in capped]
        share = {n: left * w[n] / sum(w[x] for x in free) for n in free}
        over = [n for n in free if share[n] > most * sizes[n] + 1e-9]
        if not over:
            return capped | share
        for n in over:
            capped[n] = most * sizes[n]
            left -= capped[n]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 100, "b": 1, "c": 1, "d": 50}, {"a": 1000, "b": 5, None: 3, "z": 0}, {"x": 7}, {"a": 0, "b": 0}])
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = reshared(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_taken_words_meet_the_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 3 if i % 10 else 0}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).collect()
    taken, target = Counter(), {}
    for r in plan:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in plan}
    other = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs, seed=3).collect()}
    assert other != again


def slope_of(sizes, rest):
    """By making certain whoever exceeds 1, until nobody does."""
    free, left = list(sizes), rest
    while True:
        slope = left / sum(int(s**0.5 * 1024) / 1024 * s for s in free)
        over = [s for s in free if slope * s**0.5 > 1]
        if not over:
            return slope
        free = [s for s in free if slope * s**0.5 <= 1]
        left -= sum(over)


def test_odds_add_up_under_caps(spark):
    """Few very long documents are certain, and the short ones make up for the odds these cannot use."""
    rows = [(i, "w " * (4000 if i < 3 else 1 + i % 5), "a") for i in range(900)] + [(1000 + i, "w " * 20, "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = [r for r in mixing.mix_plan(docs, weights=(3, 2)).collect() if r["source"] == "a"]
    target, whole = plan[0]["target"], int(plan[0]["target"] // plan[0]["source_size"])
    rest = target - whole * plan[0]["source_size"]
    slope = slope_of([r["size"] for r in plan], rest)
    assert slope * 4000**0.5 > 1 and abs(sum(min(1, slope * r["size"] ** 0.5) * r["size"] for r in plan) - rest) < 0.05 * rest
    assert abs(sum(r["size"] * r["copies"] for r in plan) - target) <= 4000


@pytest.mark.parametrize("doc_id", [7, None])
def test_repeated_ids_are_drawn_one_by_one(spark, doc_id):
    rows = [(doc_id, "w " * 10, "a") for _ in range(150)] + [(doc_id, "v " * 10, "a") for _ in range(50)] + [(doc_id, "w " * 10, "b") for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == 400
    for out in (Counter({s: sum(r["size"] * r["copies"] for r in plan if r["source"] == s) for s in "ab"}), Counter({r["source"]: 10 * r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()})):
        for r in plan:
            assert abs(out[r["source"]] - r["target"]) <= 10


def test_rank_order_decides(spark):
    """The cut through two levels of cells takes what a plain sort would take."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "a" if i % 4 else "b") for i in range(300)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix_plan(docs, weights=(1, 3)).collect()}
    u = {i: (int(hashlib.md5(f"{i}:17:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in got}
    for s in ("a", "b"):
        mine = [r for r in got.values() if r["source"] == s]
        rest = mine[0]["target"] - int(mine[0]["target"] // mine[0]["source_size"]) * mine[0]["source_size"]
        slope = slope_of([r["size"] for r in mine], rest)
        chance = {r["doc_id"]: min(1.0, slope * r["size"] ** 0.5) for r in mine}
        order = sorted(mine, key=lambda r: (u[r["doc_id"]] / (1 - u[r["doc_id"]]) * (1 - chance[r["doc_id"]]) / chance[r["doc_id"]], r["doc_id"]))
        at, drawn = 0, set()
        for r in order:
            if at + r["size"] / 2 <= rest:
                drawn.add(r["doc_id"])
            at += r["size"]
        whole = int(mine[0]["target"] // mine[0]["source_size"])
        assert {r["doc_id"] for r in mine if r["copies"] > whole} == drawn


def test_mixing_odd_rows(odd, empty):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert rows and all(r["size"] == "own" and r["text"] and r["text"].strip() for r in rows)
    assert mixing.mix(empty).count() == 0 == mixing.mix_plan(empty).count()
