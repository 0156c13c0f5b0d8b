import random

import pytest

from pyspark.sql import functions as F

from tessella.joins import hot_keys, split_join
from tessella.operators.hierarchy import ancestors, hierarchy, order_violations
from tessella.plans.hierarchy import declarations


def brute(parent):
    """root, depth, cycle membership and ancestors by walking up."""
    out = {}
    for v in parent:
        seen, w = [], parent.get(v)
        while w is not None and w not in seen:
            seen.append(w)
            w = parent.get(w)
        out[v] = seen
    return out


def check(spark, parent):
    known = {v: (p if p in parent else None) for v, p in parent.items()}
    up = brute(known)
    tree = hierarchy(spark.createDataFrame(list(parent.items()), "id bigint, parent bigint"), "id", "parent", with_path=True)
    got = {r["id"]: r for r in tree.collect()}
    assert set(got) == set(parent)
    for v, above in up.items():
        r = got[v]
        cyclic = v in above
        below = not cyclic and any(a in up[a] for a in above)
        assert (r["in_cycle"], r["below_cycle"]) == (cyclic, below), v
        assert r["n_descendants"] == sum(1 for w, a in up.items() if v in a and w != v), v
        if cyclic or below:
            assert r["root"] == -1 and r["depth"] is None and r["path"] is None
        else:
            assert r["root"] == (above[-1] if above else v)
            assert r["depth"] == len(above)
            assert r["path"] == [*reversed(above), v]
    for v in got:  # intervals against ancestors
        for w in random.Random(v).sample(sorted(got), min(12, len(got))):
            a, b = got[v], got[w]
            inside = v != w and a["tour"] == b["tour"] and a["enter"] <= b["enter"] and a["exit"] >= b["exit"]
            assert inside == (v != w and v in up[w]), (v, w)
    return tree, up


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, seed):
    rnd = random.Random(seed)
    n = 120
    parent = {v: rnd.choice([None, rnd.randrange(n), max(0, v - 1), 7, 999]) for v in range(n)}
    tree, up = check(spark, parent)
    orders = []
    for k in range(60):
        items = [rnd.randrange(n) for _ in range(rnd.randrange(6))]
        if k % 7 == 0 and items:
            items.append(items[0])
        orders.append((k, items if k % 11 else None))
    got = {r["k"]: r["violates"] for r in order_violations(spark.createDataFrame(orders, "k bigint, l array<bigint>"), "k", "l", tree).collect()}
    for k, items in orders:
        first = list(dict.fromkeys(items or []))
        want = any(first[j] in up[first[i]] and first[i] != first[j] for i in range(len(first)) for j in range(i + 1, len(first)))
        assert got[k] == want, (k, items)


def test_deep_chain_and_wide_star(spark):
    chain = {v: v - 1 if v else None for v in range(300)}
    star = {v: 1000 for v in range(1001, 1400)} | {1000: None}
    check(spark, chain | star)


def test_one_long_cycle_with_tails(spark):
    parent = {v: (v + 1) % 37 for v in range(37)} | {v: v - 40 for v in range(40, 120)} | {200: 200}
    check(spark, parent)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "id bigint, parent bigint, root string")
    assert hierarchy(empty, "id", "parent").count() == 0
    rows = spark.createDataFrame([(None, 1, "x"), (1, None, "y"), (2, 5, "z"), (-3, 2, "w")], "id bigint, parent bigint, root string")
    got = {r["id"]: (r["root"], r["depth"]) for r in hierarchy(rows, "id", "parent").collect()}
    assert got == {1: (1, 0), 2: (2, 0), -3: (2, 1)}
    orders = spark.createDataFrame([(1, None), (2, []), (3, [None, 99])], "k bigint, l array<bigint>")
    out = order_violations(orders, "k", "l", hierarchy(rows, "id", "parent")).collect()
    assert {(r["k"], r["n_listed"], r["violates"]) for r in out} == {(1, 0, False), (2, 0, False), (3, 0, False)}


def test_latest_run_holds_and_names_are_cleaned(spark):
    rows = spark.createDataFrame(
        [
            (1, "r", "m", " A ", None, None, 1, None),
            (2, "r", "m", "B", None, "_root_.A", 2, None),
            (2, "r", "m", "B", None, "C", 1, None),
            (2, "r", "m", "B", None, "_root_.A", 2, None),
            (3, "r", "other", "C", None, "A ", 1, None),
            (None, "r", "m", "D", None, None, 1, None),
            (4, "r", "m", "_root_.E", None, " ", None, None),
        ],
        "decl_id bigint, repo string, module_name string, decl string, decl_kind string, parent_decl string, run_no int, extracted_at timestamp",
    )
    assert {r["decl_id"]: r["parent_id"] for r in declarations(rows).collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_star_with_hot_parent_and_cycle(spark, monkeypatch):
    """Every key of more than 20 rows counts as hot: the splitting of joins changes nothing."""
    monkeypatch.setattr("tessella.joins.HOT_ROWS", 20)
    parent = {0: None, 1: 2, 2: 1, **{v: v % 3 for v in range(3, 120)}, 200: 150, 150: 7}
    check(spark, parent)


def test_ancestors_of_a_chain_and_a_star_come_once(spark, monkeypatch):
    monkeypatch.setattr("tessella.operators.hierarchy.TOP", 2)
    parent = {v: v - 1 if 0 < v < 40 else (0 if v else None) for v in range(70)}
    tree = hierarchy(spark.createDataFrame(list(parent.items()), "id bigint, parent bigint"), "id", "parent")
    got = sorted((r["id"], r["ancestor"], r["distance"]) for r in ancestors(tree).collect())
    up = brute(parent)
    assert got == sorted((v, a, k + 1) for v, above in up.items() for k, a in enumerate(above))


def test_no_key_of_a_split_join_is_hot(spark, monkeypatch):
    monkeypatch.setattr("tessella.joins.HOT_ROWS", 100)
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id")).alias("k"))
    small = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).union(spark.createDataFrame([(7, 14)], "k bigint, x bigint"))
    assert [r["k"] for r in hot_keys(big, ["k"])] == [7]
    for how in ("inner", "left"):
        got = split_join(big, small, ["k"], how)
        want = big.join(small, ["k"], how)
        assert sorted(map(str, got.select("id", "k", "x").collect())) == sorted(map(str, want.select("id", "k", "x").collect()))
