import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessella import joins
from tessella.operators import assembly, governance, graph, prefix, selection, similarity, spans


@pytest.mark.parametrize("limit", [1, 100])
def test_lookup_join_of_either_kind(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    big = spark.createDataFrame([("hot", i % 3, {"a": i}) for i in range(90)] + [("b", 1, None), (None, 1, None), ("z", 1, None)], "k string, v int, m map<string,int>")
    small = spark.createDataFrame([("hot", 7), ("b", 8), (None, 9)], "k string, w int")
    got = sorted((r["k"] or "", r["w"] or 0) for r in joins.lookup_join(big, small, ["k"]).collect())
    assert got == sorted([("hot", 7)] * 90 + [("b", 8), ("", 0), ("z", 0)])
    assert joins.lookup_join(big, small, ["k"], "inner").count() == 91


def test_running_sums_cross_tasks(spark):
    rows = [("a" if i % 3 else None, (i * 7919) % 500, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r["g"], r["o"]): (r["s"], r["n"]) for r in prefix.running(df, ["g"], ["o"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    want = {}
    for g in ("a", None):
        s = 0
        for n, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 1):
            s += v
            want[g, o] = (s, n)
    assert got == want
    assert prefix.running(df.limit(0), ["g"], ["o"], {"s": F.col("v")}).count() == 0


def fold(rows, cap):
    out, used = set(), 0
    for i, size, _, base in sorted(rows, key=lambda r: (not r[3], r[2], r[0])):
        if base or used + size <= cap:
            used += size
            out.add((i, used))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_fill_is_the_fold_over_rows(spark, seed):
    rnd = random.Random(seed)
    caps = {"a": 1000, "b": 37, "c": 0, "d": 10**6}
    rows = {s: [(i, rnd.choice([0, 1, 7, 30, 400, 900, rnd.randrange(500)]), f"{rnd.randrange(30):02d}", rnd.random() < 0.1 * (seed - 1)) for i in range(60)] for s in caps}
    flat = [(s, *r, caps[s]) for s, rs in rows.items() for r in rs] + [("a", 900, None, "00", None, 5), (None, 901, 1, "00", None, 5), ("e", 902, 1, "00", None, None)]
    df = spark.createDataFrame(flat, "s string, i int, n int, h string, b boolean, c int")
    got = {}
    for r in selection.greedy_fill(df, "s", "i", "n", "h", "c", "b").collect():
        got.setdefault(r["s"], set()).add((r["i"], r["used"]))
    assert got == {s: f for s, rs in rows.items() if (f := fold(rs, caps[s]))}


def test_greedy_fill_passes_over_what_does_not_fit(spark):
    rows = [("s", i, b, f"{i:02d}", 1000) for i, b in enumerate([300, 800, 300, 300, 200])]
    f = spark.createDataFrame(rows, "stream string, id bigint, bytes bigint, h string, cap bigint")
    assert {r["id"] for r in selection.greedy_fill(f, "stream", "id", "bytes", "h", "cap").collect()} == {0, 2, 3}
    assert selection.greedy_fill(f.limit(0), "stream", "id", "bytes", "h", "cap").count() == 0


def test_hamilton_gives_all_seats_and_breaks_ties_by_label(spark):
    f = spark.createDataFrame([("g", c, n, 10) for c, n in (("a", 1), ("b", 1), ("c", 1), ("d", 0))], "g string, c string, p bigint, s int")
    assert {r["c"]: r["quota"] for r in selection.hamilton(f, ["g"], "c", "p", "s").collect()} == {"a": 4, "b": 3, "c": 3, "d": 0}


def test_tercile_cutpoints_are_order_statistics(spark):
    values = [5, 1, 1, 9, 7, 3, 3, 3]
    f = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v int")
    v, n = sorted(values), len(values)
    r = selection.tercile_cutpoints(f, ["g"], "v").first()
    assert (r["q1"], r["q2"]) == (v[(n - 1) // 3], v[2 * (n - 1) // 3])


def test_round_robin_takes_turns(spark):
    f = spark.createDataFrame([("b", r, i) for r in ("x", "y") for i in range(6)] + [("b", "z", 0)], "bin string, repo string, h int")
    got = selection.round_robin(f, ["bin"], "repo", ["h"], 8).collect()
    assert [r["repo"] for r in sorted(got, key=lambda r: r["slot"])] == list("xyzxyxyx")


def test_prefix_filter_finds_what_brute_force_finds(spark):
    rnd = random.Random(3)
    sets = {}
    for i in range(160):
        base = sets.get(rnd.randrange(max(i, 1)), set()) if i % 3 else set()
        s = {w for w in base if rnd.random() > 0.12} | {str(rnd.randrange(60)) for _ in range(rnd.randrange(1, 5))}
        sets[i] = s
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, g array<string>")
    classes = {r["id"]: r["class_id"] for r in similarity.classes(df, "id", "g").collect()}
    got = {(r["a"], r["b"], r["n_inter"], r["n_union"]) for r in similarity.jaccard_pairs(df, "id", "g").collect()}
    reps = sorted(set(classes.values()))
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in reps for b in reps if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    assert got == want


def test_ratio_is_exact_at_the_limit(spark):
    r = spark.range(1).select(similarity.meets(F.lit(7), F.lit(10)).alias("a"), similarity.meets(F.lit(69), F.lit(99)).alias("b"), similarity.ratio_bin(F.lit(9), F.lit(10)).alias("c"))
    assert tuple(r.first()) == (True, False, "B5")


def components_of(n, edges):
    reach = {v: {v} for v in range(n)}
    for _ in range(n):
        for a, b in edges:
            reach[a] |= reach[b]
    return {v: min(w for w in range(n) if w in reach[v] and v in reach[w]) for v in range(n)}


@pytest.mark.parametrize(("seed", "n", "ways"), [(1, 30, 45), (2, 30, 80), (3, 40, 40), (4, 25, 30)])
def test_components_against_mutual_reachability(spark, seed, n, ways):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(ways)}
    if seed == 3:  # one way out of each node, as in parent links
        edges = {(v, rnd.choice([(v + 1) % n, rnd.randrange(n), max(0, v - 1)])) for v in range(n) if v % 9}
    df = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    want = components_of(n, edges)
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert got == {v: want[v] for e in edges for v in e}


def test_components_of_long_ways_take_few_rounds(spark, monkeypatch):
    n, rounds = 20_000, []
    cut = graph.Scratch.cut
    monkeypatch.setattr(graph.Scratch, "cut", lambda self, df, name="t": rounds.append(name) or cut(self, df, name))
    ring = spark.range(n).select((F.col("id") + n).alias("src"), (n + (F.col("id") + 1) % n).alias("dst"))
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    sizes = {r["component"]: r["count"] for r in graph.components(chain.union(ring)).groupBy("component").count().where("count > 1").collect()}
    assert sizes == {n: n} and rounds.count("jumps") + rounds.count("stuck") < 60


def test_digest_of_a_set_ignores_order_and_sees_repeats(spark):
    hexes = [f"{i * 2654435761 % 16**8:08x}" * 8 for i in range(300)]
    one = lambda rows: selection.set_digest(spark.createDataFrame(rows, "g string, h string"), ["g"], "h").collect()
    a, b = one([("x", h) for h in hexes]), one([("x", h) for h in reversed(hexes)] + [("x", None)])
    assert len(a) == 1 and a == b and one([("x", h) for h in hexes] + [("x", hexes[0])]) != a and one([("x", h) for h in hexes[1:]]) != a
    assert one([("x", None)]) == []


def test_reachability_ends_on_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5)], "src bigint, dst bigint")
    got = {(r["src"], r["dst"]): r["dist"] for r in graph.reachable(df).collect()}
    assert got[1, 1] == 3 and got[1, 4] == 3 and got[3, 4] == 1 and len(got) == 12
    assert graph.reachable(df.limit(0)).count() == 0


def test_kahn_takes_the_least_ready_node_and_keeps_cycles_last():
    assert graph.kahn([1, 2, 3, 4, 5], [(3, 1), (4, 2), (5, 5)]) == ([3, 1, 4, 2, 5], 0)
    assert graph.kahn([1, 2, 3], [(1, 2), (2, 1)]) == ([3, 1, 2], 2)


def test_closure_order_puts_dependencies_first():
    deps = {1: [2, 3], 2: [4], 3: [4], 4: [5], 5: [4], 6: [1]}
    order = graph.closure_order(1, deps, "r", "s")
    assert set(order) == {2, 3, 4, 5} and order[:2] == [4, 5]


def test_longest_prefix_wins(spark):
    i = spark.createDataFrame([("r", 1, "a.b.c"), ("r", 2, "z")], "scope string, id bigint, name string")
    m = spark.createDataFrame([("r", "a", 10), ("r", "a.b", 11), ("q", "a.b.c", 12)], "scope string, module string, module_id bigint")
    assert {r["id"]: r["module_id"] for r in graph.prefix_resolve(i, m).collect()} == {1: 11, 2: None}


def spans_of(rnd, n, size):
    out = []
    for k in range(n):
        a = rnd.randrange(size)
        out.append((k, a, a + rnd.randrange(0, 40)))
    return out


def test_overlaps_and_lookups_against_brute_force(spark):
    rnd = random.Random(5)
    a, b = spans_of(rnd, 40, 300), spans_of(rnd, 40, 300)
    da = spark.createDataFrame([("k", *x) for x in a], "k string, a_id bigint, start bigint, end bigint")
    db = spark.createDataFrame([("k", *x) for x in b], "k string, b_id bigint, start bigint, end bigint")
    got = {(r["a_id"], r["b_id"]): r["bytes"] for r in spans.overlaps(da, db, ["k"], 16).collect()}
    want = {(i, j): n for i, s, e in a for j, t, f in b if (n := min(e, f) - max(s, t)) > 0 and s < e and t < f}
    assert got == want
    cuts = [(0, 0, 10), (1, 10, 11), (2, 20, 90)]
    ds = spark.createDataFrame([("k", *x) for x in cuts], "k string, id bigint, start bigint, end bigint")
    points = spark.createDataFrame([("k", p) for p in range(100)], "k string, pos bigint")
    for r in spans.span_at(points, ds, ["k"], "pos", 16).collect():
        assert r["span_id"] == next((i for i, s, e in cuts if s <= r["pos"] < e), -1)


def test_merge_and_complement_partition_the_text(spark):
    rnd = random.Random(6)
    s = [(i, a, b) for i, a, b in spans_of(rnd, 12, 200) if a < b]
    d = spark.createDataFrame([("k", *x) for x in s], "k string, id bigint, start bigint, end bigint")
    m = spans.merged(d, ["k"])
    c = spans.complement(m, spark.createDataFrame([("k", 300), ("empty", 5)], "k string, n bigint"), ["k"], "n").collect()
    covered = {p for _, a, b in s for p in range(a, b)}
    kept = sorted((r["start"], r["end"], r["output_start"]) for r in c if r["k"] == "k")
    assert {p for a, b, _ in kept for p in range(a, b)} == set(range(300)) - covered
    assert [o for _, _, o in kept] == [sum(b - a for a, b, _ in kept[:i]) for i in range(len(kept))]
    assert [(r["start"], r["end"]) for r in c if r["k"] == "empty"] == [(0, 5)]


def nominal(grps, ctx):
    """Window ends by walking from boundary to boundary."""
    n, opens = len(grps), [i for i in range(1, len(grps)) if grps[i] != grps[i - 1]]
    out, a = [], 0
    while a < n:
        b = min(a + ctx, n)
        if b < n and b not in opens:
            inside = [o for o in opens if a < o < b]
            after = [o for o in opens if o > b]
            b = inside[-1] if inside else (after[0] if after else n)
        out.append((a, b))
        a = b
    return out


@pytest.mark.parametrize("size", [1, 3, 5])
def test_windows_never_split_a_group(spark, size):
    rnd = random.Random(size)
    data, want = [], {}
    for k in range(12):
        grps, g = [], 0
        for _ in range(rnd.randrange(1, 30)):
            g += rnd.random() < 0.5
            grps.append(g)
        data += [(f"s{k}", i, x) for i, x in enumerate(grps)]
        want[f"s{k}"] = nominal(grps, size)
    df = spark.createDataFrame(data, "s string, i int, g bigint")
    got = {}
    for r in spans.group_windows(df, "s", "i", "g", size).collect():
        got.setdefault(r["s"], []).append((r["win_start"], r["win_end"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_suffix_budget_has_one_partial_unit(spark):
    u = spark.createDataFrame([("o", i, 10) for i in range(5)], "o string, pos int, size bigint")
    r = sorted((x["pos"], x["bytes_in"], x["whole"], x["eligible"]) for x in spans.suffix_budget(u, ["o"], ["pos"], "size", [25]).collect())
    assert r == [(2, 5, False, True), (3, 10, True, True), (4, 10, True, True)]


def test_variance_components_by_hand(spark):
    d = spark.createDataFrame([("f", "A", 1.0), ("f", "A", 2.0), ("f", "A", 3.0), ("f", "B", 2.0), ("f", "B", 4.0), ("g", "A", 0.0), ("g", "A", 0.0), ("g", "B", 10.0), ("g", "B", 10.0), ("s", "A", 1.0), ("s", "B", 3.0), ("s", "C", 5.0), ("o", "A", 1.0)], "f string, m string, x double")
    r = {x["f"]: x for x in governance.variance_components(d, ["f"], "m", "x").collect()}
    assert abs(r["f"]["sigma_w2"] - float(Fraction(4, 3))) < 1e-9 and r["f"]["sigma_b2"] == 0
    assert r["g"]["sigma_w2"] == 0 and abs(r["g"]["sigma_b2"] - 50) < 1e-9
    assert r["s"]["mode"] == "all-singleton-conservative" and abs(r["s"]["sigma_b2"] - 4.0) < 1e-9
    assert r["o"]["mode"] == "insufficient-clusters" and r["o"]["sigma_b2"] is None


def test_upper_bound_has_no_largest_sample(spark):
    known = {20: 2.085963447, 21: 2.079613845, 30: 2.042272456, 60: 2.000297822, 120: 1.979930405}
    df = spark.createDataFrame([(n,) for n in (0, 1, 19, *known, 10**7)], "df bigint").select("df", governance.t_quantile_any(F.col("df")).alias("t"), governance.t_quantile(F.col("df")).alias("pilot"))
    got = {r["df"]: (r["t"], r["pilot"]) for r in df.collect()}
    assert got[0] == (None, None) and got[1] == (12.706204736,) * 2 and got[19] == (2.093024054,) * 2
    assert all(abs(got[n][0] - t) < 1e-6 and got[n][1] is None for n, t in known.items()) and abs(got[10**7][0] - 1.959964) < 1e-6
    rows = spark.createDataFrame([("a", float(i % 2)) for i in range(122)] + [("b", 1.0)], "f string, x double")
    r = {x["f"]: x for x in governance.upper_bound(rows, ["f"], "x").collect()}
    assert abs(r["a"]["upper"] - (0.5 + 1.979763763 * (0.25 / 121) ** 0.5)) < 1e-6 and r["b"]["upper"] is None


def test_correlation_of_a_constant_is_zero(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", None, 4.0)], "g string, x double, y double")
    r = {x["g"]: (x["n"], x["r"]) for x in governance.pearson_or_zero(d, ["g"], "x", "y").collect()}
    assert r["a"] == (2, 0.0) and r["b"][0] == 2 and abs(r["b"][1] - 1) < 1e-9


def test_tier_limits_stay_at_equality(spark):
    d = spark.createDataFrame([(5, 100), (4, 100), (95, 100), (96, 100)], "p int, n int").select(governance.tier(F.col("p"), F.col("n")).alias("t"))
    assert [r["t"] for r in d.collect()] == ["stay", "move-up-one", "stay", "move-down-one"]


def test_isotonic_fit_pools_neighbours(spark):
    d = spark.createDataFrame([(3.0, 2.0, 1.0), (1.0, 3.0, 0.0), (1.0, 0.0, 2.0), (1.0, 2.0, 3.0)], "a double, b double, c double")
    f = d.select(*[x.alias(f"f{i}") for i, x in enumerate(governance.isotonic3(F.col("a"), F.col("b"), F.col("c")))])
    assert [tuple(r) for r in f.collect()] == [(3, 2, 1), (2, 2, 0), (1, 1, 1), (2, 2, 2)]


def test_universe_and_grid(spark):
    u = spark.createDataFrame([(i, "r") for i in range(5)], "unit bigint, repo string")
    t = spark.createDataFrame([(0, "r")], "target bigint, repo string")
    gone = spark.createDataFrame([(0, 3), (0, 4)], "target bigint, unit bigint")
    assert {r["unit"] for r in assembly.universe(u, t, "repo", [gone]).collect()} == {1, 2}
    assert assembly.cell_grid(t).count() == 1 + 8 * 3 + 9
