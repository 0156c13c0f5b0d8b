import os
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm.proportions import draw, margin_report, rake, smallest
from tessella.llm.proportions_queries import targets
from tessella.llm.stable_sample import first_known, raised, set_rates, stable_sample
from tessella.llm.stable_sample_queries import RATES, picked_declarations, picked_targets, plan_seeds

DATA = os.environ.get("TESSELLA_TESTDATA", "/root/testdata")
PLAN = "plan string, cell string, share_bp int, min_rows int, n_requested int, a string, b string, weight double"


def test_raking_meets_margins_that_can_be_met():
    available = np.array([10.0, 90, 50, 50])
    targets_ = np.array([0.1, 0.4, 0.3, 0.2])
    mass = rake(available, targets_, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])])
    assert np.allclose([mass[0] + mass[1], mass[0] + mass[2]], [0.5, 0.4])
    assert rake(np.zeros(2), np.array([0.5, 0.5]), [np.array([0, 1])]).sum() == 0


def case(spark, sizes, plan):
    rnd = random.Random(4)
    rows = [("p", c, i * 100 + k, rnd.random(), "x") for i, (c, n) in enumerate(sizes.items()) for k in range(n)]
    members = spark.createDataFrame(rows, "plan string, cell string, id bigint, u double, weight string")
    return rows, *draw(members, spark.createDataFrame(plan, PLAN), "plan", "cell", ["a", "b"], "id", "u")


def test_quotas_are_met_and_gaps_reported(spark):
    plan = [("p", "a1", 5000, 0, 40, "a", "1", 0.0), ("p", "a2", 4500, 2, 40, "a", "2", 0.0), ("p", "b1", 500, 3, 40, "b", "1", 0.0), ("p", "b2", 0, 4, 40, "b", "2", 0.0), ("p", "b3", None, None, 40, "b", None, 0.0), ("q", "a1", 10000, 1, 5, "a", "1", 0.0)]
    rows, sample, report = case(spark, {"a1": 50, "a2": 10, "b1": 9, "b2": 0, "other": 5}, plan)
    rep = {(r["plan"], r["cell"]): r for r in report.collect()}
    assert {k: (r["needed"], r["gap"]) for k, r in rep.items()} == {("p", "a1"): (20, 0), ("p", "a2"): (18, 8), ("p", "b1"): (3, 0), ("p", "b2"): (4, 4), ("p", "b3"): (0, 0), ("q", "a1"): (5, 5)}
    got = [r["id"] for r in sample.collect()]
    assert len(got) == len(set(got)) == 40 and sum(r["drawn"] for r in rep.values()) == 40
    for c, k in (("a1", 20), ("a2", 10), ("b1", 3)):  # of each cell the smallest keys
        mine = sorted((x for x in rows if x[1] == c), key=lambda x: -x[3])
        n = rep["p", c]["drawn"]
        assert n >= k and {x[2] for x in mine[:n]} == {i for i in got if i in {x[2] for x in mine}}


def brute(rows, plan, weights):
    """The sample by its definition: weighted draw, quotas, then the draw's rows for the seats left."""
    key = {r[2]: -np.log(r[3]) / (weights[r[1]] or 1.0) for r in rows if r[1] in weights}
    by = {c: sorted((i for i in key if i // 100 == list(weights).index(c)), key=key.get) for c in weights}
    need = {c: max(-(-40 * bp // 10_000), least) for _, c, bp, least, *_ in plan}
    due = {i for c, ids in by.items() for i in ids[: need[c]]}
    first = sorted((i for c, ids in by.items() if weights[c] for i in ids), key=key.get)[:40]
    seats = 40 - sum(min(need[c], len(by[c])) for c in by)
    return due | set([i for i in first if i not in due][: max(seats, 0)])


def test_the_raked_weights_decide_the_seats_of_short_cells(spark, monkeypatch):
    # b1 is short; the other cell of margin b and of margin 1 take over, a2 does not
    plan = [("p", "a1", 2500, 0, 40, "a", "1", 0.0), ("p", "a2", 2500, 0, 40, "a", "2", 0.0), ("p", "b1", 2500, 0, 40, "b", "1", 0.0), ("p", "b2", 2500, 0, 40, "b", "2", 0.0)]
    sizes = {"a1": 90, "a2": 90, "b1": 2, "b2": 30}
    rows, sample, _ = case(spark, sizes, plan)
    mass = rake(np.array([90.0, 90, 2, 30]), np.full(4, 0.25), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])])
    raked = {r["id"] for r in sample.collect()}
    assert raked == brute(rows, plan, dict(zip(sizes, mass / np.array([90, 90, 2, 30]))))
    monkeypatch.setattr("tessella.llm.proportions.rake", lambda available, *_: available / available.sum())
    flat = {r["id"] for r in case(spark, sizes, plan)[1].collect()}
    assert flat == brute(rows, plan, dict.fromkeys(sizes, 1 / 212)) and flat != raked
    count = lambda ids, c: sum(i // 100 == list(sizes).index(c) for i in ids)
    off = lambda ids: abs(count(ids, "b1") + count(ids, "b2") - 20)
    assert off(raked) < off(flat)


def test_margins_are_reported(spark):
    plan = [("p", "a1", 5000, 0, 10, "a", "1", 0.0), ("p", "a2", 2500, 0, 10, "a", None, 0.0), ("p", "b1", 2500, 0, 10, "b", "1", 0.0), ("q", "a1", 10_000, 0, 3, "a", "1", 0.0)]
    _, sample, report = case(spark, {"a1": 8, "a2": 8, "b1": 1}, plan)
    got = {(r["plan"], r["margin"], r["category"]): (r["target_bp"], r["drawn"], r["achieved_bp"], r["residual_bp"]) for r in margin_report(report, "plan", ["a", "b"]).collect()}
    n = sample.count()
    assert got["p", "a", "b"][1] == 1 and got["p", "a", "a"][1] == n - 1 and got["q", "a", "a"] == (10_000, 0, None, None)
    assert got["p", "a", "b"] == (2500, 1, 10_000 // n, 10_000 // n - 2500) and ("p", "b", None) in got


def test_empty_members_and_empty_plan(spark):
    plan = [("p", "a1", 10000, 1, 4, "a", "1", 0.0)]
    none = spark.createDataFrame([], "plan string, cell string, id bigint, u double")
    sample, report = draw(none, spark.createDataFrame(plan, PLAN), "plan", "cell", ["a", "b"], "id", "u")
    assert sample.count() == 0 and report.first()["gap"] == 4
    sample, report = draw(spark.createDataFrame([("p", "a1", 1, 0.5)], "plan string, cell string, id bigint, u double"), spark.createDataFrame([], PLAN), "plan", "cell", ["a", "b"], "id", "u")
    assert sample.count() == 0 and report.count() == 0


def test_smallest_keeps_exact_numbers_with_ties(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", (F.floor(F.col("id") / 100) + 1).cast("double").alias("k"))
    q = spark.createDataFrame([(0, 120), (1, 1), (2, 10_000)], "g bigint, quota bigint")
    got = smallest(d, ["g"], "k", "id", q)
    assert {r["g"]: r["n"] for r in got.groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 120, 1: 1, 2: 333}
    assert {r["id"] for r in got.where("g = 0").collect()} == {3 * i for i in range(120)}


def test_targets_resolve_dirty_rows(spark):
    cols = "row_no bigint, target_id bigint, repo string, lang string, length_tercile int, centrality_tercile int, first_add_utc string, cell string, batch_no int, recorded_at timestamp"
    rows = [
        (1, 1, "r", "lean", None, None, "2024-11-13T00:59:59+01:00", " l2_d3_cpost", 1, None),
        (2, 1, "r", "lean", None, None, "2024-11-13T00:59:59+01:00", None, 2, None),
        (3, 2, "r", "lean", 1, None, None, "L3D2Cpre", 1, None),
        (4, None, "r", "lean", 1, 1, None, None, 1, None),
        (5, 3, "r", None, None, None, "nonsense", "??", None, None),
    ]
    got = {r["target_id"]: (r["l"], r["d"], str(r["added"])) for r in targets(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: (2, 3, "2024-11-12 23:59:59"), 2: (1, 2, "None"), 3: (None, None, "None")}


def test_what_is_picked_stays_picked(spark):
    rates = spark.createDataFrame([("a", 100_000), ("a", 50_000), ("b", 2_000_000), ("c", None), ("d", -5)], "s string, rate_ppm bigint")
    assert {r["s"]: r["rate_ppm"] for r in raised(rates, ["s"]).collect()} == {"a": 100_000, "b": 1_000_000, "d": 0}
    all_rows = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"), F.lit(1).alias("rate_ppm"), F.lit("x").alias("extra"))
    pick = lambda df, r: {x["id"] for x in stable_sample(df, ["s"], F.concat_ws(":", F.lit("seed"), "id"), r).collect()}
    whole = pick(all_rows, rates)
    early = pick(all_rows.where("id < 2500").repartition(7), rates)
    assert early == {i for i in whole if i < 2500}
    more = pick(all_rows, rates.union(spark.createDataFrame([("a", 200_000)], "s string, rate_ppm bigint")))
    assert whole <= more and len(more) > len(whole)
    share = sum(1 for i in whole if i % 2 == 0) / 2500
    assert 0.07 < share < 0.13 and sum(1 for i in whole if i % 2) == 2500


def test_later_deliveries_drop_nothing_on_the_given_tables(spark):
    read = lambda name: spark.read.parquet(f"{DATA}/sf0.01/{name}.parquet")
    rates, seeds = spark.createDataFrame(RATES, "stratum string, rate_ppm bigint"), plan_seeds(read("sample_plans")).cache()
    for rows, no, pick, key in ((read("candidates"), "batch_no", picked_targets, "target_id"), (read("definition_parents"), "run_no", picked_declarations, "decl_id")):
        before, sizes = set(), []
        for n in sorted(r[0] for r in rows.select(no).distinct().collect() if r[0] is not None):
            now = {(r[key], r["key_hash"]) for r in pick(rows.where(f"{no} is null or {no} <= {n}").repartition(3 + n % 4), seeds, rates).collect()}
            assert before <= now
            before = now
            sizes.append(len(now))
        assert sizes[-1] > 0 and sizes == sorted(sizes)


def test_later_rows_do_not_change_what_is_known(spark):
    rows = [("k", 2, "b", None), ("k", 1, "c", None), ("k", 3, "a", "x"), ("k", 4, None, "w"), ("m", None, "z", None), ("m", 1, "a", "q"), (None, 1, "a", "a")]
    d = spark.createDataFrame(rows, "k string, n int, v string, w string")
    assert {tuple(r) for r in first_known(d, "k", "n", ["v", "w"]).collect()} == {("k", "c", "x"), ("m", "z", "q")}


def test_thresholds_in_a_table_are_only_raised(spark, tmp_path):
    rate = lambda n: spark.createDataFrame([("a", n)], "s string, rate_ppm bigint")
    seen = [raised(set_rates(spark, f"file://{tmp_path}/rates", rate(n)), ["s"]).first()["rate_ppm"] for n in (10, 40, 20)]
    assert seen == [10, 40, 40]
    d = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    plan = stable_sample(d, [], F.col("k"), rate(300_000))
    assert 200 < plan.count() < 400 and "NestedLoop" not in plan._jdf.queryExecution().toString()


def test_null_keys_and_strata_are_not_picked(spark):
    d = spark.createDataFrame([(None, "b"), ("k", None), ("k", "b"), ("k", "b"), ("k", "zz")], "k string, s string")
    rates = spark.createDataFrame([("b", 1_000_000)], "s string, rate_ppm bigint")
    assert stable_sample(d, ["s"], F.col("k"), rates).count() == 2
    assert stable_sample(d.limit(0), ["s"], F.col("k"), rates).count() == 0
