import math

import numpy as np
import pandas as pd

from tessella.operators import curves, fits

TOKENS = "cell_name string, win int, grp bigint, doc int, ctxb bigint, blen int, tok int, nll double"


def groups(spark, rows):
    return spark.createDataFrame(rows, "cell_name string, win int, grp bigint, doc int, ctxb bigint, blen bigint, nll double")


def test_two_rows_of_a_group_become_one(spark):
    t = spark.createDataFrame([("c", 0, 0, 5, 4, 3, 1, 1.0), ("c", 0, 0, 5, 7, 0, 2, 0.5), ("c", 0, 0, 5, 7, 0, 2, 0.5)], TOKENS)
    r = curves.collapse(curves.clean_tokens(t)).collect()
    assert len(r) == 1 and (r[0]["nll"], r[0]["blen"], r[0]["ctxb"], r[0]["mixed"]) == (1.5, 3, 4, False)


def test_broken_rules_are_reported(spark):
    t = spark.createDataFrame([("c", 0, 0, 1, 0, 3, 1, 1.0), ("c", 0, 0, 2, 1, 3, 1, 1.0), ("c", 0, 1, 1, 6, 0, 1, 1.0)], TOKENS)
    r = curves.conservation(t, curves.collapse(t)).first()
    assert (r["mixed_groups"], r["zero_byte_groups"], r["bytes_before"], r["bytes_after"]) == (1, 1, 6, 6)


def test_unusable_rows_are_dropped(spark):
    t = spark.createDataFrame([("c", 0, None, 1, 0, 3, 1, 1.0), ("c", 0, 1, 1, 0, 3, 1, None), ("c", 0, 1, 1, 0, 3, 1, float("nan")), ("c", 0, 1, 1, 0, 3, 1, -1.0)], TOKENS)
    assert curves.clean_tokens(t).count() == 0
    assert curves.bin_table(curves.collapse(t.limit(0))).count() == 0


def bins(spark, mids, bpb, windows=10, size=1):
    rows = [("c", i, float(m), float(b), windows, float(b) * math.log(2) * size, size) for i, (m, b) in enumerate(zip(mids, bpb))]
    return spark.createDataFrame(rows, "cell_name string, bin int, mid double, bpb double, n_windows int, nll double, bytes bigint")


def test_a_dip_does_not_count_as_flat(spark):
    b = bins(spark, [45, 90, 181, 362, 724], [1.5, 1.19, 1.40, 1.2, 1.2])
    assert {r["eps"]: r["c_hat"] for r in curves.flattening(b).collect()}[0.05] == 362.0
    b = bins(spark, [45, 90, 181], [0.60, 1.19, 1.20])
    assert {r["eps"]: r["c_hat"] for r in curves.flattening(b).collect()}[0.05] == 90.0


def test_gain_is_decade_minus_top(spark):
    b = bins(spark, [22, 45, 90, 724], [2.0, 1.8, 1.6, 1.0])
    assert abs(curves.context_gain(b).first()["context_gain"] - 0.8) < 1e-6


def test_bins_are_half_open_at_powers_of_two(spark):
    g = groups(spark, [("c", 0, i, 0, x, 1, 1.0) for i, x in enumerate([0, 1, 2, 3, 4, 2**18, 2**19])])
    got = sorted(r["bin"] for r in curves.binned(g).collect())
    assert got == [0, 1, 1, 2, 18]


def test_flipped_orientations_gain_alike(spark):
    a = groups(spark, [("c", 0, 1, 0, 10, 4, 2.0), ("c", 0, 2, 0, 100, 4, 1.0), ("c", 0, 3, 0, 5, 4, 1.0), ("c", 0, 4, 0, 5, 4, 1.0)])
    b = groups(spark, [("c", 0, 1, 0, 100, 4, 1.0), ("c", 0, 2, 0, 10, 4, 2.0), ("c", 0, 3, 0, 5, 4, 1.0), ("c", 0, 4, 0, 50, 3, 1.0)])
    p = curves.phase_pairs(a, b, ["grp"])
    assert p.where("not agrees").count() == 1
    r = curves.phase_gain(p.withColumnRenamed("stratum", "s").selectExpr("*", "1 as one"), ["one"]).first()
    assert r["n_pairs"] == 2 and r["frac_positive"] == 1.0 and abs(r["byte_weighted"] - 1 / (4 * math.log(2))) < 1e-9


def test_exact_power_law_is_accepted_and_holes_are_not():
    mids = np.geomspace(2, 120_000, 16)
    pdf = pd.DataFrame({"bin": range(16), "mid": mids, "bpb": 2 * mids**-0.4 + 1, "n_windows": 20})
    out = fits.gated_fit(pdf)
    assert out["accepted"] and abs(out["beta"] - 0.4) < 0.05
    assert fits.gated_fit(pdf.drop(index=7))["reason"].startswith("non-contiguous")
    assert fits.gated_fit(pdf.head(2))["reason"].startswith("insufficient")


def test_common_support_needs_the_bin_in_every_cell(spark):
    rows = [(c, i, float(m), 1.0 + i, 10, (1.0 + i) * math.log(2), 1) for c in ("a", "b") for i, m in enumerate([22, 45, 724]) if not (c == "b" and i == 2)]
    b = spark.createDataFrame(rows, "cell_name string, bin int, mid double, bpb double, n_windows int, nll double, bytes bigint")
    cells = spark.createDataFrame([("a", "m"), ("b", "m")], "cell_name string, g string")
    r = curves.common_support(b, cells, ["g"], "cell_name").collect()
    assert {(x["cell_name"], x["top_bin"], x["n_common_bins"]) for x in r} == {("a", 1, 2), ("b", 1, 2)}


def test_bootstrap_is_reproducible():
    rng = np.random.default_rng(0)
    nll, size = rng.random((30, 19)), np.ones((30, 19))
    a = fits.bootstrap_gain(nll, size, [4, 5], 8, 7)
    assert a == fits.bootstrap_gain(nll, size, [4, 5], 8, 7) and a[0] < a[1]


def test_bootstrap_merges_no_units(spark):
    n = 3_000
    rng = np.random.default_rng(1)
    cols = [f"b{b}" for b in range(19)]
    nll = pd.DataFrame(rng.random((2 * n, 19)), columns=cols).assign(cell_name=["a", "b"] * n, u=np.arange(2 * n) // 2)
    size = pd.DataFrame(rng.integers(1, 4, (2 * n, 19)), columns=cols).assign(cell_name=nll.cell_name, u=nll.u)
    units = [spark.createDataFrame(x) for x in (nll, size)]
    b = spark.createDataFrame([(c, i, float(m), 10) for c in "ab" for i, m in ((4, 22), (5, 45), (8, 724))], "cell_name string, bin int, mid double, n_windows int")
    run = lambda k, parts: {r["cell_name"]: r for r in fits.gain_intervals(*[x.repartition(parts) for x in units], b, "u", most_units=k).collect()}
    whole, spread = run(200_000, 3), run(500, 3)
    for c in "ab":
        low, high = (whole[c][x] for x in ("gain_low", "gain_high"))
        mine = nll[nll.cell_name == c].sort_values("u")[cols].to_numpy(), size[size.cell_name == c].sort_values("u")[cols].to_numpy(float)
        assert (low, high, 0) == fits.bootstrap_gain(*mine, [4, 5], 8, 7)
        assert whole[c]["n_units"] == spread[c]["n_units"] == n
        assert abs((spread[c]["gain_high"] - spread[c]["gain_low"]) / (high - low) - 1) < 0.25
        assert abs(spread[c]["gain_low"] + spread[c]["gain_high"] - low - high) < 0.5 * (high - low)
    again = run(500, 5)
    assert all(abs(again[c][x] - spread[c][x]) < 1e-9 for c in "ab" for x in ("gain_low", "gain_high"))


def test_multiplicities_are_poisson():
    m = fits.multiplicities(np.arange(2_000) * 7919 - 5_000, 7)
    assert m.shape == (2_000, 300) and abs(m.mean() - 1) < 0.01 and abs(m.var() - 1) < 0.02
    assert abs(np.corrcoef(m[:, 0], m[:, 1])[0, 1]) < 0.1
