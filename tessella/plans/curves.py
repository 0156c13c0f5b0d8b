"""Queries over token_dump: groups, bins, curves, masks, comparisons, phases, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import curves, fits
from tessella.sources.tables import table

# Cutoffs of the compared models.
CUTOFFS = {"c2024_11": "2024-11-12", "c2025_04": "2025-04-29", "c2026_02": "2026-03-01"}


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return curves.clean_tokens(table(spark, d, "token_dump"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return curves.collapse(_tokens(spark, d))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").groupBy(F.col("file_id").alias("doc")).agg(F.min("add_date").alias("date"), F.max("provenance_flag").alias("flag"))


def collapse_groups(spark, d):
    return _groups(spark, d).select("cell_name", "win", "grp", "doc", "ctxb", "blen", _r("nll"), "n_tokens", "mixed")


def collapse_conservation(spark, d):
    return curves.conservation(_tokens(spark, d), _groups(spark, d)).select(
        "cell_name", "n_rows", "n_groups", "bytes_before", "bytes_after", _r("nll_before"), _r("nll_after"), "mixed_groups", "zero_byte_groups"
    )


def _bins(spark, d, scale=1.0):
    return curves.bin_table(_groups(spark, d), scale=scale)


_BIN_COLUMNS = ["cell_name", "bin", "bytes", "n_groups", "n_windows", "n_docs"]


def bin_table(spark, d):
    return _bins(spark, d).select(*_BIN_COLUMNS, _r("nll"), _r("bpb"), _r("bpb_median"), _r("mid"))


def bin_table_alt_edges(spark, d):
    return _bins(spark, d, 1.5).select(*_BIN_COLUMNS, _r("nll"), _r("bpb"), _r("bpb_median"), _r("mid"))


def overall_bpb(spark, d):
    return curves.cell_summary(_groups(spark, d)).select("cell_name", "n_groups", "bytes_scored", _r("overall_bpb"))


def cell_classification(spark, d):
    return curves.cell_summary(_groups(spark, d)).select("cell_name", "n_windows", "n_docs", "n_unattributed", "quantitative")


def unit_bin_pivot(spark, d):
    return curves.unit_pivot(_groups(spark, d), "win").select("cell_name", "win", *[F.round(f"b{b}", 6).alias(f"b{b}") for b in range(curves.N_BINS)])


def context_gain(spark, d):
    return curves.context_gain(_bins(spark, d), floor=2).select("cell_name", "top_bin", _r("low_bpb"), _r("top_bpb"), _r("context_gain"))


def flattening_point(spark, d):
    return curves.flattening(_bins(spark, d), floor=2).select("cell_name", "eps", _r("c_hat"))


def _masked(spark, d, flagged):
    groups = _groups(spark, d)
    docs = _docs(spark, d)
    out = None
    for name, cutoff in CUTOFFS.items():
        part = curves.cell_summary(curves.doc_mask(groups, docs, cutoff, flagged)).select(
            F.lit(name).alias("cutoff"), "cell_name", "n_docs", "bytes_scored", _r("overall_bpb"), ((F.col("n_docs") >= 20) & (F.col("bytes_scored") >= 300_000)).alias("above_floor")
        )
        out = part if out is None else out.unionByName(part)
    return out


def masked_targets(spark, d):
    return _masked(spark, d, False)


def masked_noflag(spark, d):
    return _masked(spark, d, True)


def _stream(spark, d):
    """One row per file: size of the text in bytes, earliest date."""
    return table(spark, d, "source_files").where("text is not null").groupBy("file_id", "repo").agg(F.min("add_date").alias("date"), F.max(F.octet_length("text")).cast("bigint").alias("bytes"))


def masking_mass(spark, d):
    cuts = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("date")) for k, v in CUTOFFS.items()]))
    return (
        _stream(spark, d)
        .withColumn("c", cuts)
        .groupBy(F.col("c.name").alias("cutoff"), "repo")
        .agg(F.count_if(F.col("date") > F.col("c.date")).alias("n_docs"), F.coalesce(F.sum(F.when(F.col("date") > F.col("c.date"), F.col("bytes"))), F.lit(0).cast("bigint")).alias("bytes"))
    )


def feasible_sets(spark, d):
    """Repos above the floors per cutoff, as one sorted set."""
    return masking_mass(spark, d).groupBy("cutoff").agg(F.array_join(F.array_sort(F.collect_list(F.when((F.col("n_docs") >= 5) & (F.col("bytes") >= 5_000), F.col("repo")))), "|").alias("repos"))


def _cells(spark, d):
    m = table(spark, d, "cells_meta").where("stream_kind in ('full_topo', 'full_shuffled') or stream_kind like 'clean%'")
    cls = F.when(F.col("stream_kind") == "full_topo", "full").when(F.col("stream_kind") == "full_shuffled", "shuffled").otherwise(F.col("stream_kind"))
    return m.select("cell_name", "model_name", cls.alias("cls"))


def common_support_comparison(spark, d):
    return curves.common_support(_bins(spark, d), _cells(spark, d), ["model_name", "cls"], "cell_name", floor=2).select(
        "model_name", "cls", "cell_name", "top_bin", "n_common_bins", _r("decade_bpb"), _r("top_common_bpb"), _r("gain_common")
    )


def _line_dump(spark, d, offset: int = 0) -> DataFrame:
    """Line items as token rows: orders are groups, ship months windows; context is the bytes before in the window."""
    li = table(spark, d, "lineitem").select(
        F.date_format("l_shipdate", "yyyyMM").cast("int").alias("win"),
        F.col("l_orderkey").alias("grp"),
        F.col("l_linenumber").cast("int").alias("tok"),
        F.col("l_suppkey").cast("int").alias("doc"),
        F.col("l_quantity").cast("int").alias("blen"),
        F.round(F.col("l_extendedprice") / 10_000, 5).alias("nll"),
    )
    before = F.coalesce(F.sum("blen").over(Window.partitionBy("win").orderBy("grp", "tok", "doc", "nll").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return li.withColumn("ctxb", before - offset).where(F.col("ctxb") >= 0)


def _line_groups(spark, d, offset=0):
    return curves.collapse(_line_dump(spark, d, offset), keys=()).where("not mixed")


def _pairs(spark, d):
    return curves.phase_pairs(_line_groups(spark, d), _line_groups(spark, d, 1_000), ["win", "grp"])


def phase_pair_gain(spark, d):
    return curves.phase_gain(_pairs(spark, d), ["win"]).select("win", "n_pairs", "n_docs", _r("byte_weighted"), _r("equal_group"), _r("frac_positive"))


def phase_pair_strata(spark, d):
    return curves.phase_gain(_pairs(spark, d), ["stratum"]).select("stratum", "n_pairs", _r("byte_weighted"), _r("equal_group"))


def fit_gate_support(spark, d):
    return curves.fit_support(_bins(spark, d), floor=2)


def powerlaw_fit(spark, d):
    bins = curves.bin_table(_line_groups(spark, d).withColumn("cell", F.lit("all")), keys=("cell",))
    return fits.fits(bins, "cell")


def bootstrap_gain_ci(spark, d):
    groups = _groups(spark, d)
    return fits.gain_intervals(curves.unit_pivot(groups, "win"), curves.unit_pivot(groups, "win", value="blen"), curves.bin_table(groups), "win", floor=2)


def bootstrap_gain_ci_docs(spark, d):
    groups = _groups(spark, d)
    return fits.gain_intervals(curves.unit_pivot(groups, "doc"), curves.unit_pivot(groups, "doc", value="blen"), curves.bin_table(groups), "doc", seed=11, floor=2)


def zero_row_share(spark, d):
    """Share of zero-byte rows per cell."""
    t = table(spark, d, "token_dump").distinct()
    return t.groupBy("cell_name").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("blen") == 0).alias("zero_rows"), F.round(F.count_if(F.col("blen") == 0) / F.count(F.lit(1)), 6).alias("share"), F.count_distinct("win", "grp").alias("n_groups"))


def nll_sanity(spark, d):
    """Rows that cannot be scored, by reason."""
    t = table(spark, d, "token_dump")
    return t.groupBy("cell_name").agg(
        F.count_if(F.col("nll").isNull()).alias("null_nll"), F.count_if(F.isnan("nll")).alias("nan_nll"), F.count_if((F.col("nll") < 0) & ~F.isnan("nll")).alias("negative_nll"), F.count_if(F.col("grp").isNull()).alias("null_grp")
    )


def opening_group_drop(spark, d):
    """Bytes charged per window once the first group, which is context only, is dropped."""
    g = _groups(spark, d)
    w = Window.partitionBy("cell_name", "win").orderBy("ctxb", "grp")
    kept = g.withColumn("k", F.row_number().over(w))
    return kept.groupBy("cell_name", "win").agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("blen"))), F.lit(0).cast("bigint")).alias("charged_bytes"), F.sum(F.when(F.col("k") == 1, F.col("blen"))).alias("opening_bytes"))


def delta_quantiles(spark, d):
    """Distribution of nll differences between two chunk phases of one group."""
    p = _pairs(spark, d).where("agrees").withColumn("delta", F.round(F.col("nll_p") - F.col("nll_0") + F.col("ctxb_0") / 1e6, 6))
    a = F.abs("delta")
    return p.groupBy("win").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(curves.exact_sum("delta") / F.count(F.lit(1)), 6).alias("mean"),
        F.round(curves.exact_sum(a) / F.count(F.lit(1)), 6).alias("mean_abs"),
        F.round(F.percentile(a, 0.5), 9).alias("p50"),
        F.round(F.percentile(a, 0.9), 9).alias("p90"),
        F.round(F.percentile(a, 0.99), 9).alias("p99"),
        F.round(F.max(a), 6).alias("max_abs"),
    )


def delta_by_stratum(spark, d):
    """First, boundary (32 rows) and interior rows of chunks of 512 within a window."""
    t = _line_dump(spark, d)
    j = F.row_number().over(Window.partitionBy("win").orderBy("grp", "tok", "doc", "nll")) - 1
    k = F.pmod(j, F.lit(512))
    rows = t.withColumn("stratum", F.when(j == 0, "first").when(k < 32, "boundary").otherwise("interior"))
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.round(curves.exact_sum(F.abs(F.col("nll") - 1)) / F.count(F.lit(1)), 6).alias("mean_abs"), F.round(F.max(F.abs(F.col("nll") - 1)), 6).alias("max_abs"))


_NAMES = """collapse_groups collapse_conservation bin_table bin_table_alt_edges overall_bpb cell_classification unit_bin_pivot context_gain flattening_point masked_targets
masked_noflag masking_mass feasible_sets common_support_comparison phase_pair_gain phase_pair_strata fit_gate_support powerlaw_fit bootstrap_gain_ci bootstrap_gain_ci_docs zero_row_share
nll_sanity opening_group_drop delta_quantiles delta_by_stratum""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_D = "d AS (SELECT DISTINCT * FROM token_dump WHERE grp IS NOT NULL AND nll IS NOT NULL AND NOT isnan(nll) AND nll >= 0)"
_S = "cast(sum(cast(nll AS DECIMAL(28,8))) AS DOUBLE)"
_G = f"""{_D}, g AS (SELECT cell_name, win, grp, min({{'a': ctxb, 'b': tok, 'c': doc}}).c AS doc, min(ctxb) AS ctxb, cast(sum(blen) AS BIGINT) AS blen, {_S} AS nll,
  count(*) AS n_tokens, max(doc) <> min(doc) AS mixed FROM d GROUP BY cell_name, win, grp)"""


def _bins_sql(scale: float = 1.0) -> str:
    return f"""b AS (SELECT cell_name, cast(floor(log2(ctxb / {scale})) AS INT) AS bin, {_S} AS nll, cast(sum(blen) AS BIGINT) AS bytes, count(*) AS n_groups, count(DISTINCT win) AS n_windows,
  count(DISTINCT CASE WHEN doc >= 0 THEN doc END) AS n_docs, median(round(nll / ln(2) / blen, 5)) AS bpb_median FROM g WHERE ctxb >= {scale} AND ctxb < {scale} * 524288 AND blen > 0 GROUP BY ALL),
  bins AS (SELECT *, nll / ln(2) / bytes AS bpb, sqrt(pow(2.0, bin) * pow(2.0, bin + 1)) * {scale} AS mid FROM b)"""


_B = f"{_G}, {_bins_sql()}"
_SHOW = "SELECT cell_name, bin, bytes, n_groups, n_windows, n_docs, round(nll, 6) AS nll, round(bpb, 6) AS bpb, round(bpb_median, 6) AS bpb_median, round(mid, 6) AS mid FROM bins"
_DOCS = "docs AS (SELECT file_id AS doc, min(add_date) AS date, bool_or(provenance_flag) AS flag FROM source_files GROUP BY file_id)"
_CUTS = "cuts(cutoff, date) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CUTOFFS.items()) + ")"


def _mask_sql(extra: str) -> str:
    return f"""WITH {_G}, {_DOCS}, {_CUTS} SELECT c.cutoff, g.cell_name, count(DISTINCT CASE WHEN g.doc >= 0 THEN g.doc END) AS n_docs, cast(sum(blen) AS BIGINT) AS bytes_scored,
  round({_S} / ln(2) / nullif(sum(blen), 0), 6) AS overall_bpb, count(DISTINCT CASE WHEN g.doc >= 0 THEN g.doc END) >= 20 AND sum(blen) >= 300000 AS above_floor
  FROM g JOIN docs ON g.doc = docs.doc JOIN cuts c ON docs.date > c.date {extra} GROUP BY c.cutoff, g.cell_name"""


_MASS = f"""{_CUTS}, f AS (SELECT file_id, repo, min(add_date) AS date, max(octet_length(encode(text))) AS bytes FROM source_files WHERE text IS NOT NULL GROUP BY file_id, repo),
  mass AS (SELECT cutoff, repo, count(*) FILTER (WHERE f.date > cuts.date) AS n_docs, cast(coalesce(sum(bytes) FILTER (WHERE f.date > cuts.date), 0) AS BIGINT) AS bytes FROM f, cuts GROUP BY cutoff, repo)"""
_LINES = """li AS (SELECT cast(strftime(l_shipdate, '%Y%m') AS INT) AS win, l_orderkey AS grp, cast(l_linenumber AS INT) AS tok, cast(l_suppkey AS INT) AS doc, cast(l_quantity AS INT) AS blen,
  round(l_extendedprice / 10000, 5) AS nll FROM lineitem),
  ld AS (SELECT *, cast(coalesce(sum(blen) OVER (PARTITION BY win ORDER BY grp, tok, doc, nll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM li)"""


def _lg(name: str, off: int) -> str:
    return f"""{name} AS (SELECT win, grp, min({{'a': c, 'b': tok, 'c': doc}}).c AS doc, min(c) - {off} AS ctxb, cast(sum(blen) AS BIGINT) AS blen, {_S} AS nll
  FROM ld WHERE c >= {off} GROUP BY win, grp HAVING max(doc) = min(doc))"""


_PAIRS = f"""{_LINES}, {_lg("p0", 0)}, {_lg("pp", 1000)}, j AS (SELECT p0.win, p0.grp, p0.doc AS doc_0, p0.blen AS blen_0, p0.nll AS nll_0, pp.nll AS nll_p, p0.ctxb AS ctxb_0,
  -sign(pp.ctxb - p0.ctxb) * (pp.nll - p0.nll) AS nats, cast(round_even(log2(greatest(pp.ctxb, p0.ctxb) / greatest(least(pp.ctxb, p0.ctxb), 1)), 0) AS INT) AS stratum
  FROM p0 JOIN pp ON p0.win = pp.win AND p0.grp = pp.grp WHERE pp.ctxb <> p0.ctxb AND p0.blen = pp.blen AND p0.doc = pp.doc)"""
_EX = lambda e: f"cast(sum(cast({e} AS DECIMAL(28,8))) AS DOUBLE)"

ORACLE = {
    "collapse_groups": f"WITH {_G} SELECT cell_name, win, grp, doc, ctxb, blen, round(nll, 6) AS nll, n_tokens, mixed FROM g",
    "collapse_conservation": f"""WITH {_G}, a AS (SELECT cell_name, count(*) AS n_rows, cast(sum(blen) AS BIGINT) AS bytes_before, round({_S}, 6) AS nll_before FROM d GROUP BY cell_name),
      z AS (SELECT cell_name, count(*) AS n_groups, cast(sum(blen) AS BIGINT) AS bytes_after, round({_S}, 6) AS nll_after, count(*) FILTER (WHERE mixed) AS mixed_groups,
      count(*) FILTER (WHERE blen <= 0) AS zero_byte_groups FROM g GROUP BY cell_name) SELECT * FROM a JOIN z USING (cell_name)""",
    "bin_table": f"WITH {_B} {_SHOW}",
    "bin_table_alt_edges": f"WITH {_G}, {_bins_sql(1.5)} {_SHOW}",
    "overall_bpb": f"WITH {_G} SELECT cell_name, count(*) AS n_groups, cast(sum(blen) AS BIGINT) AS bytes_scored, round({_S} / ln(2) / nullif(sum(blen), 0), 6) AS overall_bpb FROM g GROUP BY cell_name",
    "cell_classification": f"""WITH {_G} SELECT cell_name, count(DISTINCT win) AS n_windows, count(DISTINCT CASE WHEN doc >= 0 THEN doc END) AS n_docs, count(*) FILTER (WHERE doc < 0) AS n_unattributed,
      count(DISTINCT win) >= 15 AND count(DISTINCT CASE WHEN doc >= 0 THEN doc END) >= 30 AS quantitative FROM g GROUP BY cell_name""",
    "unit_bin_pivot": f"WITH {_G}, r AS (SELECT *, cast(floor(log2(ctxb)) AS INT) AS bin FROM g WHERE ctxb >= 1 AND ctxb < 524288 AND blen > 0 AND win >= 0) SELECT cell_name, win, "
    + ", ".join(f"round(coalesce(cast(sum(cast(nll AS DECIMAL(28,8))) FILTER (WHERE bin = {b}) AS DOUBLE), 0), 6) AS b{b}" for b in range(curves.N_BINS))
    + " FROM r GROUP BY cell_name, win",
    "context_gain": f"""WITH {_B}, v AS (SELECT * FROM bins WHERE n_windows >= 2), a AS (SELECT cell_name, {_EX("nll")} / ln(2) / sum(bytes) AS low FROM v WHERE mid >= 16 AND mid < 256 GROUP BY cell_name),
      t AS (SELECT cell_name, max(bin) AS top_bin, arg_max(bpb, bin) AS top FROM v GROUP BY cell_name)
      SELECT cell_name, top_bin, round(low, 6) AS low_bpb, round(top, 6) AS top_bpb, round(low - top, 6) AS context_gain FROM a JOIN t USING (cell_name)""",
    "flattening_point": f"""WITH {_B}, v AS (SELECT *, last_value(bpb) OVER (PARTITION BY cell_name ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top FROM bins WHERE n_windows >= 2),
      e(eps) AS (VALUES (cast(0.05 AS DOUBLE)), (cast(0.1 AS DOUBLE))), s AS (SELECT cell_name, eps, mid, bool_and(abs(bpb - top) <= eps) OVER (PARTITION BY cell_name, eps ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok FROM v, e)
      SELECT cell_name, eps, round(min(mid), 6) AS c_hat FROM s WHERE ok GROUP BY cell_name, eps""",
    "masked_targets": _mask_sql(""),
    "masked_noflag": _mask_sql("AND NOT coalesce(docs.flag, false)"),
    "masking_mass": f"WITH {_MASS} SELECT * FROM mass",
    "feasible_sets": f"WITH {_MASS} SELECT cutoff, coalesce(string_agg(repo, '|' ORDER BY repo) FILTER (WHERE n_docs >= 5 AND bytes >= 5000), '') AS repos FROM mass GROUP BY cutoff",
    "common_support_comparison": f"""WITH {_B}, c AS (SELECT cell_name, model_name, CASE stream_kind WHEN 'full_topo' THEN 'full' WHEN 'full_shuffled' THEN 'shuffled' ELSE stream_kind END AS cls FROM cells_meta
      WHERE stream_kind IN ('full_topo', 'full_shuffled') OR stream_kind LIKE 'clean%'), v AS (SELECT * FROM bins JOIN c USING (cell_name) WHERE n_windows >= 2),
      n AS (SELECT model_name, cls, count(DISTINCT cell_name) AS k FROM v GROUP BY ALL HAVING count(DISTINCT cell_name) >= 2),
      sh AS (SELECT v.model_name, v.cls, bin FROM v JOIN n ON v.model_name = n.model_name AND v.cls = n.cls GROUP BY v.model_name, v.cls, bin, k HAVING count(DISTINCT cell_name) = k),
      tp AS (SELECT model_name, cls, max(bin) AS top_bin, count(*) AS n_common_bins FROM sh GROUP BY ALL),
      o AS (SELECT v.model_name, v.cls, cell_name, top_bin, n_common_bins, cast(sum(cast(nll AS DECIMAL(28,8))) FILTER (WHERE mid >= 16 AND mid < 256) AS DOUBLE) / ln(2) / sum(bytes) FILTER (WHERE mid >= 16 AND mid < 256) AS dec,
      max(bpb) FILTER (WHERE v.bin = top_bin) AS top FROM v JOIN sh ON v.model_name = sh.model_name AND v.cls = sh.cls AND v.bin = sh.bin JOIN tp ON tp.model_name = v.model_name AND tp.cls = v.cls GROUP BY ALL)
      SELECT model_name, cls, cell_name, top_bin, n_common_bins, round(dec, 6) AS decade_bpb, round(top, 6) AS top_common_bpb, round(dec - top, 6) AS gain_common FROM o WHERE dec IS NOT NULL""",
    "phase_pair_gain": f"""WITH {_PAIRS} SELECT win, count(*) AS n_pairs, count(DISTINCT CASE WHEN doc_0 >= 0 THEN doc_0 END) AS n_docs, round({_EX("nats")} / ln(2) / sum(blen_0), 6) AS byte_weighted,
      round({_EX("nats / ln(2) / blen_0")} / count(*), 6) AS equal_group, round(count(*) FILTER (WHERE nats / ln(2) / blen_0 > 0) / count(*), 6) AS frac_positive FROM j GROUP BY win""",
    "phase_pair_strata": f"WITH {_PAIRS} SELECT stratum, count(*) AS n_pairs, round({_EX('nats')} / ln(2) / sum(blen_0), 6) AS byte_weighted, round({_EX('nats / ln(2) / blen_0')} / count(*), 6) AS equal_group FROM j GROUP BY stratum",
    "fit_gate_support": f"""WITH {_B}, s AS (SELECT cell_name, count(*) AS n_valid, max(bin) - min(bin) + 1 = count(*) AS contiguous, count(*) FILTER (WHERE mid <= 8192) AS n_fit_bins,
      count(*) FILTER (WHERE mid > 8192) AS n_holdout_bins FROM bins WHERE n_windows >= 2 GROUP BY cell_name) SELECT *, contiguous AND n_fit_bins >= 5 AND n_holdout_bins >= 2 AS enough FROM s""",
    "zero_row_share": """WITH t AS (SELECT DISTINCT * FROM token_dump) SELECT cell_name, count(*) AS n_tokens, count(*) FILTER (WHERE blen = 0) AS zero_rows, round(count(*) FILTER (WHERE blen = 0) / count(*), 6) AS share,
      (SELECT count(*) FROM (SELECT DISTINCT win, grp FROM t u WHERE u.cell_name = t.cell_name AND win IS NOT NULL AND grp IS NOT NULL)) AS n_groups FROM t GROUP BY cell_name""",
    "nll_sanity": """SELECT cell_name, count(*) FILTER (WHERE nll IS NULL) AS null_nll, count(*) FILTER (WHERE isnan(nll)) AS nan_nll, count(*) FILTER (WHERE nll < 0 AND NOT isnan(nll)) AS negative_nll,
      count(*) FILTER (WHERE grp IS NULL) AS null_grp FROM token_dump GROUP BY cell_name""",
    "opening_group_drop": f"""WITH {_G}, k AS (SELECT *, row_number() OVER (PARTITION BY cell_name, win ORDER BY ctxb, grp) AS k FROM g)
      SELECT cell_name, win, cast(coalesce(sum(blen) FILTER (WHERE k > 1), 0) AS BIGINT) AS charged_bytes, cast(sum(blen) FILTER (WHERE k = 1) AS BIGINT) AS opening_bytes FROM k GROUP BY cell_name, win""",
    "delta_quantiles": f"""WITH {_PAIRS}, q AS (SELECT win, round(nll_p - nll_0 + ctxb_0 / 1e6, 6) AS delta FROM j) SELECT win, count(*) AS n, round({_EX("delta")} / count(*), 6) AS mean, round({_EX("abs(delta)")} / count(*), 6) AS mean_abs,
      round(quantile_cont(abs(delta), 0.5), 9) AS p50, round(quantile_cont(abs(delta), 0.9), 9) AS p90, round(quantile_cont(abs(delta), 0.99), 9) AS p99, round(max(abs(delta)), 6) AS max_abs FROM q GROUP BY win""",
    "delta_by_stratum": f"""WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY grp, tok, doc, nll) - 1 AS k FROM ld)
      SELECT CASE WHEN k = 0 THEN 'first' WHEN k % 512 < 32 THEN 'boundary' ELSE 'interior' END AS stratum, count(*) AS n, round({_EX("abs(nll - 1)")} / count(*), 6) AS mean_abs, round(max(abs(nll - 1)), 6) AS max_abs FROM r GROUP BY 1""",
}
