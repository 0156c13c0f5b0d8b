"""Queries of spans, attribution, contrasts, reliability, grids and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import governance as G
from tessella.operators import selection, spans
from tessella.plans.curves import _groups
from tessella.plans.selection import _F, _files
from tessella.scratch import Scratch
from tessella.sources.tables import table


def _r(c, n=6):
    return F.round(c, n).alias(c)


# ---- spans


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    """Character spans of the tokens of a window with some overlap: a token reaches one byte into the one before if its id is even."""
    t = table(spark, d, "token_dump").where("grp is not null and blen is not null").groupBy("cell_name", "win", "ctxb", "tok").agg(F.max("blen").alias("blen"), F.max(F.when(~F.isnan("nll"), F.col("nll"))).alias("nll"))
    start = F.greatest(F.col("ctxb") - F.when(F.col("tok") % 2 == 0, 1).otherwise(0), F.lit(0))
    return t.select("cell_name", "win", "tok", "nll", start.alias("start"), (F.col("ctxb") + F.col("blen")).alias("end"))


def token_span_islands(spark, d):
    g = spans.islands(_offsets(spark, d), ["cell_name", "win"], order=["start", "end", "tok"])
    return g.groupBy("cell_name", "win", "grp").agg(F.count(F.lit(1)).alias("tokens"), F.sum("new").alias("bytes"))


def interval_merge(spark, d):
    """Stretches of badly predicted tokens (one nat and more), overlapping or adjacent ones joined."""
    return spans.merged(_offsets(spark, d).where("nll >= 1"), ["cell_name", "win"])


def _window_lengths(spark, d):
    return _offsets(spark, d).groupBy("cell_name", "win").agg(F.max("end").alias("length"))


def interval_complement(spark, d):
    return spans.complement(interval_merge(spark, d), _window_lengths(spark, d), ["cell_name", "win"], "length")


def budget_suffix_units(spark, d):
    """Units of each assembled order inside the last bytes of its rendering, by the bytes of the unit with that id; ids without a unit are passed over."""
    o = table(spark, d, "assembly_orders").where("order_id is not null").groupBy("order_id").agg(F.min_by("unit_order", "built_at").alias("l"))
    sizes = table(spark, d, "units").where("payload is not null").groupBy(F.col("unit_id").alias("unit")).agg(F.min(F.octet_length("payload")).cast("bigint").alias("size"))
    units = o.select("order_id", F.posexplode("l").alias("pos", "unit")).join(sizes, "unit")
    return spans.suffix_budget(units, ["order_id"], ["pos"], "size", [1024, 4096]).select("order_id", "budget", "pos", "unit", "bytes_in", "whole", "eligible")


def _manifest(spark, d):
    return selection.running_spans(_files(spark, d), ["repo"], ["rel", "file_id"], "bytes").select("repo", F.col("file_id").alias("id"), "start", "end")


def doc_of_position(spark, d):
    """The file at every 997th byte of each repo's stream; -1 behind its end."""
    m = _manifest(spark, d)
    ends = m.groupBy("repo").agg(F.max("end").alias("total"))
    points = ends.select("repo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") + 997, F.lit(997).cast("bigint"))).alias("pos"))
    return spans.span_at(points, m, ["repo"], "pos", 4096, "file_id")


def group_doc_attribution(spark, d):
    """Blocks of 512 bytes belong to a file only if both their ends do."""
    m = _manifest(spark, d)
    ends = m.groupBy("repo").agg(F.max("end").alias("total"))
    blocks = ends.select("repo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(512).cast("bigint"))).alias("lo"), "total").withColumn("hi", F.least(F.col("lo") + 511, F.col("total") - 1)).drop("total")
    first = spans.span_at(blocks, m, ["repo"], "lo", 4096, "a")
    both = spans.span_at(first, m, ["repo"], "hi", 4096, "b")
    return both.select("repo", "lo", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(-1).alias("file_id"))


_CLASSES = ("word", "literal", "symbol", "comment", "layout")


def _source_spans(spark, d):
    """Spans of five classes over each window, 7 to 11 bytes long in turn."""
    lengths = _window_lengths(spark, d)
    k = F.explode(F.sequence(F.lit(0), F.expr("cast((length - 1) div 9 as int)")))
    rows = lengths.where("length > 0").withColumn("k", k)
    cls = F.element_at(F.array(*map(F.lit, _CLASSES)), F.pmod(F.col("k") * 7 + F.col("win"), F.lit(5)) + 1)
    return rows.select("cell_name", "win", cls.alias("a_id"), (F.col("k") * 9).cast("bigint").alias("start"), F.least(F.col("k") * 9 + 9, F.col("length")).alias("end"))


def _model_groups(spark, d):
    g = _groups(spark, d).where("blen > 0")
    return g.select("cell_name", "win", F.col("grp").alias("b_id"), F.col("ctxb").alias("start"), (F.col("ctxb") + F.col("blen")).alias("end"), "nll", "blen")


def span_overlap_attribution(spark, d):
    g = _model_groups(spark, d)
    return spans.overlaps(_source_spans(spark, d), g.drop("nll", "blen"), ["cell_name", "win"], 64).select("cell_name", "win", F.col("a_id").alias("cls"), F.col("b_id").alias("grp"), "bytes")


def _class_nll(spark, d):
    g = _model_groups(spark, d)
    o = spans.overlaps(_source_spans(spark, d), g.drop("nll", "blen"), ["cell_name", "win"], 64)
    j = o.join(g.select("cell_name", "win", "b_id", "nll", "blen"), ["cell_name", "win", "b_id"])
    part = F.round(F.col("nll") * F.col("bytes") / F.col("blen"), 9).cast("decimal(28,9)")
    return j.groupBy("cell_name", F.col("a_id").alias("cls")).agg(F.sum("bytes").alias("bytes"), F.sum(part).cast("double").alias("nll"))


def byte_apportioned(spark, d):
    return _class_nll(spark, d).select("cell_name", "cls", "bytes", _r("nll"))


def source_class_contrasts(spark, d):
    """Per class: shuffled minus topological bits per byte, averaged over models and corpora that have both."""
    n = _class_nll(spark, d).join(table(spark, d, "cells_meta").select("cell_name", "model_name", "corpus", "stream_kind"), "cell_name")
    n = n.withColumns({"bpb": F.col("nll") / F.log(F.lit(2.0)) / F.col("bytes"), "ok": F.lit(True)})
    c = G.contrasts(n, ["model_name", "corpus", "cls"], "stream_kind", "bpb", "ok", [("order", "full_shuffled", "full_topo")])
    return c.groupBy("cls", "contrast").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("delta", 9).cast("decimal(28,9)")).cast("double") / F.count(F.lit(1)), 6).alias("mean_delta"))


# ---- contrasts and governance


def _scores(spark, d):
    """A score per (target, arm) from assembled orders: closure units per 1,000 bytes of budget."""
    o = table(spark, d, "assembly_orders").where("order_id is not null").groupBy("order_id").agg(F.min(F.struct("target_id", "repo", "arm", "budget", "n_closure_units", "eligible")).alias("r")).select("order_id", "r.*")
    v = F.round(F.coalesce(F.col("n_closure_units"), F.lit(0)) * 1000.0 / F.col("budget") + F.pmod(F.col("order_id"), F.lit(17)) / 16.0, 9)
    return o.withColumns({"score": v, "ok": F.coalesce("eligible", F.lit(False))})


_PAIRS = [("e1", "k3", "k4"), ("e2", "k5", "k6"), ("e3", "k4", "k4x")]


def _deltas(spark, d):
    """Contrasts at the level of (repo, hash bucket of target), so that arms meet."""
    s = _scores(spark, d).withColumn("bucket", F.pmod("target_id", F.lit(23)))
    per = s.where("ok").groupBy("repo", "bucket", "arm").agg(F.round(F.sum(F.col("score").cast("decimal(28,9)")).cast("double") / F.count(F.lit(1)), 9).alias("score")).withColumn("ok", F.lit(True))
    return G.contrasts(per, ["repo", "bucket"], "arm", "score", "ok", _PAIRS)


def paired_contrasts(spark, d):
    return _deltas(spark, d).select("repo", "bucket", "contrast", _r("delta"))


def blind_centred_deltas(spark, d):
    sign = F.when(F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("flip"), "repo", "contrast"), 256), 1, 4), 16, 10).cast("int"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    fam = F.concat(F.lit("fam-"), F.substring(F.sha2(F.concat_ws(":", F.lit("mask"), "repo", "contrast"), 256), 1, 16))
    return G.centred(_deltas(spark, d), ["repo", "contrast"], "delta", sign).select(fam.alias("family"), "bucket", (F.round("published", 6) + 0.0).alias("published"))


def _order_deltas(spark, d):
    """Per order of a customer the distance of its price from 1,500 hundreds, by segment."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("family"), F.round(F.col("o_totalprice") / 100_000 - 1.5, 6).alias("delta"))
    return o.withColumn("module", F.pmod("o_custkey", F.lit(19)))


def variance_components(spark, d):
    return G.variance_components(_order_deltas(spark, d), ["family"], "module", "delta").select("family", "n", "modules", "mode", _r("sigma_w2"), _r("sigma_b2"))


def _projection(spark, d):
    """Half-width per family and sample size, module sizes as even as can be."""
    v = G.variance_components(_order_deltas(spark, d), ["family"], "module", "delta").where("mode = 'mom'")
    rows = v.withColumn("size", F.explode(F.sequence(F.lit(G.N_MIN), F.lit(G.N_MAX))))
    k, g = F.expr("size div modules"), F.col("modules")
    extra = F.col("size") - k * g
    m2 = extra * (k + 1) * (k + 1) + (g - extra) * k * k
    return rows.withColumn("half_width", G.half_width(F.col("sigma_b2"), F.col("sigma_w2"), m2, F.col("size"), g - 1))


def projected_halfwidth(spark, d):
    return _projection(spark, d).select("family", "size", _r("half_width"))


def smallest_n(spark, d):
    p = _projection(spark, d).withColumn("ok", F.round("half_width", 6) <= 0.06)
    return p.groupBy("family").agg(F.min(F.when(F.col("ok"), F.col("size"))).alias("chosen_n")).withColumn("verdict", F.when(F.col("chosen_n").isNotNull(), "feasible").otherwise("infeasible"))


def _draws(spark, d):
    """Draws per (event type as arm, user as target): the first 32 events of each, passed by value parity."""
    e = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id")) - 1
    rows = e.withColumn("draw", n).where("draw < 32")
    return rows.select(F.col("event_type").alias("arm"), F.col("user_id").alias("target"), "draw", (F.pmod(F.floor("value"), F.lit(3)) != F.pmod("user_id", F.lit(2))).alias("passed"))


def pearson_or_zero(spark, d):
    e = _draws(spark, d).groupBy("arm", "target").agg(F.sum(F.when(F.col("draw") < 8, F.col("passed").cast("int"))).alias("x"), F.sum(F.when(F.col("draw") >= 8, F.col("passed").cast("int"))).alias("y"))
    return G.pearson_or_zero(e, ["arm"], "x", "y").select("arm", "n", _r("r"))


def _full(spark, d):
    """Targets with at least 8 draws."""
    e = _draws(spark, d)
    return e.join(e.groupBy("arm", "target").agg(F.count(F.lit(1)).alias("k")).where("k >= 8").drop("k"), ["arm", "target"])


def split_half_reliability(spark, d):
    return G.split_half(_full(spark, d), ["arm"], "target", "draw", "passed", 8, 200, "rel:v1").select("arm", "n_targets", _r("median"), _r("least"), _r("largest"))


def reliability_gate(spark, d):
    """The least median over arms, and whether it reaches 0.8."""
    return split_half_reliability(spark, d).agg(F.min("median").alias("least_median"), F.count(F.lit(1)).alias("arms")).withColumn("meets", F.col("least_median") >= 0.8)


def reliability_by_n(spark, d):
    """For 8, 16 and 32 draws: the least median reliability over arms that have so many, whether it reaches 0.8, and the first n that does."""
    e = Scratch(spark).cut(_draws(spark, d), "draws")
    out = None
    for n in (8, 16, 32):
        enough = e.groupBy("arm", "target").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= n).drop("k")
        s = G.split_half(e.join(enough, ["arm", "target"]), ["arm"], "target", "draw", "passed", n, 20, "rel:v1")
        row = s.agg(F.lit(n).alias("n"), F.count(F.lit(1)).alias("arms"), F.round(F.min("median"), 6).alias("least_median"))
        out = row if out is None else out.unionByName(row)
    out = out.withColumn("meets", F.coalesce(F.col("least_median") >= 0.8, F.lit(False)))
    return out.withColumn("chosen_n", F.min(F.when(F.col("meets"), F.col("n"))).over(Window.partitionBy()))


def tier_decision(spark, d):
    e = _full(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("trials"), F.count_if("passed").alias("passes"))
    return e.withColumn("direction", G.tier(F.col("passes"), F.col("trials")))


def pass_at_8(spark, d):
    """Design-derived: chance that 8 draws of a target hold a passing one, averaged per arm."""
    e = _full(spark, d).groupBy("arm", "target").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c"))
    p = e.withColumn("p", F.round(G.pass_at(8, F.col("n"), F.col("c")), 9))
    return p.groupBy("arm").agg(F.round(F.sum(F.col("p").cast("decimal(28,9)")).cast("double") / F.count(F.lit(1)), 6).alias("pass_at_8"))


def holm_correction(spark, d):
    """Design-derived: step-down correction within a family."""
    p = F.round((F.pmod("o_orderkey", F.lit(997)) + 1) / 4000.0, 9)
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("family"), "o_orderkey", p.alias("p"))
    return G.holm(rows, ["family"], "p", "o_orderkey").select("family", "o_orderkey", "p", F.round("p_holm", 9).alias("p_holm"))


def excess_and_need(spark, d):
    """Design-derived: weighted excess over the largest budget and the least budget that suffices, by isotonic fit."""
    s = _scores(spark, d).groupBy("repo").agg(*[F.round(F.sum(F.when(F.col("budget") == b, F.col("score").cast("decimal(28,9)"))).cast("double") / F.count_if(F.col("budget") == b), 9).alias(f"s{b}") for b in (2048, 8192, 32768)])
    gap = [F.col(f"s{b}") - F.col("s32768") for b in (2048, 8192, 32768)]
    f1, f2, f3 = G.isotonic3(*gap)
    need = F.when(f1 <= 0.05, 2048).when(f2 <= 0.05, 8192).when(f3 <= 0.05, 32768)
    return s.select("repo", F.round((gap[0] + 2 * gap[1] + gap[2]) / 4, 6).alias("excess"), need.alias("need"))


def non_inferiority(spark, d):
    """Design-derived: whether the upper bound of a contrast stays below a margin."""
    u = G.upper_bound(_deltas(spark, d), ["contrast"], "delta")
    return u.select("contrast", "n", _r("mean"), _r("upper"), (F.round("upper", 6) <= 0.5).alias("holds"))


def signed_ranks(spark, d):
    """Design-derived: signed-rank statistics of the contrasts of orders by segment."""
    x = _order_deltas(spark, d).withColumn("delta", F.round("delta", 2))
    return G.signed_rank(x, ["family", "module"], "delta").select("family", "module", "n", _r("w_plus"), _r("w_minus"), _r("z"))


# ---- grids and gates


def expected_grid(spark, d):
    """All cells that the dimensions call for."""
    m = table(spark, d, "cells_meta")
    dims = m.agg(F.collect_set("model_name").alias("a"), F.collect_set("corpus").alias("b"), F.collect_set("stream_kind").alias("c"))
    return dims.select(F.explode("a").alias("model_name"), "b", "c").select("model_name", F.explode("b").alias("corpus"), "c").select("model_name", "corpus", F.explode("c").alias("stream_kind"))


def grid_drift(spark, d):
    """Cells that are expected and have no scored row, or the reverse."""
    e = expected_grid(spark, d).select(F.concat_ws("__", "model_name", "corpus", "stream_kind").alias("cell_name"), F.lit(True).alias("e"))
    h = table(spark, d, "token_dump").select("cell_name").distinct().withColumn("h", F.lit(True))
    j = e.join(h, "cell_name", "full_outer").where("e is null or h is null")
    return j.select("cell_name", F.when(F.col("e").isNull(), "unexpected").otherwise("missing").alias("drift"))


def admission(spark, d):
    """First reason that keeps a cell out of the analysis."""
    m = table(spark, d, "cells_meta").join(table(spark, d, "token_dump").groupBy("cell_name").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.isnan("nll")).alias("nans")), "cell_name", "left")
    why = F.when(F.col("rows").isNull(), "no-dump").when(F.col("byte_ledger_ok").isNull(), "ledger-unknown").when(~F.col("byte_ledger_ok"), "ledger-broken").when(F.col("nans") > 0, "nan-scores").otherwise("admitted")
    return m.select("cell_name", why.alias("verdict"))


def execution_classification(spark, d):
    """Outcome of each assembled order as a state of its flags."""
    o = table(spark, d, "assembly_orders")
    s = (
        F.when(F.col("unit_order").isNull(), "not-rendered")
        .when(F.size("unit_order") == 0, "empty")
        .when(F.size(F.array_distinct("unit_order")) < F.size("unit_order"), "repeats")
        .when(F.col("n_closure_units").isNull(), "uncounted")
        .when(F.size("unit_order") < F.col("n_closure_units"), "short")
        .when(F.col("eligible").isNull(), "undecided")
        .when(~F.col("eligible"), "ineligible")
        .otherwise("complete")
    )
    return o.groupBy("arm", s.alias("state")).agg(F.count(F.lit(1)).alias("orders"))


def props_json_extract(spark, d):
    e = table(spark, d, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.sum("k").alias("total"))


def monotonicity_violations(spark, d):
    """Bins after which bits per byte rise by more than 0.01 with more context."""
    from tessella.plans.curves import bin_table

    nxt = F.lead("bpb").over(Window.partitionBy("cell_name").orderBy("bin"))
    b = bin_table(spark, d).withColumn("next", nxt)
    return b.groupBy("cell_name").agg(F.count("next").alias("steps"), F.count_if(F.col("next") > F.col("bpb") + 0.01).alias("violations"))


def dep_vs_random_context(spark, d):
    """Targets whose dependency arm beats the random one at one budget."""
    s = _scores(spark, d).where("ok").withColumn("bucket", F.pmod("target_id", F.lit(29)))
    p = s.groupBy("repo", "budget", "bucket").agg(F.max(F.when(F.col("arm") == "k4", F.col("score"))).alias("dep"), F.max(F.when(F.col("arm") == "k5", F.col("score"))).alias("rnd")).where("dep is not null and rnd is not null")
    return p.groupBy("budget").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dep") > F.col("rnd")).alias("dep_wins"), F.round(F.sum((F.col("dep") - F.col("rnd")).cast("decimal(28,9)")).cast("double") / F.count(F.lit(1)), 6).alias("mean_delta"))


def layout_invariance(spark, d):
    """Targets whose contexts differ between arms of one budget."""
    o = table(spark, d, "assembly_orders").groupBy("target_id", "budget").agg(F.count_distinct("context_sha256").alias("contexts"), F.count_distinct("arm").alias("arms"))
    return o.groupBy("budget", (F.col("contexts") <= F.col("arms")).alias("invariant")).agg(F.count(F.lit(1)).alias("targets"))


_NAMES = """token_span_islands interval_merge interval_complement budget_suffix_units doc_of_position group_doc_attribution span_overlap_attribution byte_apportioned source_class_contrasts
paired_contrasts blind_centred_deltas variance_components projected_halfwidth smallest_n pearson_or_zero split_half_reliability reliability_gate reliability_by_n tier_decision pass_at_8 holm_correction excess_and_need non_inferiority signed_ranks
expected_grid grid_drift admission execution_classification props_json_extract monotonicity_violations dep_vs_random_context layout_invariance""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

from tessella.plans.curves import _B, _G  # noqa: E402

_O = "o AS (SELECT cell_name, win, tok, greatest(ctxb - CASE WHEN tok % 2 = 0 THEN 1 ELSE 0 END, 0) AS start, ctxb + blen AS e, nll FROM (SELECT cell_name, win, ctxb, tok, max(blen) AS blen, max(nll) FILTER (WHERE NOT isnan(nll)) AS nll FROM token_dump WHERE grp IS NOT NULL AND blen IS NOT NULL GROUP BY ALL))"
_M = f"""{_O}, o3 AS (SELECT *, max(e) OVER (PARTITION BY cell_name, win ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM o WHERE nll >= 1),
  og AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY cell_name, win ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS g FROM o3),
  m AS (SELECT cell_name, win, min(start) AS start, max(e) AS e, count(*) AS n_spans FROM og GROUP BY cell_name, win, g)"""
_LEN = "ln AS (SELECT cell_name, win, max(e) AS length FROM o GROUP BY cell_name, win)"
_MAN = f"{_F}, mm AS (SELECT repo, file_id, cast(sum(bytes) OVER (PARTITION BY repo ORDER BY rel, file_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, bytes FROM f), sp AS (SELECT repo, file_id, e - bytes AS s, e FROM mm)"
_SRC = f"""{_G}, {_O}, {_LEN}, ks AS (SELECT ln.*, unnest(range(0, (length - 1) // 9 + 1)) AS k FROM ln WHERE length > 0),
  ss AS (SELECT cell_name, win, list_extract(['word', 'literal', 'symbol', 'comment', 'layout'], cast((k * 7 + win) % 5 + 1 AS INT)) AS cls, k * 9 AS s, least(k * 9 + 9, length) AS e FROM ks),
  mg AS (SELECT cell_name, win, grp, ctxb AS s, ctxb + blen AS e, nll, blen FROM g WHERE blen > 0),
  ov AS (SELECT mg.cell_name, mg.win, ss.cls, mg.grp, cast(sum(least(ss.e, mg.e) - greatest(ss.s, mg.s)) AS BIGINT) AS bytes, any_value(mg.nll) AS nll, any_value(mg.blen) AS blen
    FROM ss JOIN mg ON ss.cell_name = mg.cell_name AND ss.win = mg.win AND ss.s < mg.e AND mg.s < ss.e GROUP BY ALL),
  cn AS (SELECT cell_name, cls, cast(sum(bytes) AS BIGINT) AS bytes, cast(sum(cast(round(nll * bytes / blen, 9) AS DECIMAL(28,9))) AS DOUBLE) AS nll FROM ov GROUP BY cell_name, cls)"""
_SCO = """so AS (SELECT order_id, min({'a': target_id, 'b': repo, 'c': arm, 'd': budget, 'e': coalesce(n_closure_units, 0), 'f': coalesce(eligible, false)}) AS r FROM assembly_orders GROUP BY order_id),
  sc AS (SELECT order_id, r.a AS target_id, r.b AS repo, r.c AS arm, r.d AS budget, r.f AS ok, round(r.e * 1000.0::DOUBLE / r.d + (order_id % 17) / 16.0::DOUBLE, 9) AS score FROM so)"""
_AVG = lambda e: f"cast(sum(cast({e} AS DECIMAL(28,9))) AS DOUBLE)"
_DEL = f"""{_SCO}, pe AS (SELECT repo, target_id % 23 AS bucket, arm, round({_AVG("score")} / count(*), 9) AS score FROM sc WHERE ok GROUP BY ALL),
  wi AS (SELECT repo, bucket, max(score) FILTER (WHERE arm = 'k3') AS k3, max(score) FILTER (WHERE arm = 'k4') AS k4, max(score) FILTER (WHERE arm = 'k5') AS k5, max(score) FILTER (WHERE arm = 'k6') AS k6, max(score) FILTER (WHERE arm = 'k4x') AS k4x FROM pe GROUP BY ALL),
  de AS (SELECT repo, bucket, 'e1' AS contrast, k3 - k4 AS delta FROM wi UNION ALL SELECT repo, bucket, 'e2', k5 - k6 FROM wi UNION ALL SELECT repo, bucket, 'e3', k4 - k4x FROM wi), dl AS (SELECT * FROM de WHERE delta IS NOT NULL)"""
_VC = """od AS (SELECT o_orderpriority AS family, o_custkey % 19 AS module, round(o_totalprice / 100000 - 1.5, 6) AS x FROM orders), mo AS (SELECT family, module, count(*) AS m, avg(x) AS mean FROM od GROUP BY ALL),
  gr AS (SELECT family, avg(x) AS grand, count(*) AS n FROM od GROUP BY family), sw AS (SELECT od.family, sum((x - mean) * (x - mean)) AS ssw FROM od JOIN mo ON od.family = mo.family AND od.module = mo.module GROUP BY od.family),
  sb AS (SELECT mo.family, count(*) AS g, sum(m * (mean - grand) * (mean - grand)) AS ssb, sum(m * m) AS m2 FROM mo JOIN gr ON mo.family = gr.family GROUP BY mo.family),
  vc AS (SELECT gr.family, n, g AS modules, CASE WHEN g < 2 OR n < 2 THEN 'insufficient-clusters' WHEN n = g THEN 'all-singleton-conservative' ELSE 'mom' END AS mode, ssw / (n - g) AS sw2,
    greatest(0, (ssb / (g - 1) - ssw / (n - g)) / ((n - m2 / n) / (g - 1))) AS sb2 FROM gr JOIN sw USING (family) JOIN sb USING (family))"""
_PRO = f"""{_VC}, tq(df, t) AS (VALUES {", ".join(f"({i + 1}, {t})" for i, t in enumerate(G.T_0975))}), sz AS (SELECT vc.*, unnest(range(200, 401)) AS size FROM vc WHERE mode = 'mom'),
  pj AS (SELECT family, cast(size AS INT) AS size, round(t * sqrt(sb2 * ((size % modules) * (size // modules + 1) * (size // modules + 1) + (modules - size % modules) * (size // modules) * (size // modules)) / (size * size) + sw2 / size), 6) AS half_width
    FROM sz JOIN tq ON tq.df = modules - 1)"""
_DR = """dr AS (SELECT event_type AS arm, user_id AS target, draw, (cast(floor(value) AS BIGINT) % 3) <> (user_id % 2) AS passed FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS draw FROM events) WHERE draw < 32),
  fu AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY arm, target) AS k FROM dr) WHERE k >= 8)"""
_COR = lambda x, y: f"CASE WHEN var_pop({x}) <= 1e-12 OR var_pop({y}) <= 1e-12 THEN 0.0 ELSE greatest(-1.0, least(1.0, covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})))) END"
_REL = f"""{_DR}, rs AS (SELECT fu.*, unnest(range(0, 200)) AS resplit FROM fu), rk AS (SELECT *, row_number() OVER (PARTITION BY arm, resplit, target ORDER BY sha256('rel:v1:' || arm || ':8:' || resplit || ':' || target || ':' || draw), draw) AS place FROM rs),
  ra AS (SELECT arm, resplit, target, sum(passed::INT) FILTER (WHERE place <= 4) / 4 AS l, sum(passed::INT) FILTER (WHERE place > 4) / 4 AS r FROM rk WHERE place <= 8 GROUP BY ALL),
  co AS (SELECT arm, resplit, count(*) AS n, {_COR("l", "r")} AS r FROM ra GROUP BY arm, resplit), sb AS (SELECT *, round(CASE WHEN r <= 0 THEN 0 ELSE least(1.0, 2 * r / (1 + r)) END, 9) AS c FROM co),
  re AS (SELECT arm, max(n) AS n_targets, round(median(c), 6) AS median, round(min(c), 6) AS least, round(max(c), 6) AS largest FROM sb GROUP BY arm)"""



def _rel_sql(n: int) -> str:
    """The same as _REL for n draws and 20 resplits, one row."""
    return f"""(WITH {_DR}, f{n} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY arm, target) AS m FROM dr) WHERE m >= {n}), rs AS (SELECT f{n}.*, unnest(range(0, 20)) AS resplit FROM f{n}),
      rk AS (SELECT *, row_number() OVER (PARTITION BY arm, resplit, target ORDER BY sha256('rel:v1:' || arm || ':{n}:' || resplit || ':' || target || ':' || draw), draw) AS place FROM rs),
      ra AS (SELECT arm, resplit, target, sum(passed::INT) FILTER (WHERE place <= {n // 2}) / {n // 2} AS l, sum(passed::INT) FILTER (WHERE place > {n // 2}) / {n // 2} AS r FROM rk WHERE place <= {n} GROUP BY ALL),
      co AS (SELECT arm, resplit, {_COR("l", "r")} AS r FROM ra GROUP BY arm, resplit), sb AS (SELECT *, round(CASE WHEN r <= 0 THEN 0 ELSE least(1.0, 2 * r / (1 + r)) END, 9) AS c FROM co), md AS (SELECT arm, median(c) AS m FROM sb GROUP BY arm)
      SELECT {n} AS n, count(*) AS arms, round(min(m), 6) AS least_median FROM md)"""


ORACLE = {
    "reliability_by_n": f"WITH u AS ({' UNION ALL '.join(_rel_sql(n) for n in (8, 16, 32))}), m AS (SELECT *, coalesce(least_median >= 0.8, false) AS meets FROM u) SELECT *, min(n) FILTER (WHERE meets) OVER () AS chosen_n FROM m",
    "token_span_islands": f"""WITH {_O}, b AS (SELECT *, coalesce(max(e) OVER (PARTITION BY cell_name, win ORDER BY start, e, tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o),
      g AS (SELECT *, sum(CASE WHEN start >= b THEN 1 ELSE 0 END) OVER (PARTITION BY cell_name, win ORDER BY start, e, tok ROWS UNBOUNDED PRECEDING) - 1 AS grp FROM b)
      SELECT cell_name, win, cast(grp AS BIGINT) AS grp, count(*) AS tokens, cast(sum(greatest(e - b, 0)) AS BIGINT) AS bytes FROM g GROUP BY cell_name, win, grp""",
    "interval_merge": f'WITH {_M} SELECT cell_name, win, start, e AS "end", n_spans FROM m',
    "interval_complement": f"""WITH {_M}, {_LEN}, a AS (SELECT ln.cell_name, ln.win, coalesce(lag(m.e) OVER w, 0) AS lo, coalesce(m.start, length) AS hi FROM ln LEFT JOIN m ON ln.cell_name = m.cell_name AND ln.win = m.win WINDOW w AS (PARTITION BY ln.cell_name, ln.win ORDER BY m.start)
      UNION ALL SELECT ln.cell_name, ln.win, max(m.e), max(length) FROM ln JOIN m ON ln.cell_name = m.cell_name AND ln.win = m.win GROUP BY ln.cell_name, ln.win), k AS (SELECT * FROM a WHERE lo < hi)
      SELECT cell_name, win, lo AS start, hi AS "end", cast(sum(hi - lo) OVER (PARTITION BY cell_name, win ORDER BY lo ROWS UNBOUNDED PRECEDING) - (hi - lo) AS BIGINT) AS output_start FROM k""",
    "budget_suffix_units": """WITH l AS (SELECT order_id, arg_min(unit_order, built_at) AS l FROM assembly_orders GROUP BY order_id), u AS (SELECT order_id, unnest(l) AS unit, cast(generate_subscripts(l, 1) - 1 AS INT) AS pos FROM l),
      z AS (SELECT unit_id AS unit, cast(min(octet_length(encode(payload))) AS BIGINT) AS size FROM units WHERE payload IS NOT NULL GROUP BY unit_id), s AS (SELECT u.*, size FROM u JOIN z USING (unit)), w AS (SELECT *, sum(size) OVER (PARTITION BY order_id) AS total, sum(size) OVER (PARTITION BY order_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM s), b(budget) AS (VALUES (1024), (4096)),
      i AS (SELECT *, cast(least(e - greatest(total - budget, 0), size) AS BIGINT) AS bytes_in FROM w, b) SELECT order_id, budget, pos, unit, bytes_in, bytes_in = size AS whole, total >= budget AS eligible FROM i WHERE bytes_in > 0""",
    "doc_of_position": f"WITH {_MAN}, t AS (SELECT repo, max(e) AS total FROM sp GROUP BY repo), p AS (SELECT repo, unnest(range(0, cast(total + 998 AS BIGINT), 997)) AS pos FROM t) SELECT p.repo, p.pos, coalesce(sp.file_id, -1) AS file_id FROM p LEFT JOIN sp ON p.repo = sp.repo AND p.pos >= sp.s AND p.pos < sp.e",
    "group_doc_attribution": f"""WITH {_MAN}, t AS (SELECT repo, max(e) AS total FROM sp GROUP BY repo), p AS (SELECT repo, total, unnest(range(0, total, 512)) AS lo FROM t)
      SELECT p.repo, p.lo, CASE WHEN a.file_id = b.file_id THEN a.file_id ELSE -1 END AS file_id FROM p LEFT JOIN sp a ON p.repo = a.repo AND p.lo >= a.s AND p.lo < a.e
      LEFT JOIN sp b ON p.repo = b.repo AND least(p.lo + 511, total - 1) >= b.s AND least(p.lo + 511, total - 1) < b.e""",
    "span_overlap_attribution": f"WITH {_SRC} SELECT cell_name, win, cls, grp, bytes FROM ov",
    "byte_apportioned": f"WITH {_SRC} SELECT cell_name, cls, bytes, round(nll, 6) AS nll FROM cn",
    "source_class_contrasts": f"""WITH {_SRC}, b AS (SELECT model_name, corpus, stream_kind, cls, nll / ln(2) / bytes AS bpb FROM cn JOIN cells_meta USING (cell_name)),
      d2 AS (SELECT model_name, corpus, cls, max(bpb) FILTER (WHERE stream_kind = 'full_shuffled') - max(bpb) FILTER (WHERE stream_kind = 'full_topo') AS delta FROM b GROUP BY ALL)
      SELECT cls, 'order' AS contrast, count(*) AS n, round({_AVG("round(delta, 9)")} / count(*), 6) AS mean_delta FROM d2 WHERE delta IS NOT NULL GROUP BY cls""",
    "paired_contrasts": f"WITH {_DEL} SELECT repo, bucket, contrast, round(delta, 6) AS delta FROM dl",
    "blind_centred_deltas": f"""WITH {_DEL}, c AS (SELECT *, delta - avg(delta) OVER (PARTITION BY repo, contrast) AS r FROM dl) SELECT 'fam-' || substr(sha256('mask:' || repo || ':' || contrast), 1, 16) AS family, bucket,
      round(CASE WHEN cast('0x' || substr(sha256('flip:' || repo || ':' || contrast), 1, 4) AS BIGINT) % 2 = 0 THEN r ELSE -r END, 6) + 0.0 AS published FROM c""",
    "variance_components": f"WITH {_VC} SELECT family, n, modules, mode, round(sw2, 6) AS sigma_w2, round(sb2, 6) AS sigma_b2 FROM vc",
    "projected_halfwidth": f"WITH {_PRO} SELECT * FROM pj",
    "smallest_n": f"WITH {_PRO}, c AS (SELECT family, min(size) FILTER (WHERE half_width <= 0.06) AS chosen_n FROM pj GROUP BY family) SELECT *, CASE WHEN chosen_n IS NULL THEN 'infeasible' ELSE 'feasible' END AS verdict FROM c",
    "pearson_or_zero": f"""WITH {_DR}, e AS (SELECT arm, target, sum(passed::INT) FILTER (WHERE draw < 8) AS x, sum(passed::INT) FILTER (WHERE draw >= 8) AS y FROM dr GROUP BY ALL), k AS (SELECT * FROM e WHERE x IS NOT NULL AND y IS NOT NULL)
      SELECT arm, count(*) AS n, round({_COR("x", "y")}, 6) AS r FROM k GROUP BY arm""",
    "split_half_reliability": f"WITH {_REL} SELECT * FROM re",
    "reliability_gate": f"WITH {_REL} SELECT min(median) AS least_median, count(*) AS arms, min(median) >= 0.8 AS meets FROM re",
    "tier_decision": f"""WITH {_DR}, e AS (SELECT arm, count(*) AS trials, count(*) FILTER (WHERE passed) AS passes FROM fu GROUP BY arm)
      SELECT *, CASE WHEN passes * 100 < trials * 5 THEN 'move-up-one' WHEN passes * 100 > trials * 95 THEN 'move-down-one' ELSE 'stay' END AS direction FROM e""",
    "pass_at_8": f"""WITH {_DR}, e AS (SELECT arm, target, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM fu GROUP BY ALL),
      p AS (SELECT arm, round(1 - list_reduce(list_transform(range(0, 8), lambda i: greatest(n - c - i, 0) / (n - i)), lambda x, y: x * y), 9) AS p FROM e) SELECT arm, round({_AVG("p")} / count(*), 6) AS pass_at_8 FROM p GROUP BY arm""",
    "holm_correction": """WITH r AS (SELECT o_orderpriority AS family, o_orderkey, round((o_orderkey % 997 + 1) / 4000.0::DOUBLE, 9) AS p FROM orders),
      s AS (SELECT *, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, o_orderkey) + 1) AS s FROM r)
      SELECT family, o_orderkey, p, round(least(1.0, max(s) OVER (PARTITION BY family ORDER BY p, o_orderkey ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM s""",
    "excess_and_need": f"""WITH {_SCO}, s AS (SELECT repo, {", ".join(f"round(cast(sum(cast(score AS DECIMAL(28,9))) FILTER (WHERE budget = {b}) AS DOUBLE) / count(*) FILTER (WHERE budget = {b}), 9) AS s{b}" for b in (2048, 8192, 32768))} FROM sc GROUP BY repo),
      g AS (SELECT repo, s2048 - s32768 AS a, s8192 - s32768 AS b, s32768 - s32768 AS c FROM s),
      f AS (SELECT *, CASE WHEN a >= b AND b >= c THEN [a, b, c] WHEN a < b AND (a + b) / 2 >= c THEN [(a + b) / 2, (a + b) / 2, c] WHEN b < c AND a >= (b + c) / 2 THEN [a, (b + c) / 2, (b + c) / 2] ELSE [(a + b + c) / 3, (a + b + c) / 3, (a + b + c) / 3] END AS f FROM g)
      SELECT repo, round((a + 2 * b + c) / 4, 6) AS excess, CASE WHEN f[1] <= 0.05 THEN 2048 WHEN f[2] <= 0.05 THEN 8192 WHEN f[3] <= 0.05 THEN 32768 END AS need FROM f""",
    "non_inferiority": f"""WITH {_DEL}, tq(df, t) AS (VALUES {", ".join(f"({i + 1}, {t})" for i, t in enumerate(G.T_0975))}), s AS (SELECT contrast, count(*) AS n, avg(delta) AS m, sqrt(var_samp(delta) / count(*)) AS e FROM dl GROUP BY contrast),
      q AS (SELECT s.*, CASE WHEN n - 1 > {len(G.T_0975)} THEN {G.Z_0975!r}::DOUBLE + {" + ".join(f"{c!r}::DOUBLE / pow(n - 1, {i})" for i, c in enumerate(G.t_terms(), 1))} ELSE t END AS t2 FROM s LEFT JOIN tq ON tq.df = n - 1)
      SELECT contrast, n, round(m, 6) AS mean, round(m + t2 * e, 6) AS upper, round(m + t2 * e, 6) <= 0.5 AS holds FROM q""",
    "signed_ranks": """WITH x AS (SELECT o_orderpriority AS family, o_custkey % 19 AS module, round(round(o_totalprice / 100000 - 1.5, 6), 2) AS v FROM orders), r AS (SELECT *, rank() OVER (PARTITION BY family, module ORDER BY abs(v)) + (count(*) OVER (PARTITION BY family, module, abs(v)) - 1) / 2 AS r FROM x WHERE v <> 0),
      s AS (SELECT family, module, count(*) AS n, coalesce(sum(r) FILTER (WHERE v > 0), 0) AS p, coalesce(sum(r) FILTER (WHERE v < 0), 0) AS q FROM r GROUP BY family, module)
      SELECT family, module, n, round(p, 6) AS w_plus, round(q, 6) AS w_minus, round((p - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) AS z FROM s""",
    "expected_grid": "SELECT DISTINCT a.model_name, b.corpus, c.stream_kind FROM cells_meta a, cells_meta b, cells_meta c",
    "grid_drift": """WITH e AS (SELECT DISTINCT a.model_name || '__' || b.corpus || '__' || c.stream_kind AS cell_name FROM cells_meta a, cells_meta b, cells_meta c), h AS (SELECT DISTINCT cell_name FROM token_dump)
      SELECT coalesce(e.cell_name, h.cell_name) AS cell_name, CASE WHEN e.cell_name IS NULL THEN 'unexpected' ELSE 'missing' END AS drift FROM e FULL JOIN h ON e.cell_name = h.cell_name WHERE e.cell_name IS NULL OR h.cell_name IS NULL""",
    "admission": """WITH t AS (SELECT cell_name, count(*) AS n, count(*) FILTER (WHERE isnan(nll)) AS nans FROM token_dump GROUP BY cell_name)
      SELECT m.cell_name, CASE WHEN n IS NULL THEN 'no-dump' WHEN byte_ledger_ok IS NULL THEN 'ledger-unknown' WHEN NOT byte_ledger_ok THEN 'ledger-broken' WHEN nans > 0 THEN 'nan-scores' ELSE 'admitted' END AS verdict FROM cells_meta m LEFT JOIN t ON t.cell_name = m.cell_name""",
    "execution_classification": """SELECT arm, CASE WHEN unit_order IS NULL THEN 'not-rendered' WHEN len(unit_order) = 0 THEN 'empty' WHEN len(list_distinct(unit_order)) < len(unit_order) THEN 'repeats' WHEN n_closure_units IS NULL THEN 'uncounted'
      WHEN len(unit_order) < n_closure_units THEN 'short' WHEN eligible IS NULL THEN 'undecided' WHEN NOT eligible THEN 'ineligible' ELSE 'complete' END AS state, count(*) AS orders FROM assembly_orders GROUP BY 1, 2""",
    "props_json_extract": "WITH e AS (SELECT event_type, cast(json_extract(props, '$.k') AS INT) AS k FROM events) SELECT event_type, count(k) AS n, min(k) AS least, max(k) AS most, cast(sum(k) AS BIGINT) AS total FROM e GROUP BY event_type",
    "monotonicity_violations": f"WITH {_B}, n AS (SELECT cell_name, round(bpb, 6) AS b, lead(round(bpb, 6)) OVER (PARTITION BY cell_name ORDER BY bin) AS nx FROM bins) SELECT cell_name, count(nx) AS steps, count(*) FILTER (WHERE nx > b + 0.01::DOUBLE) AS violations FROM n GROUP BY cell_name",
    "dep_vs_random_context": f"""WITH {_SCO}, p AS (SELECT repo, budget, target_id % 29 AS bucket, max(score) FILTER (WHERE arm = 'k4') AS dep, max(score) FILTER (WHERE arm = 'k5') AS rnd FROM sc WHERE ok GROUP BY ALL)
      SELECT budget, count(*) AS n, count(*) FILTER (WHERE dep > rnd) AS dep_wins, round({_AVG("dep - rnd")} / count(*), 6) AS mean_delta FROM p WHERE dep IS NOT NULL AND rnd IS NOT NULL GROUP BY budget""",
    "layout_invariance": "WITH o AS (SELECT target_id, budget, count(DISTINCT context_sha256) <= count(DISTINCT arm) AS invariant FROM assembly_orders GROUP BY target_id, budget) SELECT budget, invariant, count(*) AS targets FROM o GROUP BY budget, invariant",
}
