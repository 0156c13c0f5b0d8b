"""Problem 7: sources mixed to target weights.

Each source gives whole rounds of all its documents plus a part of one more
round. The part is a range of document hashes from zero, so for one source a
smaller target takes a subset of what a larger one takes. Its end is found in
histograms of tokens by hash prefix: after each, only the boundary prefix is
looked at more closely, until it holds a single document. Documents are then
filtered by their hash; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.joins import lookup_join
from tessella.scratch import Scratch

BITS, STEP = 60, 10
# products of weights, budgets and token counts are taken in decimals: they leave 64 bits at some ten trillion tokens
WIDE = "decimal(38,0)"


def label(c: str) -> F.Column:
    """A source label without regard to case and surrounding white space; null if nothing is left."""
    bare = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Documents with their uses, and the report per mix and source.

    ``documents``: ``doc_id, source, n_tokens``. ``targets``: ``mix_id,
    source, weight_ppm, budget_tokens, max_repeats``; repeated rows count
    once. Labels are compared by ``label``; documents without a label belong
    to no source. Uses: ``mix_id, source, doc_id, n_uses`` with n_uses > 0.
    Report: ``mix_id, source, target_tokens, available_tokens, actual_tokens,
    max_repeats, short`` plus ``actual_ppm`` of the mix. A source with fewer
    tokens than its target even at ``max_repeats`` is used in full and marked
    short. The part of a round ends at the document that brings it nearest to
    the target. Documents without tokens are used in whole rounds only. Null
    weights, budgets or repeats count as 0.
    """
    scratch = Scratch(documents.sparkSession)
    docs = scratch.cut(
        documents.select("doc_id", label("source").alias("label"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"))
        .where("label is not null")
        .withColumn("h", F.expr(f"shiftrightunsigned(xxhash64(doc_id, {int(seed)}), {64 - BITS})")),
        "tokens",
    )
    wanted = targets.select(
        "mix_id",
        "source",
        label("source").alias("label"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("weight_ppm", "budget_tokens", "max_repeats")],
    ).distinct()
    level = BITS - STEP
    hist = scratch.cut(docs.groupBy("label", F.shiftright("h", level).alias("p")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")), "hist")
    totals = hist.groupBy("label").agg(F.sum("n").alias("total"))
    plan = wanted.join(totals, "label", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))
    # a target is kept as whole tokens and millionths of a token
    parts = {"need": F.expr(f"cast(weight_ppm as {WIDE}) * budget_tokens"), "most": F.expr(f"cast(max_repeats as {WIDE}) * total")}
    plan = plan.withColumns(parts).withColumns({"whole": F.expr("need div 1000000"), "part": F.expr("cast(need % 1000000 as bigint)")})
    plan = plan.withColumns({"want": F.col("whole").cast("double") + F.col("part") / 1e6, "short": (F.col("most") < F.col("whole")) | ((F.col("most") == F.col("whole")) & (F.col("part") > 0))})
    rounds = F.when(F.col("short") | (F.col("total") == 0), F.col("max_repeats")).otherwise(F.least(F.expr("whole div greatest(total, 1)"), "max_repeats"))
    plan = plan.withColumn("rounds", rounds)
    # what is left of the target after whole rounds is less than one round
    left = F.expr("whole - rounds * total").cast("double") + F.col("part") / 1e6
    rest = F.when(F.col("short") | (F.col("rounds") >= F.col("max_repeats")), 0.0).otherwise(left)
    plan = scratch.cut(plan.withColumn("rest", rest).drop("need", "most", "whole", "part"), "plan")

    # each open row looks for the end of its range inside the hash prefix ``p`` of length BITS - level
    open_rows = plan.where("rest > 0").select("mix_id", "source", "label", "rest", F.lit(0).cast("bigint").alias("p"))
    ends = None
    n_plan = plan.count()
    while True:
        children = hist.withColumnRenamed("n", "m").withColumn("up", F.shiftright("p", STEP)).withColumnRenamed("p", "child")
        side = open_rows.withColumnRenamed("p", "up") if level < BITS - STEP else open_rows.select("mix_id", "source", "label", "rest", F.lit(0).cast("bigint").alias("up"))
        upto = F.sum("m").over(Window.partitionBy("mix_id", "source", "label").orderBy("child"))
        walk = children.join(side, ["label", "up"]).withColumn("upto", upto)
        # the first prefix at which the sum reaches the rest
        edge = scratch.cut(
            walk.where("upto >= rest and upto - m < rest")
            .groupBy("mix_id", "source", "label")
            .agg(F.min(F.struct("child", "docs", "m", (F.col("rest") - (F.col("upto") - F.col("m"))).alias("left"))).alias("e"))
            .select("mix_id", "source", "label", "e.*"),
            "edge",
        )
        last = level == 0
        settled = edge if last else edge.where("docs = 1")
        # the document at the edge is taken if that comes nearer to the target
        done = settled.select("mix_id", "source", "label", F.when(F.col("left") * 2 >= F.col("m"), F.col("child") + 1).otherwise(F.col("child")).alias("end"), F.lit(level).alias("shift"))
        ends = done if ends is None else ends.unionByName(done)
        more = edge.where("docs > 1")
        if last or not more.limit(1).count():
            break
        open_rows = more.select("mix_id", "source", "label", F.col("left").alias("rest"), F.col("child").alias("p"))
        marks = open_rows.select("label", F.col("p").alias("mark")).distinct()
        inside = lookup_join(docs.withColumn("mark", F.shiftright("h", level)), marks, ["label", "mark"], "inner")
        level -= STEP
        hist = scratch.cut(inside.groupBy("label", F.shiftright("h", level).alias("p")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")), "hist")
    plan = plan.join(ends.drop("label"), ["mix_id", "source"], "left").withColumn("limit", F.coalesce(F.expr("shiftleft(end, shift)"), F.lit(0).cast("bigint")))
    plan = scratch.cut(plan, "ends")
    # one entry per label; a label has a few mixes, not many
    by_label = plan.groupBy("label").agg(F.collect_list(F.struct("mix_id", "source", "rounds", "limit")).alias("mixes"))
    used = lookup_join(docs, by_label, ["label"], "inner", rows=n_plan).select("doc_id", "h", "n", F.explode("mixes").alias("m"))
    uses = used.select("m.mix_id", "m.source", "doc_id", "n", (F.col("m.rounds") + (F.col("h") < F.col("m.limit")).cast("bigint")).alias("n_uses")).where("n_uses > 0")
    actual = uses.groupBy("mix_id", "source").agg(F.sum(F.expr(f"cast(n as {WIDE}) * n_uses")).cast(WIDE).alias("actual_tokens"))
    report = plan.join(actual, ["mix_id", "source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)).cast("bigint"))
    whole = F.sum(F.col("actual_tokens").cast(WIDE)).over(Window.partitionBy("mix_id")).cast("double")
    report = report.select(
        "mix_id",
        "source",
        F.col("want").alias("target_tokens"),
        F.col("total").alias("available_tokens"),
        "max_repeats",
        "actual_tokens",
        F.round(F.col("actual_tokens") * 1e6 / F.nullif(whole, F.lit(0))).cast("bigint").alias("actual_ppm"),
        "short",
    )
    return uses.drop("n"), report
