"""Spans of texts: islands, merges, complements, lookups, overlaps, budgets, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, key: list[str], start: str = "start", end: str = "end", order: list | None = None) -> DataFrame:
    """Groups of overlapping spans in order of position: a span opens a group if it starts at or after all before it.

    Adds ``grp`` (from 0) and ``new`` (what the span covers beyond those before
    it, gaps charged to the next opener as in ``new = end - max(end before)``,
    0 if nothing).
    """
    w = Window.partitionBy(*key).orderBy(*(order or [start, end]))
    before = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = spans.withColumn("__b", before)
    return (
        rows.withColumn("grp", F.sum((F.col(start) >= F.col("__b")).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .withColumn("new", F.greatest(F.col(end) - F.col("__b"), F.lit(0)))
        .drop("__b")
    )


def merged(spans: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of overlapping or adjacent spans with the number of spans in each."""
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col(start) > before), F.lit(True)).cast("bigint")
    rows = spans.withColumn("__o", opens).withColumn("__g", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_spans")).drop("__g")


def complement(merged_spans: DataFrame, lengths: DataFrame, key: list[str], length: str) -> DataFrame:
    """What merged spans leave of [0, length): kept intervals with their offset in the output."""
    w = Window.partitionBy(*key).orderBy("start")
    cuts = lengths.select(*key, F.col(length).alias("__len")).join(merged_spans, key, "left")
    before = F.coalesce(F.lag("end").over(w), F.lit(0))
    inner = cuts.withColumn("lo", before).withColumn("hi", F.coalesce(F.col("start"), F.col("__len")))
    last = cuts.groupBy(*key, "__len").agg(F.max("end").alias("lo")).where("lo is not null").select(*key, "lo", F.col("__len").alias("hi"))
    kept = inner.select(*key, "lo", "hi").unionByName(last).where("lo < hi")
    size = F.col("hi") - F.col("lo")
    at = F.sum(size).over(Window.partitionBy(*key).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)) - size
    return kept.select(*key, F.col("lo").alias("start"), F.col("hi").alias("end"), at.alias("output_start"))


def overlaps(a: DataFrame, b: DataFrame, key: list[str], width: int) -> DataFrame:
    """Bytes that spans of ``a`` (a_id) and ``b`` (b_id) share.

    Both sides are cut at multiples of ``width`` and joined on the block, so
    the join is one by equality whatever the spans; the shares of the blocks
    are added up.
    """

    def blocks(df: DataFrame, p: str) -> DataFrame:
        k = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}")))
        rows = df.where("start < end").withColumn("block", k)
        lo, hi = F.greatest("start", F.col("block") * width), F.least("end", (F.col("block") + 1) * width)
        return rows.select(*key, f"{p}_id", "block", lo.alias(f"{p}_lo"), hi.alias(f"{p}_hi"))

    met = blocks(a, "a").join(blocks(b, "b"), [*key, "block"]).withColumn("n", F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo"))
    return met.where("n > 0").groupBy(*key, "a_id", "b_id").agg(F.sum("n").alias("bytes"))


def span_at(points: DataFrame, spans: DataFrame, key: list[str], pos: str, width: int, name: str = "span_id") -> DataFrame:
    """The span with start <= pos < end for each point, -1 if none; spans of one key must not overlap."""
    k = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}")))
    cut = spans.where("start < end").withColumn("block", k).select(*key, "block", "start", "end", F.col("id").alias(name))
    tagged = points.withColumn("block", F.expr(f"{pos} div {width}"))
    near = tagged.join(cut, [*key, "block"], "left").withColumn("__hit", (F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end")))
    best = F.max(F.when(F.col("__hit"), F.col(name)))
    return near.groupBy(*points.columns).agg(F.coalesce(best, F.lit(-1)).alias(name))


def suffix_budget(units: DataFrame, key: list[str], order: list, size: str, budgets: list[int]) -> DataFrame:
    """Which units of a rendering lie in its last ``budget`` bytes, wholly or in part.

    ``bytes_in`` is what of the unit is inside; ``eligible`` whether the
    rendering fills the budget. Units wholly outside are left out.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    total = F.sum(size).over(Window.partitionBy(*key))
    end = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = units.withColumns({"__total": total, "__end": end}).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    inside = F.least(F.col("__end") - F.greatest(F.col("__total") - F.col("budget"), F.lit(0)), F.col(size))
    out = rows.withColumn("bytes_in", inside).where("bytes_in > 0")
    return out.withColumns({"whole": F.col("bytes_in") == F.col(size), "eligible": F.col("__total") >= F.col("budget")}).drop("__total", "__end")


def group_windows(tokens: DataFrame, key: str, pos: str, grp: str, size: int, min_tail: int = 0) -> DataFrame:
    """Windows of ``size`` tokens that never split a group: ``key, win_start, win_end``.

    A nominal end inside a group moves back to the group's start; a group that
    fills the window extends it. Sequential in a key, whose tokens stream
    through one task in order; only the window's group starts are held. A last
    window shorter than ``min_tail`` is dropped unless it is the only one.
    """
    kind = tokens.schema[key].dataType.simpleString()
    rows = tokens.select(F.col(key).alias("key"), F.col(grp).cast("bigint").alias("grp"), F.col(pos).alias("pos")).repartition("key").sortWithinPartitions("key", "pos").drop("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # key, number of tokens, start, last group, starts of groups inside the window, windows

        def close(s):
            while s["n"] - s["start"] > size and s["opens"]:
                inside = [o for o in s["opens"] if o <= s["start"] + size]
                end = inside[-1] if inside else s["opens"][0]
                s["out"].append((s["start"], end))
                s["start"], s["opens"] = end, [o for o in s["opens"] if o > end]
            if s["n"] > s["start"]:
                s["out"].append((s["start"], s["n"]))
            if len(s["out"]) > 1 and s["out"][-1][1] - s["out"][-1][0] < min_tail:
                s["out"].pop()
            return [(s["key"], a, b) for a, b in s["out"]]

        for batch in batches:
            done = []
            for k, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or state["key"] != k:
                    if state is not None:
                        done += close(state)
                    state = {"key": k, "n": 0, "start": 0, "grp": None, "opens": [], "out": []}
                i = state["n"]
                if g != state["grp"]:
                    while i - state["start"] >= size:  # the window is full and a group begins here
                        inside = [o for o in [*state["opens"], i] if o - state["start"] <= size]
                        end = inside[-1] if inside else [*state["opens"], i][0]
                        state["out"].append((state["start"], end))
                        state["start"] = end
                        state["opens"] = [o for o in state["opens"] if o > end]
                    if i > state["start"]:
                        state["opens"].append(i)
                    state["grp"] = g
                state["n"] += 1
            yield _windows(done, batch.schema.types[0])
        if state is not None:
            yield _windows(close(state), pa.string() if kind == "string" else None)

    return rows.mapInArrow(run, f"key {kind}, win_start bigint, win_end bigint").withColumnRenamed("key", key)


def _windows(rows: list[tuple], kind) -> pa.RecordBatch:
    k, a, b = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, kind), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "win_start", "win_end"])
