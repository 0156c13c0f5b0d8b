"""Checks of tables against what they should be: offsets, orders of names, drifts, blind pairs, first reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.prefix import running
from tessella.operators.selection import priority


def first_of(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null rule doesn't."""
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def context_bytes(groups: DataFrame, window: list[str], order: str, size: str, recorded: str) -> DataFrame:
    """Adds ``recomputed``, the bytes of the groups before in the window, and ``same``: it is the recorded offset from the window's first.

    A window of the evaluation is bounded by the model's context, so it is one task's sort.
    """
    w = Window.partitionBy(*window)
    before = F.coalesce(F.sum(size).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    out = groups.withColumns({"recomputed": before, "__first": F.min(recorded).over(w)})
    return out.withColumn("same", F.col(recorded) - F.col("__first") == F.col("recomputed")).drop("__first")


def snap(groups: DataFrame, stream: str, order: list[str], size: str, phases: tuple[int, ...]) -> DataFrame:
    """``group, phase, snapped``: each phase of a stream moved on to the next start of a group.

    ``groups`` has one row per group with its number of tokens. A phase inside
    the last group moves to the end of the stream; one beyond stays.
    """
    laid = running(groups, [stream], order, {"end": F.col(size)}).withColumn("start", F.col("end") - F.col(size))
    marks = [F.min(F.when(F.col("start") >= p, F.col("start"))).alias(f"p{p}") for p in phases]
    per = laid.groupBy(F.col(stream).alias("group")).agg(F.max("end").alias("n"), *marks)
    rows = per.select("group", "n", F.explode(F.array(*[F.struct(F.lit(p).cast("bigint").alias("phase"), F.col(f"p{p}").alias("at")) for p in phases])).alias("x"))
    return rows.select("group", "x.phase", F.when(F.col("x.phase") >= F.col("n"), F.col("x.phase")).otherwise(F.coalesce("x.at", "n")).cast("bigint").alias("snapped"))


def causal_class(row: Column, at: Column) -> Column:
    """Class of a scored row when the token at ``at`` changes: before it, the row that scores it, from it on."""
    return first_of([("protected", row < at - 1), ("excluded", row == at - 1)], "downstream")


def skip_reason(parts: Column, ending: Column, roots: tuple[str, ...], excluded: tuple[str, ...], endings: tuple[str, ...]) -> Column:
    """Why a path (its parts) is not collected: outside of the roots, below an excluded folder, of another ending; or admitted."""
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    rules = [
        ("outside", ~((F.size(parts) > 1) & parts[0].isin(*roots))),
        ("excluded", F.arrays_overlap(inner, F.array(*map(F.lit, excluded)))),
        ("ending", ~ending.isin(*endings)),
    ]
    return first_of(rules, "admitted")


def ordinals(rows: DataFrame, name: list[str], order: list[str]) -> DataFrame:
    """Adds ``ordinal`` (from 0) among the rows of one name, their number ``bindings`` and whether the row is the ``final`` one."""
    w = Window.partitionBy(*name)
    out = rows.withColumns({"ordinal": F.row_number().over(w.orderBy(*order)) - 1, "bindings": F.count(F.lit(1)).over(w)})
    return out.withColumn("final", F.col("ordinal") == F.col("bindings") - 1)


def span_id(marker: str, module: Column, source: Column, start: Column, end: Column) -> Column:
    """sha256 of [marker, module, source, start, end] as compact JSON; null if any is."""
    quoted = F.regexp_extract(F.to_json(F.array(module)), r"^\[(.*)\]$", 1)
    text = F.concat(F.lit(f'["{marker}",'), quoted, F.lit(',"'), source, F.lit('",'), start.cast("string"), F.lit(","), end.cast("string"), F.lit("]"))
    return F.sha2(text, 256)


def drift(rows: DataFrame, key: str, run: str, fields: list[str]) -> DataFrame:
    """``key, run, field`` of each field that differs from the run before; fields must not be null."""
    w = Window.partitionBy(key).orderBy(run)
    was = rows.withColumn("__was", F.lag(F.struct(*fields)).over(w)).where("__was is not null")
    changed = F.array_compact(F.array(*[F.when(F.col(c) != F.col(f"__was.{c}"), F.lit(c)) for c in fields]))
    return was.select(key, run, F.explode(changed).alias("field"))


def blind(pairs: DataFrame, a: str, b: str, role: str, seed: str) -> DataFrame:
    """Each pair once: ``pair_id, left_id, right_id, place, roles, n_roles``.

    Pairs chosen in several roles appear once; id, side and place come from
    hashes of the pair alone, so they tell nothing of the roles. A pair has
    few roles, which are collected in order.
    """
    one = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.array_sort(F.collect_set(role)).alias("roles")).withColumn("pair_id", priority(f"{seed}:pair", "a", "b"))
    swap = F.conv(F.right(priority(f"{seed}:side", "pair_id"), F.lit(1)), 16, 10).cast("int") % 2 == 1
    return one.select(
        "pair_id",
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("left_id"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("right_id"),
        priority(f"{seed}:order", "pair_id").alias("place"),
        "roles",
        F.size("roles").alias("n_roles"),
    )


def overlap_class(overlaps: DataFrame, key: list[str], cls: str, core: tuple[str, ...]) -> DataFrame:
    """``key, class`` from the classes that a key overlaps: the one core class, ``mixed_core``, or ``comment_layout``, ``comment`` or ``layout``."""
    kind = F.col(cls)
    mine = F.when(kind.isin(*core), kind)
    per = overlaps.groupBy(*key).agg(F.count_distinct(mine).alias("n"), F.max(mine).alias("one"), F.max(kind == "comment").alias("comment"), F.max(kind == "layout").alias("layout"))
    rest = first_of([("mixed_core", F.col("n") > 1), ("comment_layout", F.col("comment") & F.col("layout")), ("comment", F.col("comment"))], "layout")
    return per.select(*key, F.when(F.col("n") == 1, F.col("one")).otherwise(rest).alias("class"))


def ledger(groups: DataFrame, key: list[str], start: str, size: str, body: str) -> DataFrame:
    """Groups ``before``, ``inside`` and ``across`` the byte at which the body starts, and the bytes on either side."""
    end = F.col(start) + F.col(size)
    head = F.greatest(F.least(end, F.col(body)) - F.col(start), F.lit(0))
    return groups.groupBy(*key).agg(
        F.count_if(end <= F.col(body)).alias("before"),
        F.count_if((end > F.col(body)) & (F.col(start) >= F.col(body))).alias("inside"),
        F.count_if((end > F.col(body)) & (F.col(start) < F.col(body))).alias("across"),
        F.sum(head).cast("bigint").alias("prefix_bytes"),
        (F.sum(size) - F.sum(head)).cast("bigint").alias("body_bytes"),
    )
