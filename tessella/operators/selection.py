"""Seeded selection: priorities, budgets, quotas, strata, pools, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.joins import lookup_join
from tessella.operators.prefix import running
from tessella.scratch import Scratch


def priority(seed, *fields) -> F.Column:
    """sha256 of the seed and fields joined by colons, as hex; the same for a row whatever else there is."""
    parts = [F.lit(str(seed))] + [F.col(f).cast("string") if isinstance(f, str) else f for f in fields]
    return F.sha2(F.concat_ws(":", *parts), 256)


def running_spans(files: DataFrame, group: list[str], order: list, size: str) -> DataFrame:
    """Half-open byte spans [start, end) of files laid end to end in the given order."""
    return running(files, group, order, {"end": F.col(size).cast("bigint")}).withColumn("start", F.col("end") - F.col(size))


def greedy_fill(files: DataFrame, stream: str, key: str, size: str, order: str, cap: str, base: str | None = None) -> DataFrame:
    """Files in hash order, each taken if it still fits; others are passed over, not stopped at.

    ``cap`` names a column with the budget of the stream. Rows whose ``base``
    column is true are taken first, whatever their size. One row per taken
    file: ``stream, key, size`` and ``used``, the sum after it. Rows without
    size, stream or cap are left out; sizes must not be negative.

    In rounds instead of row by row: what fits in one go is a prefix by the
    running sum. The file behind it doesn't fit, so what room is left is
    smaller than that file, and only later files that are no larger than the
    room can still be taken. The room shrinks about by half each round, and no
    task ever holds a whole stream.
    """
    scratch = Scratch(files.sparkSession)
    first = F.coalesce(F.col(base), F.lit(False)) if base else F.lit(False)
    rows = files.where(F.col(size).isNotNull() & F.col(stream).isNotNull() & F.col(cap).isNotNull()).select(
        F.col(stream).alias("stream"), F.col(key).alias("key"), F.col(size).cast("bigint").alias("size"), F.col(cap).cast("bigint").alias("cap"), first.alias("base"), F.col(order).alias("rank")
    )
    rows = scratch.cut(rows, "files")
    rooms = rows.groupBy("stream").agg(F.coalesce(F.sum(F.when(F.col("base"), F.col("size"))), F.lit(0)).alias("spent"), F.max("cap").alias("cap"))
    rooms = scratch.cut(rooms.select("stream", "spent", (F.col("cap") - F.col("spent")).alias("room")), "rooms")
    taken = [running(rows.where("base"), ["stream"], ["rank", "key"], {"used": F.col("size")}).select("stream", "key", "size", "used")]
    left = lookup_join(rows.where("not base").drop("cap", "base"), rooms, ["stream"], "inner").where("size <= room")
    while True:
        summed = scratch.cut(running(left, ["stream"], ["rank", "key"], {"upto": F.col("size")}), "fill")
        fits = F.col("upto") <= F.col("room")
        taken.append(summed.where(fits).select("stream", "key", "size", (F.col("spent") + F.col("upto")).alias("used")))
        # the first file that doesn't fit, and what was taken before it
        edge = F.min(F.when(~fits, F.struct("rank", "key")))
        ends = summed.groupBy("stream").agg(edge.alias("edge"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("got")).where("edge is not null")
        rest = lookup_join(summed.where(~fits), scratch.cut(ends, "ends"), ["stream"], "inner").where(F.struct("rank", "key") > F.col("edge"))
        rest = rest.withColumns({"spent": F.col("spent") + F.col("got"), "room": F.col("room") - F.col("got")}).where("size <= room")
        left = scratch.cut(rest.select("stream", "key", "size", "rank", "spent", "room"), "left")
        if not left.limit(1).count():
            break
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out.withColumnsRenamed({"stream": stream, "key": key, "size": size})


def exact_dedup(files: DataFrame, digest: str, order: list) -> DataFrame:
    """One file per content, the first in the given order, with the number of its copies.

    ``digest`` is a column with the hash of the content, so that no content is
    shuffled; whoever wants it joins it to the kept files. Rows without a hash
    are left out.
    """
    names = [c for c in files.columns if c != digest]
    first = F.min(F.struct(*order, *[c for c in names if c not in order]))
    rows = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(first.alias("r"), F.count(F.lit(1)).alias("copies"))
    return rows.select(digest, "copies", *[F.col(f"r.{c}").alias(c) for c in names])


#: Lengths of the prefixes by which hashes are folded into one; a fold takes at most 16**3 parts beyond the first.
DIGEST_LEVELS = (9, 6, 3, 0)


def set_digest(rows: DataFrame, group: list[str], digest: str) -> DataFrame:
    """One hash per group for its hex hashes, whatever their order; repeated ones count. Columns: ``group, digest``.

    Hashes are folded by prefix, from long to short: each fold is the sha256
    of what shares the prefix, in order. So no task ever holds all hashes of a
    group.
    """
    level = rows.where(F.col(digest).isNotNull()).select(*group, F.col(digest).alias("p"), F.col(digest).alias("h"))
    for n in DIGEST_LEVELS:
        parts = level.select(*group, F.substring("p", 1, n).alias("q"), "p", "h").groupBy(*group, "q").agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("x"))
        level = parts.select(*group, F.col("q").alias("p"), F.sha2(F.array_join(F.transform("x", lambda y: y["h"]), ""), 256).alias("h"))
    return level.select(*group, F.col("h").alias("digest"))


def holdout(files: DataFrame, group: list[str], order: list) -> DataFrame:
    """Every tenth file (number 7 of each ten, from 0) is held out."""
    rows = running(files, group, order, {"position": F.lit(1)})
    return rows.withColumn("position", F.col("position") - 1).withColumn("held_out", F.pmod("position", F.lit(10)) == 7)


def stride_thin(files: DataFrame, group: list[str], order: list, size: str, cap: int) -> DataFrame:
    """Beyond the cap every step-th file is kept while the sum of the kept before it is below the cap."""
    totals = files.groupBy(*group).agg(F.sum(size).alias("total"))
    rows = lookup_join(running(files, group, order, {"position": F.lit(1)}), totals, group, "inner").withColumn("position", F.col("position") - 1)
    step = F.greatest(F.lit(1), F.rint(F.col("total") / cap)).cast("bigint")
    rows = rows.withColumn("step", F.when(F.col("total") > cap, step).otherwise(F.lit(1).cast("bigint")))
    nominal = F.pmod("position", F.col("step")) == 0
    mine = F.when(nominal, F.col(size)).otherwise(F.lit(0)).cast("bigint")
    summed = running(rows, group, order, {"upto": mine})
    before = F.col("upto") - F.when(nominal, F.col(size)).otherwise(F.lit(0))
    return summed.withColumn("kept", nominal & ((F.col("total") <= cap) | (before < cap))).drop("upto")


def tercile_cutpoints(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Order statistics at floor((n - 1) / 3) and floor(2 (n - 1) / 3).

    Ranks come from counts per value, so a group is never sorted row by row.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*group)
    upto = per.withColumns({"upto": F.sum("m").over(w.orderBy(value)), "n": F.sum("m").over(w)})
    at = lambda k: F.min(F.when(F.col("upto") > F.expr(f"{k} * (n - 1) div 3"), F.col(value)))
    return upto.groupBy(*group).agg(F.max("n").alias("n"), at(1).alias("q1"), at(2).alias("q2"))


def tercile(value: str) -> F.Column:
    return F.when(F.col(value) <= F.col("q1"), 1).when(F.col(value) <= F.col("q2"), 2).otherwise(3)


def hamilton(populations: DataFrame, group: list[str], label: str, population: str, seats: str) -> DataFrame:
    """Proportional quotas by largest remainder, ties by label; never more than the population, no rebalancing."""
    w = Window.partitionBy(*group)
    share = F.col(seats).cast("bigint") * F.col(population)
    rows = populations.withColumn("total", F.sum(population).over(w)).where("total > 0")
    rows = rows.withColumns({"floor": F.expr(f"{seats} * {population} div total"), "rem": F.pmod(share, F.col("total"))})
    left = F.col(seats) - F.sum("floor").over(w)
    place = F.row_number().over(w.orderBy(F.desc("rem"), label))
    return rows.withColumn("quota", (F.col("floor") + (place <= left).cast("bigint")).cast("bigint")).drop("floor", "rem")


def top_by_quota(rows: DataFrame, quotas: DataFrame, cell: list[str], order: list, most: int) -> DataFrame:
    """The first ``quota`` rows of each cell in the given order; no quota is above ``most``.

    The bound lets each task keep its first ``most`` rows of a cell before
    anything is shuffled.
    """
    r = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    few = rows.withColumn("r", r).where(F.col("r") <= most)
    return few.join(quotas.select(*cell, "quota"), cell).where("r <= quota").drop("quota")


def round_robin(rows: DataFrame, cell: list[str], turn: str, order: list, cap: int) -> DataFrame:
    """Up to ``cap`` rows per cell, the first of each ``turn`` value before the second of any."""
    nth = F.row_number().over(Window.partitionBy(*cell, turn).orderBy(*order))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= cap)  # no turn gives more than the cap
    slot = F.row_number().over(Window.partitionBy(*cell).orderBy("nth", turn))
    return few.withColumn("slot", slot).where(F.col("slot") <= cap)
