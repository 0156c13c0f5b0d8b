"""Parent-child rows to full hierarchies: root, depth, path, descendants, cycles.

Every node has at most one parent. Three steps, each a short series of joins
whose number grows with the logarithm of the depth or of the tree size:

1. Leaves are peeled, 2**k layers in round k: a node survives N rounds of
   leaf peeling exactly if it is the N-th ancestor of some node, so squaring
   the parent map peels as many layers as all rounds before it. Nodes that
   reach a parentless node are in trees and leave the loop; what survives once
   the image stops shrinking is the set of cycle members.
2. Every cycle is contracted into its smallest member, and an Euler tour
   (enter and exit arc of each node, siblings by id) is linked up. Sibling
   links come from a range-partitioned sort, so a parent with millions of
   children is spread over tasks.
3. List ranking by pointer jumping gives each arc its distance from the end of
   its list, the number of nodes it lies below, and the last arc, which is the
   one that leaves the root. An arc that has reached the end leaves the loop.

Roots, depths and sizes come from the ranked tours, paths and descendants from
their intervals. A node u is an ancestor of v (u != v) exactly if both have the same ``tour``
and enter(u) <= enter(v) and exit(u) >= exit(v). Members of one cycle share
one interval, which makes each an ancestor of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.joins import split_join
from tessella.scratch import Scratch

MAX_ROUNDS = 62
#: Blocks of at most 2**TOP positions in the search for ancestors.
TOP = 12


def hierarchy(nodes: DataFrame, id_col: str, parent_col: str, with_path: bool = False) -> DataFrame:
    """One row per node: id, parent, root, depth, cycle state and interval.

    ``nodes`` must hold unique non-null bigint ids; rows with a null id are
    left out. A null parent, or a parent that is no id of the table, makes the
    node a root. Result columns: ``id, parent, root, depth, in_cycle,
    below_cycle, tour, enter, exit, n_descendants`` and with ``with_path``
    also ``path`` (ids from the root to the node). On or below a cycle root
    is -1, depth and path are null. An empty table gives an empty result.
    Ids must lie within +-2**61.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark)
    base = nodes.select(F.col(id_col).cast("bigint").alias("id"), F.col(parent_col).cast("bigint").alias("parent")).where("id is not null")
    known = base.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    links = scratch.cut(split_join(base, known, ["parent"], "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent")), "links")
    n = links.count()

    settled, cycles = _peel(links, scratch)
    tours = _tours(links, settled, cycles, scratch, n)
    tree = _assemble(links, cycles, tours, n)
    if with_path:
        tree = scratch.cut(tree, "tree")
        up = ancestors(tree).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "ancestor"))).alias("up"))
        path = F.concat(F.coalesce(F.transform("up", lambda x: x["ancestor"]), F.array().cast("array<bigint>")), F.array("id"))
        tree = tree.join(up, "id", "left").withColumn("path", F.when(F.col("depth").isNotNull(), path)).drop("up")
    return tree


def ancestors(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Pairs (id, ancestor, at, distance) of the nodes of trees, from the intervals; ``at`` is where the ancestor is entered.

    Of all nodes, or of those in ``of`` (column id).

    The inside of an ancestor's interval is cut into blocks of 2**k positions,
    a node lies in one block of each size, and the two are joined by equality:
    each pair meets once, and no block holds more than 2**TOP nodes.
    """
    inside = tree.where("depth is not null").select("id", "tour", "enter", "exit", "depth")
    # the blocks of [enter + 1, exit): at each size at most one at either end, at the largest all that are left
    low, high = "shiftright(enter + shiftleft(1L, k), k)", "shiftright(exit, k)"
    end = f"array_compact(array(if({low} < {high} and {low} % 2 = 1, struct(k, {low} as b), null), if({low} < {high} and {high} % 2 = 1, struct(k, {high} - 1 as b), null)))"
    low_top, high_top = low.replace("k)", f"{TOP})"), high.replace("k)", f"{TOP})")
    whole = f"if({low_top} < {high_top}, transform(sequence({low_top}, {high_top} - 1), b -> struct({TOP} as k, b)), array())"
    blocks = F.expr(f"concat(flatten(transform(sequence(0, {TOP - 1}), k -> {end})), {whole})")
    up = inside.where("exit - enter > 1").select("tour", F.col("id").alias("ancestor"), F.col("enter").alias("at"), F.col("depth").alias("a_depth"), F.explode(blocks).alias("x")).select("tour", "ancestor", "at", "a_depth", "x.k", "x.b")
    below = inside.where("depth > 0")
    if of is not None:
        below = below.join(of, "id", "left_semi")
    down = below.select("tour", "id", "depth", F.explode(F.expr(f"transform(sequence(0, {TOP}), k -> struct(k, shiftright(enter, k) as b))")).alias("x")).select("tour", "id", "depth", "x.k", "x.b")
    return down.join(up, ["tour", "k", "b"]).select("id", "ancestor", "at", (F.col("depth") - F.col("a_depth")).alias("distance"))


def _jumped(open_rows: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """The open rows of a round with what they find where they jump to."""
    to = targets.select(F.col("id").alias("jump"), F.col("jump").alias("further"), F.col("done"), F.col("low").alias("t_low"))
    return split_join(open_rows.select("id", "jump", "low"), to, ["jump"], rows=n).select("id", F.col("further").alias("jump"), "done", F.least("low", "t_low").alias("low"))


def _peel(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Settled nodes (id, jump: the root of their tree), and the nodes on or below a cycle (id, cycle_of, in_cycle; None if there are none).

    A cycle is named by its least member. Only open nodes are joined; a round
    in which none is settled leaves those of cycles.
    """
    start = links.select("id", F.coalesce("parent", "id").alias("jump"), F.col("parent").isNull().alias("done"), F.coalesce("parent", "id").alias("low"))
    settled = scratch.cut(start.where("done"), "settled")
    open_rows = scratch.cut(start.where("not done"), "open")
    n_open = open_rows.count()
    while n_open:
        new = scratch.cut(_jumped(open_rows, open_rows.unionByName(settled), n_open), "peel")
        scratch.free(open_rows)
        open_rows = new.where("not done")
        settled = settled.unionByName(new.where("done"))
        n_still = open_rows.count()
        if n_still == n_open:
            break
        n_open = n_still
    if not n_open:
        return settled.select("id", "jump"), None
    stuck = scratch.cut(open_rows, "stuck")
    size, lows = -1, None
    for _ in range(MAX_ROUNDS):
        core = stuck.select(F.col("jump").alias("id")).distinct()
        now = core.join(stuck, "id").agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first()
        if (now[0], now[1]) == (size, lows):
            break
        size, lows = now
        new = scratch.cut(_jumped(stuck, stuck, n_open), "stuck")
        scratch.free(stuck)
        stuck = new
    # jump is a cycle member; its low is the least member of that cycle
    core = scratch.cut(stuck.select(F.col("jump").alias("id")).distinct().join(stuck, "id").select(F.col("id").alias("jump"), F.col("low").alias("cycle_of")), "core")
    inside = core.select(F.col("jump").alias("id"), F.lit(True).alias("in_cycle"))
    marked = split_join(stuck.select("id", "jump"), core, ["jump"], rows=n_open).join(inside, "id", "left")
    return settled.select("id", "jump"), scratch.cut(marked.select("id", "cycle_of", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle")), "cycles")


def _siblings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (up, id) to id, up, next sibling; the first and last row of the task are marked."""
    first, held = True, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = pa.concat_arrays([*([held[0]] if held else []), batch.column(0)])
        ups = pa.concat_arrays([*([held[1]] if held else []), batch.column(1)])
        n = len(ids)
        if n > 1:
            same = pc.equal(ups.slice(0, n - 1), ups.slice(1))
            nxt = pc.if_else(same, ids.slice(1), pa.scalar(None, pa.int64()))
            yield _rows(ids.slice(0, n - 1), ups.slice(0, n - 1), nxt, first, False)
            first = False
        held = (ids.slice(n - 1), ups.slice(n - 1))
    if held:
        yield _rows(held[0], held[1], pa.nulls(1, pa.int64()), first, True)


def _rows(ids, ups, nxt, first: bool, last: bool) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [ids, ups, nxt, pa.array([first] + [False] * (n - 1)), pa.array([False] * (n - 1) + [last])],
        names=["id", "up", "next", "head", "tail"],
    )


def _tours(links: DataFrame, settled: DataFrame, cycles: DataFrame | None, scratch: Scratch, n: int) -> DataFrame:
    """id, tour, enter, exit, depth of each node that is its own tour node; ``tour`` is the node whose exit ends the list."""
    spark = links.sparkSession
    # group tells the lists apart, so that a finished one leaves the ranking as a whole
    tree = links.join(settled, "id").select("id", F.col("parent").alias("up"), F.col("jump").alias("group"))
    if cycles is not None:
        above = cycles.select(F.col("id").alias("parent"), F.when(F.col("in_cycle"), F.col("cycle_of")).alias("merged"))
        caught = split_join(links.join(cycles, "id").where("not in_cycle or id = cycle_of"), above, ["parent"], "left", n)
        up = F.when(~F.col("in_cycle"), F.coalesce("merged", "parent"))
        tree = tree.unionByName(caught.select("id", up.alias("up"), F.col("cycle_of").alias("group")))
    tree = scratch.cut(tree, "tree")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    linked = (
        tree.where("up is not null")
        .select("id", "up")
        .repartitionByRange(parts, "up", "id")
        .sortWithinPartitions("up", "id")
        .mapInArrow(_siblings, "id bigint, up bigint, next bigint, head boolean, tail boolean")
        .withColumn("pid", F.spark_partition_id())
    )
    linked = scratch.cut(linked, "siblings")
    # one row per task of the sort: heads follow the tails of the task before
    ends = linked.where("head or tail").collect()
    heads = sorted((r["pid"], r["id"], r["up"]) for r in ends if r["head"])
    patch = []
    for (p, *_), (q, nid, nup) in zip(heads, heads[1:]):
        tail = next(r for r in ends if r["pid"] == p and r["tail"])
        if tail["up"] == nup:
            patch.append((tail["id"], nid))
    nxt = linked.select("id", "next")
    if patch:
        fix = spark.createDataFrame(patch, "id bigint, fixed bigint")
        nxt = nxt.join(F.broadcast(fix), "id", "left").select("id", F.coalesce("next", "fixed").alias("next"))
    firsts = tree.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.min("id").alias("child"))
    sizes = tree.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    wide = tree.join(firsts, "id", "left").join(nxt, "id", "left")
    # arc 2v enters v, arc 2v + 1 leaves it; the list ends with null
    arcs = wide.select(
        "group",
        F.explode(
            F.array(
                F.struct((F.col("id") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("to"), F.lit(1).alias("w")),
                F.struct((F.col("id") * 2 + 1).alias("arc"), F.coalesce(F.col("next") * 2, F.col("up") * 2 + 1).alias("to"), F.lit(-1).alias("w")),
            )
        ).alias("a"),
    ).select("group", "a.arc", F.col("a.to").alias("to"), F.coalesce("a.to", "a.arc").alias("last"), F.lit(1).cast("bigint").alias("dist"), F.col("a.w").cast("bigint").alias("open"))
    active = scratch.cut(split_join(arcs, sizes, ["group"], rows=2 * n), "arcs")
    names = ["group", "arc", "to", "last", "dist", "open", "size"]
    ranked, reach = [], 1
    while True:
        # arcs at the end of their list stay as they are; every other has a successor of its own, so no key is hot
        t = active.select(F.col("arc").alias("to"), F.col("to").alias("t_to"), F.col("last").alias("t_last"), F.col("dist").alias("t_dist"), F.col("open").alias("t_open"))
        moved = active.where("to is not null").join(t, "to").select(
            "group", "arc", F.col("t_to").alias("to"), F.col("t_last").alias("last"), (F.col("dist") + F.col("t_dist")).alias("dist"), (F.col("open") + F.col("t_open")).alias("open"), "size"
        )
        new = scratch.cut(moved.unionByName(active.where("to is null").select(names)), "arcs")
        scratch.free(active)
        reach *= 2
        ranked.append(new.where(F.col("size") * 2 <= reach))
        active = new.where(F.col("size") * 2 > reach)
        if not active.limit(1).count():
            break
        active = scratch.cut(active, "arcs")
    whole = ranked[0]
    for part in ranked[1:]:
        whole = whole.unionByName(part)
    even = F.pmod("arc", F.lit(2)) == 0
    place = F.col("size") * 2 - F.col("dist")
    return scratch.cut(
        whole.groupBy(F.shiftright("arc", 1).alias("id")).agg(
            F.max(F.shiftright("last", 1)).alias("tour"),
            F.min(F.when(even, place)).alias("enter"),
            F.min(F.when(~even, place)).alias("exit"),
            F.min(F.when(even, -F.col("open"))).alias("depth"),
        ),
        "tours",
    )


def _assemble(links: DataFrame, cycles: DataFrame | None, tours: DataFrame, n: int) -> DataFrame:
    free = F.lit(None)
    rows = links.withColumns({"cycle_of": free.cast("bigint"), "in_cycle": F.lit(False)}) if cycles is None else links.join(cycles, "id", "left")
    inside = F.coalesce("in_cycle", F.lit(False))
    rows = rows.withColumn("owner", F.when(inside, F.col("cycle_of")).otherwise(F.col("id")))
    out = split_join(rows, tours.withColumnRenamed("id", "owner"), ["owner"], "left", n)
    below = ((F.col("exit") - F.col("enter") + 1) / 2).cast("bigint") - 1
    if cycles is not None:
        lengths = cycles.where("in_cycle").groupBy("cycle_of").agg(F.count(F.lit(1)).alias("length"))
        out = split_join(out, lengths, ["cycle_of"], "left", n)
        below = F.when(inside, below + F.col("length") - 1).otherwise(below)
    tree = F.col("cycle_of").isNull()
    return out.select(
        "id",
        "parent",
        F.when(tree, F.col("tour")).otherwise(F.lit(-1)).cast("bigint").alias("root"),
        F.when(tree, F.col("depth")).alias("depth"),
        inside.alias("in_cycle"),
        (~tree & ~inside).alias("below_cycle"),
        "tour",
        "enter",
        "exit",
        below.alias("n_descendants"),
    )


def order_violations(orders: DataFrame, order_col: str, list_col: str, tree: DataFrame) -> DataFrame:
    """Orders that list a node ahead of another of its ancestors.

    ``orders`` has one row per ``order_col``; ``list_col`` is an array of node
    ids. The first mention of an id counts; nulls and ids that ``tree`` lacks
    are passed over; a null or empty list has no violation. One row per order:
    ``order_col, n_listed, violates``. Orders with a null key are left out.
    """
    lists = orders.where(F.col(order_col).isNotNull()).select(F.col(order_col).alias("__o"), F.col(list_col).alias("__l"))
    items = (
        lists.select("__o", F.posexplode("__l").alias("pos", "id"))
        .where("id is not null")
        .groupBy("__o", "id")
        .agg(F.min("pos").alias("pos"))
        .join(tree.select("id", "tour", "enter", "exit"), "id")
        .groupBy("__o")
        .agg(F.collect_list(F.struct("tour", "enter", "exit", "pos")).alias("items"))
    )
    checked = items.mapInArrow(_sweep, "__o bigint, n_listed bigint, violates boolean")
    return lists.select("__o").join(checked, "__o", "left").select(
        F.col("__o").alias(order_col),
        F.coalesce("n_listed", F.lit(0).cast("bigint")).alias("n_listed"),
        F.coalesce("violates", F.lit(False)).alias("violates"),
    )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In preorder, a stack of open ancestors with the latest position among them."""
    for batch in batches:
        counts, flags = [], []
        for items in batch.column(1).to_pylist():
            rows = sorted((r["tour"], r["enter"], -r["exit"], r["pos"]) for r in items)
            bad, stack = False, []
            for tour, enter, leave, pos in rows:
                while stack and (stack[-1][0] != tour or stack[-1][1] < enter):
                    stack.pop()
                if stack:
                    # equal intervals belong to members of one cycle
                    if stack[-1][3] > pos or (stack[-1][1] == -leave and stack[-1][2] == enter):
                        bad = True
                        break
                latest = max(pos, stack[-1][3]) if stack else pos
                stack.append((tour, -leave, enter, latest))
            counts.append(len(rows))
            flags.append(bad)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(flags, pa.bool_())], names=["__o", "n_listed", "violates"])
