"""Queries that check tables against each other: streams, sizes, identities, closures, blind pairs, resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import audits as A
from tessella.operators import graph, hierarchy, selection, similarity, spans
from tessella.operators.prefix import running
from tessella.plans.curves import CUTOFFS, _G, _groups, _pairs, _tokens
from tessella.plans.curves import _PAIRS as _PHASES
from tessella.plans.governance import ORACLE as _GOVERNANCE
from tessella.plans.governance import _SRC, smallest_n, span_overlap_attribution
from tessella.plans.hierarchy import _DECLS, _orders, _tree, declarations
from tessella.plans.selection import _F, _files
from tessella.plans.similarity import _COL, _SETS, _hashed
from tessella.plans.similarity import jaccard_pairs as _jaccard
from tessella.scratch import Scratch
from tessella.sources.tables import table

# Floors of streams and of masking, bytes of a window, the vocabulary of a perturbation.
FULL_FLOOR, TARGET_FLOOR = 500_000, 1_000_000
MASK_DOCS, MASK_BYTES = 20, 300_000
WINDOW_BYTES = 105_000
VOCABULARY = 50_000
# Where tracked sources are looked for.
ROOTS, EXCLUDED, ENDINGS = ("src", "lib", "tools"), ("tests", "vendor", "third_party"), ("py", "lean")
PHASES = (0, 100, 1_000, 10_000)
COPIES = 8
WINDOW_TOKENS = 64


def _r(c, n=6):
    return F.round(c, n).alias(c)


# ---- streams of tokens


def context_bytes(spark, d):
    """Bytes before each group in its window, summed anew, beside what the dump recorded."""
    return A.context_bytes(_groups(spark, d), ["cell_name", "win"], "grp", "blen", "ctxb").select("cell_name", "win", "grp", "ctxb", "recomputed", "same")


def phase_snap(spark, d):
    """Each phase of a cell's stream moved on to where the next group begins."""
    g = _groups(spark, d).select("cell_name", "win", "grp", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    return A.snap(g, "cell_name", ["win", "grp"], "n_tokens", PHASES).withColumnRenamed("group", "cell_name")


def causality_partition(spark, d):
    """Rows and bytes of each window before, at and behind the row that a change in its middle token touches."""
    order = ["ctxb", "grp", "tok", "blen", "nll", "doc"]
    w = Window.partitionBy("cell_name", "win")
    t = _tokens(spark, d).withColumns({"j": F.row_number().over(w.orderBy(*order)) - 1, "n": F.count(F.lit(1)).over(w)}).where("n > 1")
    cls = A.causal_class(F.col("j"), F.expr("n div 2"))
    return t.groupBy("cell_name", "win", cls.alias("cls")).agg(F.count(F.lit(1)).alias("row_count"), F.sum("blen").cast("bigint").alias("bytes"))


def perturbed_tokens(spark, d):
    """Distinct tokens with the id that a single-token perturbation gives them; always another one."""
    t = _tokens(spark, d).select("tok").distinct()
    return t.select("tok", F.pmod(F.col("tok") + 1, F.lit(VOCABULARY)).cast("int").alias("changed"))


def delta_profile(spark, d):
    """Signed and absolute change of each group between two phases."""
    delta = F.round(F.col("nll_0") - F.col("nll_p"), 8)
    return _pairs(spark, d).select("win", "grp", (delta + 0.0).alias("signed"), F.abs(delta).alias("absolute"))


def duplicate_control(spark, d):
    """Bits per byte of eight consecutive parts of each cell's windows."""
    per = _groups(spark, d).groupBy("cell_name", "win").agg(F.sum(F.col("nll").cast("decimal(28,8)")).alias("nll"), F.sum("blen").alias("bytes"))
    n = per.groupBy("cell_name").agg(F.count(F.lit(1)).alias("n"))
    placed = running(per, ["cell_name"], ["win"], {"place": F.lit(1)}).join(n, "cell_name").withColumn("part", F.expr(f"(place - 1) * {COPIES} div n"))
    parts = placed.groupBy("cell_name", "part").agg(F.count(F.lit(1)).alias("windows"), F.sum("bytes").cast("bigint").alias("bytes"), F.sum("nll").cast("double").alias("nll"))
    return parts.where("bytes > 0").select("cell_name", "part", "windows", "bytes", F.round(F.col("nll") / F.log(F.lit(2.0)) / F.col("bytes"), 6).alias("bpb"))


def order_ablation_sets(spark, d):
    """Documents of the topological and the shuffled stream of a model and corpus: how many, and how many only in one."""
    m = table(spark, d, "cells_meta").where("stream_kind in ('full_topo', 'full_shuffled')").select("cell_name", "model_name", "corpus", "stream_kind").distinct()
    docs = table(spark, d, "token_dump").where("doc >= 0").select("cell_name", "doc").distinct().join(F.broadcast(m), "cell_name")
    sides = docs.groupBy("model_name", "corpus", "doc").agg(F.max(F.col("stream_kind") == "full_topo").alias("t"), F.max(F.col("stream_kind") == "full_shuffled").alias("s"))
    out = sides.groupBy("model_name", "corpus").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("t") & ~F.col("s")).alias("only_topo"), F.count_if(F.col("s") & ~F.col("t")).alias("only_shuffled"))
    return out.withColumn("equal", (F.col("only_topo") == 0) & (F.col("only_shuffled") == 0))


def model_class(spark, d):
    """Class of each group from the classes of source that it overlaps: its one core class, mixed_core, or what of comment and layout there is."""
    o = span_overlap_attribution(spark, d).where("bytes > 0")
    return A.overlap_class(o, ["cell_name", "win", "grp"], "cls", ("word", "literal", "symbol"))


def body_ledger(spark, d):
    """Groups of each window before, in and across the start of the body, here the middle byte; bytes are conserved."""
    g = _groups(spark, d).select("cell_name", "win", F.col("ctxb").cast("bigint").alias("start"), "blen")
    g = g.withColumn("body", F.expr("(min(start) over (partition by cell_name, win) + max(start + blen) over (partition by cell_name, win)) div 2"))
    return A.ledger(g, ["cell_name", "win"], "start", "blen", "body")


def group_windows(spark, d):
    """Windows of 64 tokens over each cell's stream that never split a group."""
    t = _tokens(spark, d).select("cell_name", F.xxhash64("win", "grp").alias("g"), F.struct("win", "grp").alias("at"))
    return spans.group_windows(t, "cell_name", "at", "g", WINDOW_TOKENS)


# ---- sizes, locks and inventories


def stream_minimum(spark, d):
    """Whether a repo's stream reaches the floor of a stream and that of a target."""
    s = _files(spark, d).groupBy("repo").agg(F.sum("bytes").alias("bytes"))
    return s.select("repo", "bytes", (F.col("bytes") >= FULL_FLOOR).alias("full_ok"), (F.col("bytes") >= TARGET_FLOOR).alias("target_ok"))


def recorded_bytes(spark, d):
    """Files by whether their recorded size is that of the text."""
    f = table(spark, d, "source_files").where("text is not null").groupBy("file_id", "repo").agg(F.max("bytes").alias("recorded"), F.max(F.octet_length("text")).alias("actual"))
    state = F.when(F.col("recorded").isNull(), "unrecorded").when(F.col("recorded") == F.col("actual"), "match").otherwise("stale")
    return f.groupBy("repo", state.alias("state")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.abs(F.col("recorded") - F.col("actual")).cast("bigint")).alias("off_by"))


def optional_streams(spark, d):
    """Each corpus and stream kind: recorded cells, cells with rows, and whether all or none of them have rows."""
    seen = table(spark, d, "token_dump").select("cell_name").distinct().withColumn("has_rows", F.lit(True))
    m = table(spark, d, "cells_meta").select("cell_name", "corpus", "stream_kind").distinct().join(seen, "cell_name", "left")
    out = m.groupBy("corpus", "stream_kind").agg(F.count(F.lit(1)).alias("recorded"), F.count_if("has_rows").alias("present"))
    return out.withColumn("consistent", (F.col("present") == 0) | (F.col("present") == F.col("recorded")))


def lock_rule(spark, d):
    """A corpus without rows passes; one with rows must have a single revision and an accepted byte ledger in every cell."""
    seen = table(spark, d, "token_dump").select("cell_name").distinct().withColumn("has_rows", F.lit(True))
    m = table(spark, d, "cells_meta").join(seen, "cell_name", "left")
    per = m.groupBy("corpus").agg(F.coalesce(F.max("has_rows"), F.lit(False)).alias("present"), F.count_distinct("revision").alias("revisions"), F.count_if(F.coalesce(F.col("byte_ledger_ok"), F.lit(False))).alias("accepted"), F.count(F.lit(1)).alias("cells"))
    return per.withColumn("passes", ~F.col("present") | ((F.col("revisions") == 1) & (F.col("accepted") == F.col("cells"))))


def raw_inventory(spark, d):
    """Each cell's dump: rows, bytes, a digest of its rows whatever their order, and whether it is quarantined."""
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("win", "grp", "doc", "ctxb", "blen", "tok")])
    t = table(spark, d, "token_dump").select("cell_name", "blen", F.sha2(text, 256).alias("h"))
    sums = t.groupBy("cell_name").agg(F.count(F.lit(1)).alias("row_count"), F.sum("blen").cast("bigint").alias("bytes"))
    m = table(spark, d, "cells_meta").groupBy("cell_name").agg(F.coalesce(F.max(~F.col("byte_ledger_ok")), F.lit(True)).alias("quarantined"))
    return sums.join(selection.set_digest(t, ["cell_name"], "h"), "cell_name").join(m, "cell_name", "left")


def viability(spark, d):
    """Windows that a repo's stream makes, and per cutoff what masking would leave and whether it suffices."""
    cuts = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("date")) for k, v in CUTOFFS.items()]))
    later = F.col("date") > F.col("c.date")
    g = _files(spark, d).withColumn("c", cuts).groupBy("repo", F.col("c.name").alias("cutoff")).agg(F.sum("bytes").alias("total"), F.count_if(later).alias("docs"), F.coalesce(F.sum(F.when(later, F.col("bytes"))), F.lit(0)).alias("left"))
    return g.select("repo", "cutoff", F.round(F.col("total") / WINDOW_BYTES, 1).alias("est_windows"), "docs", F.round(F.col("left") / 1000).cast("bigint").alias("kbytes"), ((F.col("docs") >= MASK_DOCS) & (F.col("left") >= MASK_BYTES)).alias("ok"))


def collector_audit(spark, d):
    """Files by the first reason for which the collector of tracked sources passes over them."""
    parts = F.split("rel", "/")
    reason = A.skip_reason(parts, F.col("ext"), ROOTS, EXCLUDED, ENDINGS)
    return _files(spark, d).groupBy("repo", reason.alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def cell_done(spark, d):
    """Each cell of the grid with the first condition that it fails, or done."""
    t = table(spark, d, "token_dump").groupBy("cell_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("nll").isNull() | F.isnan("nll")).alias("bad"), F.count_if(F.col("grp").isNull()).alias("open"), F.count_if(F.col("blen") < 0).alias("negative")
    )
    m = table(spark, d, "cells_meta").groupBy("cell_name").agg(F.max("chunk_size").alias("chunk"), F.min("byte_ledger_ok").alias("ledger"), F.count(F.lit(1)).alias("records"))
    j = m.join(t, "cell_name", "left")
    rules = [("no-rows", F.col("n").isNull()), ("repeated-record", F.col("records") > 1), ("no-chunk", ~(F.coalesce("chunk", F.lit(0)) > 0)), ("negative-bytes", F.col("negative") > 0), ("scores-missing", F.col("bad") * 50 > F.col("n")), ("groups-missing", F.col("open") * 50 > F.col("n")), ("ledger-unknown", F.col("ledger").isNull()), ("ledger-refused", ~F.col("ledger"))]
    return j.select("cell_name", A.first_of(rules, "done").alias("state"))


# ---- identities and bindings


def _compact():
    return F.regexp_replace("identity", r'("(?:[^"\\]|\\.)*")|\s+', "$1")


def binding_ordinals(spark, d):
    """Python definitions of one name in a module by where they start; the last one is the final binding."""
    one = table(spark, d, "units").where("unit_id is not null").groupBy("unit_id").agg(F.min(F.struct(F.coalesce("repo", F.lit("")).alias("repo"), _compact().alias("i"))).alias("r"))
    parts = F.from_json("r.i", "array<string>")
    named = one.select("unit_id", "r.repo", parts.alias("p")).where("size(p) = 3").select("unit_id", "repo", F.col("p")[0].alias("module"), F.col("p")[1].alias("name"), F.col("p")[2].cast("bigint").alias("start"))
    return A.ordinals(named, ["repo", "module", "name"], ["start", "unit_id"]).select("unit_id", "ordinal", "bindings", "final")


def span_ids(spark, d):
    """Ids of the spans of Python definitions: sha256 of marker, module, source hash, start and end as compact JSON."""
    one = table(spark, d, "units").where("unit_id is not null and payload is not null").groupBy("unit_id").agg(F.min(F.struct(_compact().alias("i"), F.sha2("payload", 256).alias("h"), F.octet_length("payload").alias("n"))).alias("r"))
    parts = F.from_json("r.i", "array<string>")
    rows = one.select("unit_id", parts.alias("p"), "r.h", "r.n").where("size(p) = 3").withColumn("start", F.col("p")[2].cast("bigint"))
    return rows.select("unit_id", A.span_id("span:v1", F.col("p")[0], F.col("h"), F.col("start"), F.col("start") + F.col("n")).alias("span_id"))


def identity_coverage(spark, d):
    """Identities of units per repo: how many there are, how many stand for several units, how many units lack one."""
    u = table(spark, d, "units").where("unit_id is not null").select("unit_id", F.coalesce("repo", F.lit("")).alias("repo"), _compact().alias("i")).distinct()
    per = u.groupBy("repo", "i").agg(F.count_distinct("unit_id").alias("n"))
    return per.groupBy("repo").agg(F.count("i").alias("identities"), F.count_if(F.col("i").isNotNull() & (F.col("n") > 1)).alias("repeated"), F.coalesce(F.sum(F.when(F.col("i").isNull(), F.col("n"))), F.lit(0).cast("bigint")).alias("without"))


def identity_drift(spark, d):
    """Fields of declarations that differ between a run and the one before it."""
    names = ["repo", "module_name", "decl", "decl_kind", "parent_decl"]
    r = table(spark, d, "definition_parents").where("decl_id is not null and run_no is not null").groupBy("decl_id", "run_no").agg(F.max(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names])).alias("r"))
    return A.drift(r.select("decl_id", "run_no", "r.*"), "decl_id", "run_no", names).groupBy("field").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("decl_id").alias("decls"))


def span_revalidation(spark, d):
    """Units by whether their recorded size is that of the payload and their span begins within reason."""
    u = table(spark, d, "units").where("unit_id is not null and payload is not null").groupBy("unit_id").agg(F.max("payload_bytes").alias("recorded"), F.max(F.octet_length("payload")).alias("actual"), F.min(_compact()).alias("i"))
    start = F.get(F.from_json("i", "array<string>"), F.lit(2)).cast("bigint")
    rules = [("unrecorded", F.col("recorded").isNull()), ("negative-start", F.coalesce(start, F.lit(0)) < 0), ("too-long", F.col("recorded") > F.col("actual")), ("too-short", F.col("recorded") < F.col("actual"))]
    return u.groupBy(A.first_of(rules, "valid").alias("state")).agg(F.count(F.lit(1)).alias("units"))


def chain_binding(spark, d):
    """Orders by the first link of their chain that doesn't hold: target known, repo the same, list given, context hashed."""
    decls = declarations(table(spark, d, "definition_parents")).select(F.col("decl_id").alias("target_id"), F.col("repo").alias("t_repo"))
    o = table(spark, d, "assembly_orders").where("order_id is not null").groupBy("order_id").agg(F.max("target_id").alias("target_id"), F.max("repo").alias("repo"), F.max(F.size(F.coalesce("unit_order", F.array()))).alias("n"), F.max("context_sha256").alias("sha"))
    j = o.join(decls, "target_id", "left")
    rules = [("unknown-target", F.col("t_repo").isNull()), ("other-repo", ~F.col("repo").eqNullSafe(F.col("t_repo"))), ("no-list", F.col("n") == 0), ("no-hash", ~F.coalesce(F.col("sha").rlike("^[0-9a-f]{64}$"), F.lit(False)))]
    return j.groupBy(A.first_of(rules, "bound").alias("state")).agg(F.count(F.lit(1)).alias("orders"))


# ---- closures and resolutions


def _listed(spark, d):
    o = _orders(spark, d)
    return o.select("order_id", "target_id", F.explode("unit_order").alias("id")).where("id is not null").distinct()


def closure_match(spark, d):
    """Orders of targets in trees: units of the list that are ancestors of the target, ancestors that it lacks, units beyond."""
    tree = Scratch(spark).cut(_tree(spark, d, False)[1].select("id", "root", "tour", "enter", "exit", "depth"), "tree")
    o = _orders(spark, d).select("order_id", "target_id").join(tree.where("depth is not null").select(F.col("id").alias("target_id"), "depth"), "target_id")
    wanted = o.select("target_id").distinct().withColumnRenamed("target_id", "id")
    up = hierarchy.ancestors(tree, wanted).select(F.col("id").alias("target_id"), F.col("ancestor").alias("id"), F.lit(True).alias("above"))
    hit = _listed(spark, d).where("id <> target_id").join(up, ["target_id", "id"], "left").groupBy("order_id").agg(F.count(F.lit(1)).alias("listed"), F.count("above").alias("matched"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    j = o.join(hit, "order_id", "left").withColumns({"listed": zero("listed"), "matched": zero("matched")})
    return j.select("order_id", "matched", (F.col("depth") - F.col("matched")).cast("bigint").alias("missing"), (F.col("listed") - F.col("matched")).alias("beyond"))


def foreign_declarations(spark, d):
    """Parents that declarations name, by where they are defined: own module, one other module, several, none."""
    decls = Scratch(spark).cut(declarations(table(spark, d, "definition_parents")), "decls")
    names = decls.where("decl is not null").groupBy("repo", F.col("decl").alias("parent_decl")).agg(F.count_distinct("module_name").alias("modules"))
    j = decls.where("parent_decl is not null").join(names, ["repo", "parent_decl"], "left")
    rules = [("own", F.col("parent_id").isNotNull()), ("foreign", F.col("modules") == 1), ("several", F.col("modules") > 1)]
    return j.groupBy("repo", A.first_of(rules, "unknown").alias("defined")).agg(F.count(F.lit(1)).alias("decls"))


def external_resolution(spark, d):
    """Parents that declarations name, resolved in their module: direct, folded onto the longest dotted prefix, outside or unresolved."""
    decls = Scratch(spark).cut(declarations(table(spark, d, "definition_parents")), "decls").withColumn("scope", F.concat_ws("/", "repo", "module_name"))
    refs = decls.where("parent_decl is not null").select("scope", F.col("decl_id").alias("id"), F.col("parent_decl").alias("name"))
    known = decls.where("decl is not null").groupBy("scope", F.col("decl").alias("module")).agg(F.min("decl_id").alias("module_id"))
    folded = graph.prefix_resolve(refs, known).select(F.col("id").alias("decl_id"), "module_id")
    anywhere = decls.where("decl is not null").select("repo", F.col("decl").alias("parent_decl"), F.lit(True).alias("elsewhere")).distinct()
    j = decls.where("parent_decl is not null").join(folded, "decl_id").join(anywhere, ["repo", "parent_decl"], "left")
    rules = [("direct", F.col("parent_id").isNotNull()), ("folded", F.col("module_id").isNotNull()), ("outside", F.coalesce("elsewhere", F.lit(False)))]
    return j.select("decl_id", A.first_of(rules, "unresolved").alias("how"), F.coalesce("parent_id", "module_id").alias("resolved_id"))


def coverage_means(spark, d):
    """Per arm: mean share of the closure that is listed, over orders that know it, and the share of all together."""
    o = table(spark, d, "assembly_orders").where("order_id is not null")
    listed = F.size(F.array_distinct(F.filter(F.coalesce("unit_order", F.array()), lambda x: x.isNotNull())))
    one = o.groupBy("order_id").agg(F.max("arm").alias("arm"), F.max("n_closure_units").alias("closure"), F.max(listed).alias("listed")).where("closure > 0")
    share = F.round(F.col("listed") / F.col("closure"), 9).cast("decimal(28,9)")
    per = one.groupBy("arm").agg(F.count(F.lit(1)).alias("orders"), F.sum(share).cast("double").alias("s"), F.sum("listed").alias("l"), F.sum("closure").alias("c"))
    return per.select("arm", "orders", F.round(F.col("s") / F.col("orders"), 6).alias("mean_share"), F.round(F.col("l") / F.col("c"), 6).alias("share_of_sums"))


def renderability_totals(spark, d):
    """Per arm: mentions in the lists, different ids, ids that are declarations, nulls."""
    decls = table(spark, d, "definition_parents").where("decl_id is not null").select(F.col("decl_id").alias("id")).distinct().withColumn("known", F.lit(True))
    o = table(spark, d, "assembly_orders").where("order_id is not null").groupBy("order_id").agg(F.max("arm").alias("arm"), F.max("unit_order").alias("ids"))
    rows = o.select("order_id", "arm", F.explode("ids").alias("id")).join(decls, "id", "left")
    per = rows.groupBy("arm", "order_id").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("id").alias("u"), F.count_distinct(F.when(F.col("known"), F.col("id"))).alias("k"), F.count_if(F.col("id").isNull()).alias("z"))
    return per.groupBy("arm").agg(F.sum("m").alias("mentions"), F.sum("u").alias("units"), F.sum("k").alias("renderable"), F.sum("z").alias("nulls"))


def repo_n(spark, d):
    """The largest of the smallest sample sizes of all families, if every family has one."""
    s = smallest_n(spark, d).agg(F.count(F.lit(1)).alias("families"), F.count("chosen_n").alias("feasible"), F.max("chosen_n").alias("n"))
    return s.select("families", "feasible", F.when(F.col("families") == F.col("feasible"), F.col("n")).alias("repo_n"))


# ---- pairs


def pair_bounds(spark, d):
    """Pairs of units that are alike whose counts can't be: none."""
    sets = _sized(spark, d)
    p = _jaccard(spark, d)
    j = p.join(sets.select(F.col("unit_id").alias("a"), F.col("n").alias("na")), "a").join(sets.select(F.col("unit_id").alias("b"), F.col("n").alias("nb")), "b")
    bad = (F.col("n_inter") > F.least("na", "nb")) | (F.col("n_inter") + F.col("n_union") != F.col("na") + F.col("nb")) | (F.col("a") >= F.col("b")) | ~similarity.meets(F.col("n_inter"), F.col("n_union"))
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(bad).alias("violations"), F.sum("n_inter").alias("inter"), F.sum(F.col("na") + F.col("nb")).cast("bigint").alias("sizes"))


def _sized(spark, d):
    from tessella.plans.similarity import _sets

    return _sets(spark, d).select("unit_id", F.size("g").alias("n"))


def _hidden(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of units with the role in which they were chosen."""
    u = Scratch(spark).cut(_hashed(spark, d), "units")
    twins = similarity.member_pair(u, similarity.collisions(u, [], "norm", "verb"), [], "norm", "verb", "unit_id", selection.priority("member:v1", "norm", "unit_id"))
    alike = _jaccard(spark, d).select("a", "b", similarity.ratio_bin(F.col("n_inter"), F.col("n_union")).alias("role"))
    return alike.unionByName(twins.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), F.lit("collision").alias("role")))


def blind_pairs(spark, d):
    """Each pair once under an opaque id, its sides swapped and its place given by hashes that don't tell the role."""
    return A.blind(_hidden(spark, d), "a", "b", "role", "blind:v1").select("pair_id", "left_id", "right_id", "place", "n_roles")


def blind_roles(spark, d):
    """The hidden roles of each opaque pair; a pair may serve several."""
    h = _hidden(spark, d)
    return A.blind(h, "a", "b", "role", "blind:v1").select("pair_id", F.explode("roles").alias("role"))


_NAMES = """context_bytes phase_snap causality_partition perturbed_tokens delta_profile duplicate_control order_ablation_sets model_class body_ledger group_windows stream_minimum recorded_bytes optional_streams lock_rule raw_inventory
viability collector_audit cell_done binding_ordinals span_ids identity_coverage identity_drift span_revalidation chain_binding closure_match foreign_declarations external_resolution coverage_means
renderability_totals repo_n pair_bounds blind_pairs blind_roles""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_TOK = f"{_G}, tk AS (SELECT *, row_number() OVER (PARTITION BY cell_name, win ORDER BY ctxb, grp, tok, blen, nll, doc) - 1 AS j, count(*) OVER (PARTITION BY cell_name, win) AS n FROM d)"
_ID = r"""regexp_replace(identity, '("(?:[^"\\]|\\.)*")|\s+', '\1', 'g')"""
_PY = f"""py AS (SELECT unit_id, min({{'r': coalesce(repo, ''), 'i': {_ID}}}) AS r FROM units WHERE unit_id IS NOT NULL GROUP BY unit_id),
  pd AS (SELECT unit_id, r.r AS repo, json_extract_string(r.i, '$[0]') AS module, json_extract_string(r.i, '$[1]') AS name, cast(json_extract_string(r.i, '$[2]') AS BIGINT) AS start FROM py WHERE json_array_length(r.i) = 3)"""
_SEEN = "sn AS (SELECT DISTINCT cell_name, true AS has_rows FROM token_dump)"
_HID = f"""{_SETS}, {_COL}, mr AS (SELECT h.*, sha256('member:v1:' || h.norm || ':' || unit_id) AS hh FROM h JOIN co ON h.norm = co.norm), mf AS (SELECT norm, min({{'h': hh, 'k': unit_id, 'v': verb}}) AS f FROM mr GROUP BY norm),
  tw AS (SELECT mf.f.k AS l, min({{'h': hh, 'k': unit_id}}).k AS r FROM mr JOIN mf ON mr.norm = mf.norm WHERE mr.verb <> mf.f.v GROUP BY mr.norm, mf.f.k),
  hp AS (SELECT a, b, bin AS role FROM j UNION ALL SELECT least(l, r), greatest(l, r), 'collision' FROM tw),
  bp AS (SELECT a, b, sha256('blind:v1:pair:' || a || ':' || b) AS pair_id, list_sort(list_distinct(list(role))) AS roles FROM hp GROUP BY a, b),
  bs AS (SELECT *, cast('0x' || right(sha256('blind:v1:side:' || pair_id), 1) AS INT) % 2 = 1 AS sw FROM bp)"""
_NEXT = ", ".join(f"h{i + 1} AS (SELECT cell_name, substr(p, 1, {n}) AS p, sha256(string_agg(h, '' ORDER BY p, h)) AS h FROM h{i} GROUP BY cell_name, substr(p, 1, {n}))" for i, n in enumerate(selection.DIGEST_LEVELS))
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)

ORACLE = {
    "context_bytes": f"""WITH {_G}, c AS (SELECT *, cast(coalesce(sum(blen) OVER (PARTITION BY cell_name, win ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS recomputed, min(ctxb) OVER (PARTITION BY cell_name, win) AS z FROM g)
      SELECT cell_name, win, grp, ctxb, recomputed, ctxb - z = recomputed AS same FROM c""",
    "phase_snap": f"""WITH {_G}, s AS (SELECT cell_name, cast(sum(n_tokens) OVER (PARTITION BY cell_name ORDER BY win, grp ROWS UNBOUNDED PRECEDING) - n_tokens AS BIGINT) AS start, sum(n_tokens) OVER (PARTITION BY cell_name) AS n FROM g),
      p(phase) AS (VALUES {", ".join(f"(cast({p} AS BIGINT))" for p in PHASES)}) SELECT cell_name, phase, cast(CASE WHEN phase >= max(n) THEN phase ELSE coalesce(min(start) FILTER (WHERE start >= phase), max(n)) END AS BIGINT) AS snapped FROM s, p GROUP BY cell_name, phase""",
    "causality_partition": f"WITH {_TOK} SELECT cell_name, win, CASE WHEN j < n // 2 - 1 THEN 'protected' WHEN j = n // 2 - 1 THEN 'excluded' ELSE 'downstream' END AS cls, count(*) AS row_count, cast(sum(blen) AS BIGINT) AS bytes FROM tk WHERE n > 1 GROUP BY 1, 2, 3",
    "perturbed_tokens": f"WITH {_G} SELECT DISTINCT tok, cast((tok + 1) % {VOCABULARY} AS INT) AS changed FROM d",
    "delta_profile": f"WITH {_PHASES} SELECT win, grp, round(nll_0 - nll_p, 8) AS signed, abs(round(nll_0 - nll_p, 8)) AS absolute FROM j",
    "duplicate_control": f"""WITH {_G}, w AS (SELECT cell_name, win, sum(cast(nll AS DECIMAL(28,8))) AS nll, sum(blen) AS bytes FROM g GROUP BY cell_name, win),
      p AS (SELECT *, (row_number() OVER (PARTITION BY cell_name ORDER BY win) - 1) * {COPIES} // count(*) OVER (PARTITION BY cell_name) AS part FROM w)
      SELECT cell_name, cast(part AS BIGINT) AS part, count(*) AS windows, cast(sum(bytes) AS BIGINT) AS bytes, round(cast(sum(nll) AS DOUBLE) / ln(2) / sum(bytes), 6) AS bpb FROM p GROUP BY cell_name, part HAVING sum(bytes) > 0""",
    "order_ablation_sets": """WITH m AS (SELECT DISTINCT cell_name, model_name, corpus, stream_kind FROM cells_meta WHERE stream_kind IN ('full_topo', 'full_shuffled')),
      x AS (SELECT model_name, corpus, doc, bool_or(stream_kind = 'full_topo') AS t, bool_or(stream_kind = 'full_shuffled') AS s FROM token_dump JOIN m USING (cell_name) WHERE doc >= 0 GROUP BY ALL),
      o AS (SELECT model_name, corpus, count(*) AS docs, count(*) FILTER (WHERE t AND NOT s) AS only_topo, count(*) FILTER (WHERE s AND NOT t) AS only_shuffled FROM x GROUP BY ALL) SELECT *, only_topo = 0 AND only_shuffled = 0 AS equal FROM o""",
    "model_class": f"""WITH {_SRC}, oc AS (SELECT cell_name, win, grp, count(DISTINCT cls) FILTER (WHERE cls IN ('word', 'literal', 'symbol')) AS n, max(cls) FILTER (WHERE cls IN ('word', 'literal', 'symbol')) AS c, bool_or(cls = 'comment') AS k, bool_or(cls = 'layout') AS l FROM ov WHERE bytes > 0 GROUP BY cell_name, win, grp)
      SELECT cell_name, win, grp, CASE WHEN n = 1 THEN c WHEN n > 1 THEN 'mixed_core' WHEN k AND l THEN 'comment_layout' WHEN k THEN 'comment' ELSE 'layout' END AS class FROM oc""",
    "body_ledger": f"""WITH {_G}, b AS (SELECT cell_name, win, ctxb AS s, ctxb + blen AS e, blen, (min(ctxb) OVER w + max(ctxb + blen) OVER w) // 2 AS body FROM g WINDOW w AS (PARTITION BY cell_name, win))
      SELECT cell_name, win, count(*) FILTER (WHERE e <= body) AS before, count(*) FILTER (WHERE e > body AND s >= body) AS inside, count(*) FILTER (WHERE e > body AND s < body) AS across, cast(sum(greatest(least(e, body) - s, 0)) AS BIGINT) AS prefix_bytes,
        cast(sum(blen) - sum(greatest(least(e, body) - s, 0)) AS BIGINT) AS body_bytes FROM b GROUP BY cell_name, win""",
    "group_windows": f"""WITH RECURSIVE {_G}, st AS (SELECT cell_name, cast(sum(n_tokens) OVER w - n_tokens AS BIGINT) AS o, cast(sum(n_tokens) OVER (PARTITION BY cell_name) AS BIGINT) AS n FROM g WINDOW w AS (PARTITION BY cell_name ORDER BY win, grp ROWS UNBOUNDED PRECEDING)),
      nx AS (SELECT a.cell_name, a.o AS ws, a.n, coalesce(max(b.o) FILTER (WHERE b.o <= a.o + {WINDOW_TOKENS}), min(b.o), a.n) AS nw FROM st a LEFT JOIN st b ON a.cell_name = b.cell_name AND b.o > a.o GROUP BY a.cell_name, a.o, a.n),
      go AS (SELECT cell_name, ws, CASE WHEN n - ws <= {WINDOW_TOKENS} THEN n ELSE nw END AS we FROM nx), r AS (SELECT * FROM go WHERE ws = 0 UNION ALL SELECT go.* FROM r JOIN go ON go.cell_name = r.cell_name AND go.ws = r.we)
      SELECT cell_name, ws AS win_start, we AS win_end FROM r""",
    "stream_minimum": f"WITH {_F} SELECT repo, cast(sum(bytes) AS BIGINT) AS bytes, sum(bytes) >= {FULL_FLOOR} AS full_ok, sum(bytes) >= {TARGET_FLOOR} AS target_ok FROM f GROUP BY repo",
    "recorded_bytes": """WITH x AS (SELECT file_id, repo, max(bytes) AS r, max(octet_length(encode(text))) AS a FROM source_files WHERE text IS NOT NULL GROUP BY file_id, repo)
      SELECT repo, CASE WHEN r IS NULL THEN 'unrecorded' WHEN r = a THEN 'match' ELSE 'stale' END AS state, count(*) AS files, cast(sum(abs(r - a)) AS BIGINT) AS off_by FROM x GROUP BY 1, 2""",
    "optional_streams": f"""WITH {_SEEN}, m AS (SELECT DISTINCT cell_name, corpus, stream_kind FROM cells_meta), o AS (SELECT corpus, stream_kind, count(*) AS recorded, count(*) FILTER (WHERE has_rows) AS present FROM m LEFT JOIN sn USING (cell_name) GROUP BY ALL)
      SELECT *, present = 0 OR present = recorded AS consistent FROM o""",
    "lock_rule": f"""WITH {_SEEN}, o AS (SELECT corpus, coalesce(bool_or(has_rows), false) AS present, count(DISTINCT revision) AS revisions, count(*) FILTER (WHERE coalesce(byte_ledger_ok, false)) AS accepted, count(*) AS cells FROM cells_meta LEFT JOIN sn USING (cell_name) GROUP BY corpus)
      SELECT *, NOT present OR (revisions = 1 AND accepted = cells) AS passes FROM o""",
    "raw_inventory": f"""WITH h0 AS (SELECT cell_name, blen, sha256(concat_ws(',', win, coalesce(cast(grp AS VARCHAR), ''), coalesce(cast(doc AS VARCHAR), ''), coalesce(cast(ctxb AS VARCHAR), ''), coalesce(cast(blen AS VARCHAR), ''), coalesce(cast(tok AS VARCHAR), ''))) AS h,
      sha256(concat_ws(',', win, coalesce(cast(grp AS VARCHAR), ''), coalesce(cast(doc AS VARCHAR), ''), coalesce(cast(ctxb AS VARCHAR), ''), coalesce(cast(blen AS VARCHAR), ''), coalesce(cast(tok AS VARCHAR), ''))) AS p FROM token_dump), {_NEXT},
      s AS (SELECT cell_name, count(*) AS row_count, cast(sum(blen) AS BIGINT) AS bytes FROM h0 GROUP BY cell_name), m AS (SELECT cell_name, coalesce(bool_or(NOT byte_ledger_ok), true) AS quarantined FROM cells_meta GROUP BY cell_name)
      SELECT cell_name, row_count, bytes, h AS digest, quarantined FROM s JOIN h{len(selection.DIGEST_LEVELS)} USING (cell_name) LEFT JOIN m USING (cell_name)""",
    "viability": f"""WITH {_F}, c(cutoff, cd) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in CUTOFFS.items())}), g AS (SELECT repo, cutoff, sum(bytes) AS total, count(*) FILTER (WHERE date > cd) AS docs, coalesce(sum(bytes) FILTER (WHERE date > cd), 0) AS lft FROM f, c GROUP BY repo, cutoff)
      SELECT repo, cutoff, round(total / {WINDOW_BYTES}::DOUBLE, 1) AS est_windows, docs, cast(round(lft / 1000::DOUBLE) AS BIGINT) AS kbytes, docs >= {MASK_DOCS} AND lft >= {MASK_BYTES} AS ok FROM g""",
    "collector_audit": f"""WITH {_F}, p AS (SELECT *, string_split(rel, '/') AS parts FROM f) SELECT repo, CASE WHEN NOT (len(parts) > 1 AND parts[1] IN ({_IN(ROOTS)})) THEN 'outside' WHEN list_has_any(list_slice(parts, 2, len(parts) - 1), [{_IN(EXCLUDED)}]) THEN 'excluded'
      WHEN ext NOT IN ({_IN(ENDINGS)}) THEN 'ending' ELSE 'admitted' END AS reason, count(*) AS files, cast(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY 1, 2""",
    "cell_done": """WITH t AS (SELECT cell_name, count(*) AS n, count(*) FILTER (WHERE nll IS NULL OR isnan(nll)) AS bad, count(*) FILTER (WHERE grp IS NULL) AS opn, count(*) FILTER (WHERE blen < 0) AS neg FROM token_dump GROUP BY cell_name),
      m AS (SELECT cell_name, max(chunk_size) AS chunk, bool_and(byte_ledger_ok) AS ledger, count(*) AS records FROM cells_meta GROUP BY cell_name)
      SELECT cell_name, CASE WHEN n IS NULL THEN 'no-rows' WHEN records > 1 THEN 'repeated-record' WHEN NOT coalesce(chunk, 0) > 0 THEN 'no-chunk' WHEN neg > 0 THEN 'negative-bytes' WHEN bad * 50 > n THEN 'scores-missing' WHEN opn * 50 > n THEN 'groups-missing'
        WHEN ledger IS NULL THEN 'ledger-unknown' WHEN NOT ledger THEN 'ledger-refused' ELSE 'done' END AS state FROM m LEFT JOIN t USING (cell_name)""",
    "binding_ordinals": f"WITH {_PY}, o AS (SELECT unit_id, row_number() OVER w - 1 AS ordinal, count(*) OVER (PARTITION BY repo, module, name) AS bindings FROM pd WINDOW w AS (PARTITION BY repo, module, name ORDER BY start, unit_id)) SELECT unit_id, cast(ordinal AS INT) AS ordinal, bindings, ordinal = bindings - 1 AS final FROM o",
    "span_ids": f"""WITH x AS (SELECT unit_id, min({{'i': {_ID}, 'h': sha256(payload), 'n': octet_length(encode(payload))}}) AS r FROM units WHERE unit_id IS NOT NULL AND payload IS NOT NULL GROUP BY unit_id),
      y AS (SELECT unit_id, json_extract_string(r.i, '$[0]') AS m, r.h AS h, r.n AS n, cast(json_extract_string(r.i, '$[2]') AS BIGINT) AS s FROM x WHERE json_array_length(r.i) = 3)
      SELECT unit_id, sha256('["span:v1",' || to_json(m) || ',"' || h || '",' || s || ',' || (s + n) || ']') AS span_id FROM y""",
    "identity_coverage": f"""WITH u AS (SELECT DISTINCT unit_id, coalesce(repo, '') AS repo, {_ID} AS i FROM units WHERE unit_id IS NOT NULL), p AS (SELECT repo, i, count(DISTINCT unit_id) AS n FROM u GROUP BY repo, i)
      SELECT repo, count(i) AS identities, count(*) FILTER (WHERE i IS NOT NULL AND n > 1) AS repeated, cast(coalesce(sum(n) FILTER (WHERE i IS NULL), 0) AS BIGINT) AS "without" FROM p GROUP BY repo""",
    "identity_drift": f"""WITH r AS (SELECT decl_id, run_no, max({{{", ".join(f"'{c}': coalesce({c}, '')" for c in ("repo", "module_name", "decl", "decl_kind", "parent_decl"))}}}) AS r FROM definition_parents WHERE decl_id IS NOT NULL AND run_no IS NOT NULL GROUP BY decl_id, run_no),
      l AS (SELECT *, lag(r) OVER (PARTITION BY decl_id ORDER BY run_no) AS p FROM r), f AS ({" UNION ALL ".join(f"SELECT decl_id, '{c}' AS field FROM l WHERE p IS NOT NULL AND p.{c} <> r.{c}" for c in ("repo", "module_name", "decl", "decl_kind", "parent_decl"))})
      SELECT field, count(*) AS changes, count(DISTINCT decl_id) AS decls FROM f GROUP BY field""",
    "span_revalidation": f"""WITH u AS (SELECT unit_id, max(payload_bytes) AS r, max(octet_length(encode(payload))) AS a, min({_ID}) AS i FROM units WHERE unit_id IS NOT NULL AND payload IS NOT NULL GROUP BY unit_id)
      SELECT CASE WHEN r IS NULL THEN 'unrecorded' WHEN coalesce(cast(json_extract_string(i, '$[2]') AS BIGINT), 0) < 0 THEN 'negative-start' WHEN r > a THEN 'too-long' WHEN r < a THEN 'too-short' ELSE 'valid' END AS state, count(*) AS units FROM u GROUP BY 1""",
    "chain_binding": f"""WITH RECURSIVE {_DECLS}, o AS (SELECT order_id, max(target_id) AS target_id, max(repo) AS repo, max(len(coalesce(unit_order, []))) AS n, max(context_sha256) AS sha FROM assembly_orders WHERE order_id IS NOT NULL GROUP BY order_id)
      SELECT CASE WHEN l.repo IS NULL THEN 'unknown-target' WHEN o.repo IS DISTINCT FROM l.repo THEN 'other-repo' WHEN n = 0 THEN 'no-list' WHEN NOT coalesce(regexp_full_match(sha, '[0-9a-f]{{64}}'), false) THEN 'no-hash' ELSE 'bound' END AS state, count(*) AS orders FROM o LEFT JOIN last l ON l.decl_id = o.target_id GROUP BY 1""",
    "closure_match": f"""WITH RECURSIVE {_DECLS}, o AS (SELECT ords.order_id, target_id FROM ords JOIN roots r ON r.id = ords.target_id WHERE r.root <> -1), li AS (SELECT o.order_id, i.id, a.anc IS NOT NULL AS above FROM o JOIN items i ON i.order_id = o.order_id AND i.id IS NOT NULL AND i.id <> o.target_id LEFT JOIN anc a ON a.id = o.target_id AND a.anc = i.id)
      SELECT o.order_id, count(*) FILTER (WHERE above) AS matched, cast((SELECT count(*) FROM anc a WHERE a.id = o.target_id) - count(*) FILTER (WHERE above) AS BIGINT) AS missing, count(*) FILTER (WHERE NOT above) AS beyond FROM o LEFT JOIN li ON li.order_id = o.order_id GROUP BY o.order_id, o.target_id""",
    "foreign_declarations": f"""WITH RECURSIVE {_DECLS}, nm AS (SELECT repo, decl, count(DISTINCT module_name) AS m FROM last WHERE decl IS NOT NULL GROUP BY repo, decl)
      SELECT l.repo, CASE WHEN k.parent IS NOT NULL THEN 'own' WHEN m = 1 THEN 'foreign' WHEN m > 1 THEN 'several' ELSE 'unknown' END AS defined, count(*) AS decls FROM last l JOIN links k ON k.id = l.decl_id LEFT JOIN nm ON nm.repo = l.repo AND nm.decl = l.parent_decl WHERE l.parent_decl IS NOT NULL GROUP BY 1, 2""",
    "external_resolution": f"""WITH RECURSIVE {_DECLS}, kn AS (SELECT repo, module_name, decl, min(decl_id) AS id FROM last WHERE decl IS NOT NULL GROUP BY ALL), rf AS (SELECT *, string_split(parent_decl, '.') AS ps, unnest(range(1, len(string_split(parent_decl, '.')) + 1)) AS k FROM last WHERE parent_decl IS NOT NULL),
      ft AS (SELECT rf.decl_id, arg_max(kn.id, k) AS m FROM rf JOIN kn ON kn.repo = rf.repo AND kn.module_name = rf.module_name AND kn.decl = array_to_string(list_slice(ps, 1, k), '.') GROUP BY rf.decl_id),
      aw AS (SELECT DISTINCT repo, decl FROM last WHERE decl IS NOT NULL)
      SELECT l.decl_id, CASE WHEN k.parent IS NOT NULL THEN 'direct' WHEN ft.m IS NOT NULL THEN 'folded' WHEN aw.decl IS NOT NULL THEN 'outside' ELSE 'unresolved' END AS how, coalesce(k.parent, ft.m) AS resolved_id
      FROM last l JOIN links k ON k.id = l.decl_id LEFT JOIN ft ON ft.decl_id = l.decl_id LEFT JOIN aw ON aw.repo = l.repo AND aw.decl = l.parent_decl WHERE l.parent_decl IS NOT NULL""",
    "coverage_means": """WITH o AS (SELECT order_id, max(arm) AS arm, max(n_closure_units) AS c, max(len(list_distinct(coalesce(unit_order, [])))) AS l FROM assembly_orders WHERE order_id IS NOT NULL GROUP BY order_id)
      SELECT arm, count(*) AS orders, round(cast(sum(cast(round(l / c::DOUBLE, 9) AS DECIMAL(28,9))) AS DOUBLE) / count(*), 6) AS mean_share, round(sum(l) / sum(c)::DOUBLE, 6) AS share_of_sums FROM o WHERE c > 0 GROUP BY arm""",
    "renderability_totals": """WITH o AS (SELECT order_id, max(arm) AS arm, max(unit_order) AS ids FROM assembly_orders WHERE order_id IS NOT NULL GROUP BY order_id), i AS (SELECT order_id, arm, unnest(ids) AS id FROM o),
      p AS (SELECT arm, order_id, count(*) AS m, count(DISTINCT id) AS u, count(DISTINCT CASE WHEN id IN (SELECT decl_id FROM definition_parents WHERE decl_id IS NOT NULL) THEN id END) AS k, count(*) FILTER (WHERE id IS NULL) AS z FROM i GROUP BY arm, order_id)
      SELECT arm, cast(sum(m) AS BIGINT) AS mentions, cast(sum(u) AS BIGINT) AS units, cast(sum(k) AS BIGINT) AS renderable, cast(sum(z) AS BIGINT) AS nulls FROM p GROUP BY arm""",
    "repo_n": f"SELECT count(*) AS families, count(chosen_n) AS feasible, CASE WHEN count(*) = count(chosen_n) THEN max(chosen_n) END AS repo_n FROM ({_GOVERNANCE['smallest_n']})",
    "pair_bounds": f"""WITH {_SETS}, q AS (SELECT j.*, x.n AS na, y.n AS nb FROM j JOIN rp x ON x.unit_id = j.a JOIN rp y ON y.unit_id = j.b)
      SELECT count(*) AS pairs, count(*) FILTER (WHERE n_inter > least(na, nb) OR n_inter + n_union <> na + nb OR a >= b OR 10 * n_inter < 7 * n_union) AS violations, cast(sum(n_inter) AS BIGINT) AS "inter", cast(sum(na + nb) AS BIGINT) AS sizes FROM q""",
    "blind_pairs": f"WITH {_HID} SELECT pair_id, CASE WHEN sw THEN b ELSE a END AS left_id, CASE WHEN sw THEN a ELSE b END AS right_id, sha256('blind:v1:order:' || pair_id) AS place, cast(len(roles) AS INT) AS n_roles FROM bs",
    "blind_roles": f"WITH {_HID} SELECT pair_id, unnest(roles) AS role FROM bs",
}
