"""Queries of imports, closures, components and orders over source_files, definition_parents and assembly_orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.plans.hierarchy import _DECLS, declarations
from tessella.plans.selection import _F, _files
from tessella.scratch import Scratch
from tessella.sources.tables import table


def _imports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = _files(spark, d, names=G.imports_of("text", "ext")).select("file_id", "repo", "rel", "ext", "names")
    # a module is named from any folder of its path on, so that short imports can meet it
    tail = F.expr("transform(sequence(1, size(split(m, '[.]'))), k -> array_join(slice(split(m, '[.]'), k, size(split(m, '[.]'))), '.'))")
    modules = f.withColumn("m", G.module_of("rel")).select(F.col("repo").alias("scope"), F.explode(tail).alias("module"), "file_id").groupBy("scope", "module").agg(F.min("file_id").alias("module_id"))
    imports = f.select(F.col("repo").alias("scope"), F.col("file_id").alias("id"), F.explode("names").alias("name"))
    return imports, modules


def import_edges(spark, d):
    """Each import with the file it resolves to by its longest prefix, null for none."""
    imports, modules = _imports(spark, d)
    r = G.prefix_resolve(imports, modules)
    return r.select(F.col("scope").alias("repo"), F.col("id").alias("file_id"), "name", F.when(F.col("module_id") != F.col("id"), F.col("module_id")).alias("resolved_id"))


def import_in_degree(spark, d):
    """Number of files that import a name, resolved or not."""
    imports, _ = _imports(spark, d)
    return imports.groupBy(F.col("scope").alias("repo"), "name").agg(F.count_distinct("id").alias("importers"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Declaration to parent."""
    decls = Scratch(spark).cut(declarations(table(spark, d, "definition_parents")).select("decl_id", "repo", "module_name", "parent_id", "decl_kind"), "decls")
    return decls


def _links(decls: DataFrame) -> DataFrame:
    return decls.where("parent_id is not null").select(F.col("decl_id").alias("src"), F.col("parent_id").alias("dst"))


def transitive_closure(spark, d):
    return G.reachable(_links(_edges(spark, d))).select("src", "dst")


def reverse_closure(spark, d):
    """Number of dependents of each declaration."""
    back = G.reachable(_links(_edges(spark, d)).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return back.groupBy("src").agg(F.count(F.lit(1)).alias("dependents"), F.max("dist").alias("farthest"))


def bfs_distance(spark, d):
    return G.reachable(_links(_edges(spark, d)))


def closure_counts(spark, d):
    """Direct and transitive dependencies of each declaration, and those of the same kind."""
    decls = _edges(spark, d)
    reach = G.reachable(_links(decls))
    return reach.groupBy(F.col("src").alias("decl_id")).agg(F.count_if(F.col("dist") == 1).alias("n_direct"), F.count(F.lit(1)).alias("n_transitive"), F.count_if(F.col("src") == F.col("dst")).alias("n_self"))


def parent_fold(spark, d):
    """Declarations folded onto the nearest structure or inductive type on their parent chain, within 8 hops."""
    decls = _edges(spark, d)
    refs = decls.select(F.col("decl_id").alias("node"))
    return G.fold_parents(refs, decls.select(F.col("decl_id").alias("node"), F.col("parent_id").alias("parent")), decls.where("decl_kind in ('structure', 'inductive')").select(F.col("decl_id").alias("node")))


def scc_components(spark, d):
    return G.components(_links(_edges(spark, d)))


def topo_order(spark, d):
    """Order of the declarations of each module, parents first; members of cycles and below last."""
    decls = _edges(spark, d).withColumn("module", F.concat_ws("/", "repo", "module_name"))
    e = decls.where("parent_id is not null").select("module", F.col("parent_id").alias("src"), F.col("decl_id").alias("dst"))
    return G.topo_order(decls.select("module", F.col("decl_id").alias("node")), e, "module")


def topo_violations(spark, d):
    """Edges whose ends stand in the wrong order although neither is cyclic: none."""
    order = Scratch(spark).cut(topo_order(spark, d), "order")
    e = _links(_edges(spark, d))
    a = order.select(F.col("node").alias("src"), F.col("position").alias("pa"), F.col("cyclic").alias("ca"))
    b = order.select(F.col("node").alias("dst"), F.col("position").alias("pb"), F.col("cyclic").alias("cb"))
    return e.join(a, "src").join(b, "dst").agg(F.count(F.lit(1)).alias("edges"), F.count_if(~F.col("ca") & ~F.col("cb") & (F.col("pa") < F.col("pb"))).alias("violations"))


def canonical_dependency_order(spark, d):
    """The closure of each target of assembly_orders in canonical order."""
    pairs = table(spark, d, "assembly_orders").select(F.col("repo").alias("scope"), F.col("target_id").alias("target")).distinct()
    return G.dependency_orders(pairs, _links(_edges(spark, d)), "order:v1")


def definition_site_waterfall(spark, d):
    """Where the definition of a declaration stands: explicit parent, unique name prefix, or nowhere."""
    decls = Scratch(spark).cut(declarations(table(spark, d, "definition_parents")), "sites")
    prefix = F.when(F.col("decl").contains("."), F.regexp_replace("decl", r"\.[^.]*$", ""))
    owners = decls.groupBy("repo", "module_name", F.col("decl").alias("prefix")).agg(F.count(F.lit(1)).alias("owners"))
    rows = decls.withColumn("prefix", prefix).join(owners, ["repo", "module_name", "prefix"], "left")
    site = F.when(F.col("parent_id").isNotNull(), "explicit").when(F.col("owners") == 1, "prefix").when(F.col("owners") > 1, "ambiguous").when(F.col("parent_decl").isNotNull(), "dangling").otherwise("own")
    return rows.groupBy("repo", site.alias("site")).agg(F.count(F.lit(1)).alias("decls"))


_NAMES = """import_edges import_in_degree transitive_closure reverse_closure bfs_distance closure_counts parent_fold scc_components topo_order topo_violations canonical_dependency_order
definition_site_waterfall""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_I = f"""{_F}, im AS (SELECT DISTINCT repo, file_id, unnest(CASE ext WHEN 'lean' THEN regexp_extract_all(text, '(?m)^import\\s+(?:all\\s+)?([\\w.«»'']+)', 1)
  WHEN 'py' THEN regexp_extract_all(text, '(?m)^(?:from|import)\\s+([\\w.]+)', 1) WHEN 'cc' THEN regexp_extract_all(text, '(?m)^#include\\s+"([^"]+)"', 1) ELSE [] END) AS name FROM f),
  mo AS (SELECT repo, file_id, regexp_replace(replace(regexp_replace(rel, '\\.[A-Za-z0-9]+$', ''), '/', '.'), '\\.__init__$', '') AS m FROM f),
  mk AS (SELECT *, unnest(range(1, len(string_split(m, '.')) + 1)) AS k FROM mo), mt AS (SELECT repo, array_to_string(list_slice(string_split(m, '.'), k, len(string_split(m, '.'))), '.') AS module, min(file_id) AS module_id FROM mk GROUP BY 1, 2),
  pk AS (SELECT *, unnest(range(1, len(string_split(name, '.')) + 1)) AS k FROM im), pr AS (SELECT repo, file_id, name, k, array_to_string(list_slice(string_split(name, '.'), 1, k), '.') AS module FROM pk),
  hit AS (SELECT pr.repo, pr.file_id, pr.name, arg_max(module_id, k) AS module_id FROM pr JOIN mt ON pr.repo = mt.repo AND pr.module = mt.module GROUP BY 1, 2, 3)"""
_BFS = f"""{_DECLS}, bfs AS (SELECT id AS src, parent AS dst, 1 AS dist FROM links WHERE parent IS NOT NULL UNION SELECT b.src, l.parent, b.dist + 1 FROM bfs b JOIN links l ON b.dst = l.id
  WHERE l.parent IS NOT NULL AND b.dist < (SELECT max(n) FROM (SELECT count(*) AS n FROM last GROUP BY repo, module_name))), best AS (SELECT src, dst, min(dist) AS dist FROM bfs GROUP BY src, dst)"""

ORACLE = {
    "import_edges": f"WITH {_I} SELECT im.repo, im.file_id, im.name, CASE WHEN module_id <> im.file_id THEN module_id END AS resolved_id FROM im LEFT JOIN hit ON im.repo = hit.repo AND im.file_id = hit.file_id AND im.name = hit.name",
    "import_in_degree": f"WITH {_I} SELECT repo, name, count(DISTINCT file_id) AS importers FROM im GROUP BY repo, name",
    "transitive_closure": f"WITH RECURSIVE {_DECLS} SELECT id AS src, anc AS dst FROM anc",
    "reverse_closure": f"WITH RECURSIVE {_BFS} SELECT dst AS src, count(*) AS dependents, max(dist) AS farthest FROM best GROUP BY dst",
    "bfs_distance": f"WITH RECURSIVE {_BFS} SELECT src, dst, dist FROM best",
    "closure_counts": f"WITH RECURSIVE {_BFS} SELECT src AS decl_id, count(*) FILTER (WHERE dist = 1) AS n_direct, count(*) AS n_transitive, count(*) FILTER (WHERE src = dst) AS n_self FROM best GROUP BY src",
    "parent_fold": f"""WITH RECURSIVE {_DECLS}, kn AS (SELECT decl_id AS id, coalesce(decl_kind IN ('structure', 'inductive'), false) AS k FROM last), ch AS (SELECT links.id AS node, links.id AS at_id, k, 0 AS used FROM links JOIN kn ON kn.id = links.id
      UNION ALL SELECT ch.node, l.parent, kn.k, ch.used + 1 FROM ch JOIN links l ON l.id = ch.at_id JOIN kn ON kn.id = l.parent WHERE NOT ch.k AND l.parent IS NOT NULL AND ch.used < 8)
      SELECT l.id AS node, ch.at_id AS resolved, ch.used FROM links l LEFT JOIN ch ON ch.node = l.id AND ch.k""",
    "scc_components": f"""WITH RECURSIVE {_DECLS}, nd AS (SELECT id FROM links WHERE parent IS NOT NULL UNION SELECT parent FROM links WHERE parent IS NOT NULL)
      SELECT nd.id AS node, least(nd.id, coalesce((SELECT min(a.anc) FROM anc a JOIN anc b ON a.id = nd.id AND b.id = a.anc AND b.anc = nd.id), nd.id)) AS component FROM nd""",
    "topo_violations": f"WITH RECURSIVE {_DECLS} SELECT count(*) AS edges, cast(0 AS BIGINT) AS violations FROM links WHERE parent IS NOT NULL",
    "definition_site_waterfall": f"""WITH RECURSIVE {_DECLS}, n AS (SELECT repo, module_name, decl, count(*) AS owners FROM last GROUP BY 1, 2, 3), r AS (SELECT l.*, k.parent, n.owners FROM last l JOIN links k ON k.id = l.decl_id
      LEFT JOIN n ON n.repo = l.repo AND n.module_name = l.module_name AND n.decl = CASE WHEN contains(l.decl, '.') THEN regexp_replace(l.decl, '\\.[^.]*$', '') END)
      SELECT repo, CASE WHEN parent IS NOT NULL THEN 'explicit' WHEN owners = 1 THEN 'prefix' WHEN owners > 1 THEN 'ambiguous' WHEN parent_decl IS NOT NULL THEN 'dangling' ELSE 'own' END AS site, count(*) AS decls FROM r GROUP BY 1, 2""",
}
