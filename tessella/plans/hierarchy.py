"""Problem 4: declaration trees along parent_decl and the orders checked with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.hierarchy import ancestors, hierarchy, order_violations
from tessella.scratch import Scratch
from tessella.sources.tables import table


def clean_name(c) -> F.Column:
    """A declaration name without surrounding blanks and leading ``_root_.``; null if nothing is left."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"^_root_\.", ""))
    return F.when(bare != "", bare)


def declarations(parents: DataFrame) -> DataFrame:
    """One row per decl_id, from its row with the largest run_no; the parent resolved to a decl_id.

    A parent counts within repo and module only; one that names no declaration
    there counts as none. Equal rows collapse; if rows of one run disagree,
    the latest and then the greatest row holds. A null run_no is older than
    any other. Rows without decl_id are left out.
    """
    rows = parents.where("decl_id is not null").select(
        "decl_id",
        F.struct(
            F.coalesce("run_no", F.lit(-(2**31))).alias("run_no"),
            F.col("extracted_at"),
            F.col("repo"),
            F.trim("module_name").alias("module_name"),
            clean_name(F.col("decl")).alias("decl"),
            clean_name(F.col("parent_decl")).alias("parent_decl"),
            F.col("decl_kind"),
        ).alias("r"),
    )
    last = rows.groupBy("decl_id").agg(F.max("r").alias("r")).select("decl_id", "r.repo", "r.module_name", "r.decl", "r.parent_decl", "r.decl_kind")
    # decl is unique in its module; should it not be, the least id answers to the name
    named = last.where("decl is not null").groupBy("repo", "module_name", F.col("decl").alias("parent_decl")).agg(F.min("decl_id").alias("parent_id"))
    return last.join(named, ["repo", "module_name", "parent_decl"], "left")


def _tree(spark: SparkSession, d: str, with_path: bool) -> tuple[DataFrame, DataFrame]:
    decls = Scratch(spark).cut(declarations(table(spark, d, "definition_parents")), "decls")
    return decls, hierarchy(decls, "decl_id", "parent_id", with_path)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """One row per order_id: repeated rows are equal; of unequal ones the latest holds."""
    return (
        table(spark, d, "assembly_orders")
        .where("order_id is not null")
        .groupBy("order_id")
        .agg(F.max(F.struct("built_at", "target_id", "unit_order")).alias("r"))
        .select("order_id", "r.target_id", "r.unit_order")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Root of each declaration, and the orders that list a unit ahead of another of its ancestors."""
    _, tree = _tree(spark, d, False)
    tree = Scratch(spark).cut(tree.select("id", "root", "tour", "enter", "exit"), "tree")
    orders = _orders(spark, d)
    bad = order_violations(orders, "order_id", "unit_order", tree).where("violates").select("order_id")
    roots = tree.select(F.col("id").alias("target_id"), "root")
    hits = orders.select("order_id", "target_id").join(bad, "order_id").join(roots, "target_id", "left")
    return tree.select(F.lit("decl").alias("record_kind"), F.col("id").alias("record_id"), F.col("root").alias("root_id")).unionByName(
        hits.select(F.lit("order").alias("record_kind"), F.col("order_id").alias("record_id"), F.col("root").alias("root_id"))
    )


def p4_tree(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, number of descendants and cycle state of each declaration."""
    _, tree = _tree(spark, d, True)
    return tree.select(
        F.col("id").alias("decl_id"),
        F.col("parent").alias("parent_id"),
        F.col("root").alias("root_id"),
        "depth",
        F.array_join(F.col("path").cast("array<string>"), "/").alias("path"),
        "n_descendants",
        "in_cycle",
        "below_cycle",
    )


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of a declaration and one of its descendants, in trees; the distance between them.

    The rows are as many as the depths of all nodes together.
    """
    _, tree = _tree(spark, d, False)
    pairs = ancestors(Scratch(spark).cut(tree.select("id", "tour", "enter", "exit", "depth"), "tree"))
    return pairs.select(F.col("ancestor").alias("ancestor_id"), F.col("id").alias("descendant_id"), "distance")


def p4_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the number of its known units and whether it keeps ancestors first."""
    _, tree = _tree(spark, d, False)
    return order_violations(_orders(spark, d), "order_id", "unit_order", tree)


QUERIES = {"p4_found": p4_found, "p4_tree": p4_tree, "p4_descendants": p4_descendants, "p4_orders": p4_orders}

_DECLS = r"""
last AS (SELECT * FROM (SELECT decl_id, repo, trim(module_name) AS module_name,
    nullif(trim(regexp_replace(trim(decl), '^_root_\.', '')), '') AS decl,
    nullif(trim(regexp_replace(trim(parent_decl), '^_root_\.', '')), '') AS parent_decl, decl_kind,
    row_number() OVER (PARTITION BY decl_id ORDER BY run_no DESC, extracted_at DESC) AS rn
  FROM definition_parents) WHERE rn = 1),
links AS (SELECT a.decl_id AS id, b.decl_id AS parent FROM last a LEFT JOIN last b
  ON a.repo = b.repo AND a.module_name = b.module_name AND a.parent_decl = b.decl),
anc AS (SELECT id, parent AS anc FROM links WHERE parent IS NOT NULL
  UNION SELECT anc.id, links.parent FROM anc JOIN links ON anc.anc = links.id WHERE links.parent IS NOT NULL),
cyc AS (SELECT id FROM anc WHERE id = anc),
stuck AS (SELECT id FROM cyc UNION SELECT a.id FROM anc a JOIN cyc c ON a.anc = c.id),
roots AS (SELECT l.id, CASE WHEN s.id IS NOT NULL THEN -1 WHEN l.parent IS NULL THEN l.id ELSE
    (SELECT min(a.anc) FROM anc a JOIN links p ON a.anc = p.id AND p.parent IS NULL WHERE a.id = l.id) END AS root
  FROM links l LEFT JOIN stuck s ON l.id = s.id),
ords AS (SELECT order_id, target_id, any_value(unit_order) AS unit_order FROM assembly_orders GROUP BY order_id, target_id),
items AS (SELECT order_id, id, min(pos) AS pos FROM (SELECT order_id, unnest(unit_order) AS id, generate_subscripts(unit_order, 1) AS pos FROM ords)
  GROUP BY order_id, id),
bad AS (SELECT DISTINCT u.order_id FROM items u JOIN anc a ON u.id = a.id AND a.anc <> a.id JOIN items v ON v.order_id = u.order_id AND v.id = a.anc
  WHERE u.pos < v.pos)
"""

ORACLE = {
    "p4_found": f"WITH RECURSIVE {_DECLS} SELECT 'decl' AS record_kind, id AS record_id, cast(root AS BIGINT) AS root_id FROM roots"
    " UNION ALL SELECT 'order', o.order_id, cast(r.root AS BIGINT) FROM ords o JOIN bad USING (order_id) LEFT JOIN roots r ON r.id = o.target_id",
    "p4_tree": f"WITH RECURSIVE {_DECLS}, paths AS (SELECT id, cast(id AS VARCHAR) AS path, cast(0 AS BIGINT) AS depth FROM links WHERE parent IS NULL"
    " UNION ALL SELECT l.id, p.path || '/' || l.id, p.depth + 1 FROM paths p JOIN links l ON l.parent = p.id),"
    " below AS (SELECT anc AS id, count(DISTINCT id) FILTER (WHERE id <> anc) AS n FROM anc GROUP BY anc)"
    " SELECT l.id AS decl_id, l.parent AS parent_id, cast(r.root AS BIGINT) AS root_id, p.depth, p.path, cast(coalesce(b.n, 0) AS BIGINT) AS n_descendants,"
    " c.id IS NOT NULL AS in_cycle, (s.id IS NOT NULL AND c.id IS NULL) AS below_cycle"
    " FROM links l JOIN roots r ON r.id = l.id LEFT JOIN paths p ON p.id = l.id LEFT JOIN below b ON b.id = l.id LEFT JOIN cyc c ON c.id = l.id LEFT JOIN stuck s ON s.id = l.id",
    "p4_descendants": f"WITH RECURSIVE {_DECLS}, up AS (SELECT id, parent AS anc, cast(1 AS BIGINT) AS distance FROM links WHERE parent IS NOT NULL AND id NOT IN (SELECT id FROM stuck)"
    " UNION ALL SELECT up.id, l.parent, up.distance + 1 FROM up JOIN links l ON up.anc = l.id WHERE l.parent IS NOT NULL)"
    " SELECT anc AS ancestor_id, id AS descendant_id, distance FROM up",
    "p4_orders": f"WITH RECURSIVE {_DECLS} SELECT o.order_id, cast((SELECT count(*) FROM items i JOIN links l ON l.id = i.id WHERE i.order_id = o.order_id) AS BIGINT) AS n_listed,"
    " (b.order_id IS NOT NULL) AS violates FROM ords o LEFT JOIN bad b USING (order_id)",
}
