import os

import pytest
from pyspark.sql import functions as F

from tessella.plans import registry
from tests.oracle import DATA, same

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

# What must hold of queries that SQL can't express: a condition that no row may fail, and columns that tell rows apart.
RULES = {
    "bootstrap_gain_ci": ("coalesce(gain_low <= gain_high, true) and n_units > 0 and skipped >= 0", ["cell_name"]),
    "bootstrap_gain_ci_docs": ("coalesce(gain_low <= gain_high, true) and n_units > 0 and skipped >= 0", ["cell_name"]),
    "canonical_dependency_order": ("position >= 0 and unit <> target", ["scope", "target", "unit"]),
    "generated_bodies": ("unit_id is not null", None),
    "lean_declarations": ("kind is not null", None),
    "masked_families": ("family rlike '^fam-[0-9a-f]{16}$'", ["repo", "arm"]),
    "powerlaw_fit": ("accepted is not null and (not accepted or (a > 0 and beta > 0))", ["cell"]),
    "python_targets": ("start_byte >= 0 and start_byte < end_byte and body_byte between start_byte and end_byte", ["file_id", "start_byte"]),
    "reference_resolution": ("refs > 0 and how in ('same-file', 'imported', 'repo', 'ambiguous', 'unresolved')", ["repo", "how"]),
    "source_spans": ("bytes > 0 and spans > 0 and bytes >= spans", ["unit_id", "cls"]),
    "topo_order": ("position >= 0", ["module", "position"]),
    "typed_adjacency": ("a <> b and reasons between 1 and 3", ["a", "b"]),
    "typed_collision_groups": ("verbatims >= 2 and members >= verbatims", ["normalized"]),
    "typed_fingerprints": ("(error is null) = (verbatim is not null) and (error is not null or n_lexical <= n_records)", ["unit_id"]),
    "typed_jaccard_pairs": ("a < b and n_inter * 10 >= n_union * 7", ["a", "b"]),
    "typed_records": ("n > 0", ["unit_id", "kind"]),
}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rules_hold(spark, name):
    rule, key = RULES[name]
    rows = registry.queries()[name](spark, FOLDER).cache()
    assert rows.where(~F.coalesce(F.expr(rule), F.lit(False))).count() == 0
    assert key is None or rows.groupBy(*key).count().where("count > 1").count() == 0
    rows.unpersist()


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
