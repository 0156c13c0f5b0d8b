import os

import pytest
from pyspark.sql import functions as F

from tessella.llm import registry
from tests.oracle import DATA, same

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

# What must hold of queries that SQL can't express: a condition that no row may fail, and columns that tell rows apart.
KINDS = "('email', 'phone', 'id_number', 'street_address', 'person_name')"
RULES = {
    "p3_found": ("file_id is not null", ["file_id"]),
    "p3_evidence": ("not_hand_written = (generated or minified or data or vendor_path or bulk_import or vendor_commit or copied)", ["file_id"]),
    "p6_ids": ("ids is not null and forall(ids, x -> x >= 0 and x < 50300)", ["doc_id"]),
    "p7_found": ("source is not null", ["mix_id", "source"]),
    "p7_mix": ("n_uses > 0", ["mix_id", "source", "doc_id"]),
    "p7_report": ("actual_tokens <= available_tokens * max_repeats and (not short or actual_tokens = available_tokens * max_repeats)", ["mix_id", "source"]),
    "p8_found": (f"start_char >= 0 and kind in {KINDS}", ["doc_id", "kind", "start_char"]),
    "p8_masked": ("doc_id is not null", ["doc_id"]),
}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rules_hold(spark, name):
    rule, key = RULES[name]
    rows = registry.queries()[name](spark, FOLDER).cache()
    assert rows.where(~F.coalesce(F.expr(rule), F.lit(False))).count() == 0
    assert rows.groupBy(*key).count().where("count > 1").count() == 0
    rows.unpersist()


def test_every_document_and_file_has_its_row(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id")
    for name in ("p6_ids", "p8_masked"):
        assert sorted(r[0] for r in registry.queries()[name](spark, FOLDER).select("doc_id").collect()) == sorted(r[0] for r in docs.collect())
    files = {r[0] for r in spark.read.parquet(f"{FOLDER}/source_files.parquet").select("file_id").collect()} - {None}
    assert {r[0] for r in registry.queries()["p3_evidence"](spark, FOLDER).select("file_id").collect()} == files
