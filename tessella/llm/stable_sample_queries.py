"""Queries of problem 5.

Targets are drawn per repo and language under the plan's sampling_seed, lean
declarations per repo under its v2a_seed. The key of a target is its identity
(JSON without blanks), of a declaration its module and name without blanks
and ``_root_.``, each from the earliest delivery that has it. The rates of a
stratum are only ever raised and do not look at how much has come in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.joins import lookup_join
from tessella.llm.stable_sample import first_known, stable_sample
from tessella.sources.tables import table

#: Picked per million, by stratum, in the order in which the rates were set.
RATES = [("lean", 60_000), ("python", 100_000), ("declaration", 50_000), ("lean", 80_000)]


def _json_key(seed: str, *fields: str) -> F.Column:
    """Seed, repo and fields as JSON; null if any of them is."""
    parts = [seed, "repo", *fields]
    known = F.col(parts[0]).isNotNull()
    for c in parts[1:]:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.to_json(F.array(*parts)))


def picked_targets(candidates: DataFrame, seeds: DataFrame, rates: DataFrame) -> DataFrame:
    """The picked target_ids with repo, stratum (language), key_hash and rate_ppm."""
    compact = F.regexp_replace("identity", r'("(?:[^"\\]|\\.)*")|\s+', "$1")
    seen = first_known(candidates.select("target_id", "batch_no", "repo", F.col("lang").alias("stratum"), compact.alias("identity")), "target_id", "batch_no", ["repo", "stratum", "identity"])
    return stable_sample(lookup_join(seen, seeds, ["repo"], "inner"), ["stratum"], _json_key("sampling_seed", "identity"), rates)


def picked_declarations(parents: DataFrame, seeds: DataFrame, rates: DataFrame) -> DataFrame:
    """The picked decl_ids with repo, key_hash and rate_ppm."""
    name = F.trim(F.regexp_replace(F.trim("decl"), r"^_root_\.", ""))
    rows = parents.select("decl_id", "run_no", "repo", F.trim("module_name").alias("module_name"), name.alias("decl"))
    seen = first_known(rows, "decl_id", "run_no", ["repo", "module_name", "decl"])
    return stable_sample(lookup_join(seen, seeds, ["repo"], "inner"), [], _json_key("v2a_seed", "module_name", "decl"), rates.where("stratum = 'declaration'"))


def plan_seeds(plans: DataFrame) -> DataFrame:
    return plans.groupBy("repo").agg(F.min("sampling_seed").alias("sampling_seed"), F.min("v2a_seed").alias("v2a_seed"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    """Picked targets and lean declarations with stratum, hash and rate."""
    rates = spark.createDataFrame(RATES, "stratum string, rate_ppm bigint")
    seeds = plan_seeds(table(spark, d, "sample_plans"))
    picked = picked_targets(table(spark, d, "candidates"), seeds, rates)
    kept = picked_declarations(table(spark, d, "definition_parents"), seeds, rates)
    return picked.select(F.lit("target").alias("record_kind"), F.col("target_id").alias("record_id"), "repo", "stratum", "key_hash", "rate_ppm").unionByName(
        kept.select(F.lit("decl").alias("record_kind"), F.col("decl_id").alias("record_id"), "repo", F.lit("declaration").alias("stratum"), "key_hash", "rate_ppm")
    )


QUERIES = {"p5_sample": p5_sample}


def _first(c: str) -> str:
    return f"(min({{'b': b, 'v': {c}}}) FILTER (WHERE {c} IS NOT NULL)).v"


ORACLE = {
    "p5_sample": rf"""WITH pl AS (SELECT repo, min(sampling_seed) AS s, min(v2a_seed) AS v FROM sample_plans GROUP BY repo),
    cr AS (SELECT target_id, coalesce(batch_no, -1) AS b, repo, lang, regexp_replace(identity, '("(?:[^"\\]|\\.)*")|\s+', '\1', 'g') AS identity FROM candidates),
    c AS (SELECT target_id, {_first("repo")} AS repo, {_first("lang")} AS lang, {_first("identity")} AS identity FROM cr GROUP BY target_id),
    er AS (SELECT decl_id, coalesce(run_no, -1) AS b, repo, trim(module_name) AS m, trim(regexp_replace(trim(decl), '^_root_\.', '')) AS n FROM definition_parents),
    e AS (SELECT decl_id, {_first("repo")} AS repo, {_first("m")} AS m, {_first("n")} AS n FROM er GROUP BY decl_id),
    u AS (SELECT 'target' AS record_kind, target_id AS record_id, c.repo, lang AS stratum, sha256(to_json([pl.s, c.repo, identity])) AS h FROM c JOIN pl ON c.repo = pl.repo
      UNION ALL SELECT 'decl', decl_id, e.repo, 'declaration', sha256(to_json([pl.v, e.repo, m, n])) FROM e JOIN pl ON e.repo = pl.repo),
    r AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in RATES)}) AS r(stratum, rate)),
    top AS (SELECT stratum, max(rate) AS rate FROM r GROUP BY stratum)
    SELECT record_kind, record_id, repo, stratum, substr(h, 1, 16) AS key_hash, cast(rate AS BIGINT) AS rate_ppm FROM u JOIN top USING (stratum)
    WHERE cast('0x' || substr(h, 1, 8) AS BIGINT) * 1000000 < cast(rate AS BIGINT) * 4294967296""",
}
