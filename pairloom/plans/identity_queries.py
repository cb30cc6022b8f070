"""Queries over identities, digests, duplicate groups and overlaps."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import text as tx
from ..operators import relations as rl
from ..session import table
from .registry import query

PREFIXED = "unhex(printf('%016x', octet_length(encode({0})))) || encode({0})"
RAW_GROUP = f"'dup_' || sha256({PREFIXED.format('ko_text_raw')} || {PREFIXED.format('en_text_raw')})"
COHORT = "pair_quality_status = 'accepted' AND analysis_eligible_exact_dedup AND logical_corpus IN ('025', '026')"


@query(
    f"""SELECT pair_id, {RAW_GROUP} AS content_id,
  'pair_' || sha256({PREFIXED.format('source_id')} || {PREFIXED.format('source_record_id')}) AS provenance_id FROM pair_registry"""
)
def recomputed_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry")
    return d.select("pair_id", hs.duplicate_group_id("ko_text_raw", "en_text_raw").alias("content_id"), hs.pair_id("source_id", "source_record_id").alias("provenance_id"))


@query("SELECT source_id, 'family-' || logical_corpus || '@raw-manifest:' || raw_manifest_sha256 AS snapshot_id FROM source_registry")
def source_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_registry").select("source_id", hs.source_id(F.concat(F.lit("family-"), "logical_corpus"), "raw_manifest_sha256").alias("snapshot_id"))


@query(
    """WITH d AS (SELECT logical_corpus AS c, coalesce(ko_text_raw, '') AS k, coalesce(en_text_raw, '') AS e, count(*) AS n FROM pair_registry WHERE logical_corpus IS NOT NULL GROUP BY ALL)
SELECT c AS dim_a, c AS dim_b, sum(n)::BIGINT AS rows_a, count(*) AS distinct_a, (sum(n) - count(*))::BIGINT AS dup_rows_a, NULL::BIGINT AS shared_distinct FROM d GROUP BY c UNION ALL
SELECT a.c, b.c, NULL, NULL, NULL, count(*) FROM d a JOIN d b ON a.k = b.k AND a.e = b.e AND a.c < b.c GROUP BY a.c, b.c"""
)
def salted_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of corpora by digests under a salt of this run: whatever the salt, the counts are those of the texts themselves."""
    return rl.overlap_matrix(table(spark, sf_dir, "pair_registry"), "logical_corpus", hs.salted_pair_digest("ko_text_raw", "en_text_raw", os.urandom(16)))


@query("SELECT morph_measurement_id, 'm_' || sha256('MORPH_v2|' || analyzer_config_hash || '|' || pair_id) AS recomputed FROM (SELECT DISTINCT morph_measurement_id, analyzer_config_hash, pair_id FROM morph_features)")
def measurement_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "morph_features").select("morph_measurement_id", "analyzer_config_hash", "pair_id").distinct()
    return d.select("morph_measurement_id", F.concat(F.lit("m_"), F.sha2(F.concat_ws("|", F.lit("MORPH_v2"), "analyzer_config_hash", "pair_id"), 256)).alias("recomputed"))


@query("SELECT md5(string_agg(pair_id, '' ORDER BY pair_id)) AS digest FROM pair_registry")
def sorted_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.sorted_set_digest(table(spark, sf_dir, "pair_registry"), "pair_id")


@query("SELECT sha256(string_agg(pair_id || chr(10), '' ORDER BY pair_id)) AS digest FROM pair_registry")
def sorted_lines_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.sorted_lines_digest(table(spark, sf_dir, "pair_registry"), "pair_id")


@query("SELECT count(pair_id) AS n, count(DISTINCT pair_id) AS n_distinct, sum(('0x' || substr(md5(pair_id), 1, 12))::BIGINT)::VARCHAR AS fold FROM rep_features")
def set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.set_fingerprint(table(spark, sf_dir, "rep_features"), "pair_id").withColumn("fold", F.col("fold").cast("string"))


@query("SELECT source_id, ('0x' || substr(sha256(source_id), 1, 8))::BIGINT AS seed FROM source_registry")
def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_registry").select("source_id", hs.seed(F.col("source_id")).alias("seed"))


@query(
    """SELECT pair_id, json_keys(raw_metadata_json).list_sort() AS keys, raw_metadata_json ->> '$.sn' AS sn, raw_metadata_json ->> '$.license' AS license FROM pair_registry"""
)
def canonical_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry").select("pair_id", hs.canonical_metadata("raw_metadata_json").alias("m"))
    parsed = F.from_json("m", "map<string,string>")
    return d.select("pair_id", F.map_keys(parsed).alias("keys"), parsed["sn"].alias("sn"), parsed["license"].alias("license"))


@query(
    """SELECT count(*) AS n, count(*) FILTER (WHERE pair_id IS NULL) AS null_ids, count(*) FILTER (WHERE length(raw_file_sha256) <> 64 OR raw_file_sha256 IS NULL) AS bad_hashes,
  count(*) FILTER (WHERE NOT coalesce(json_valid(raw_locator), false)) AS bad_locators, count(*) FILTER (WHERE s.source_id IS NULL) AS unlisted_sources
FROM pair_registry p LEFT JOIN source_registry s ON p.source_id = s.source_id"""
)
def row_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "source_registry").select("source_id", F.lit(True).alias("listed"))
    d = table(spark, sf_dir, "pair_registry").join(listed, "source_id", "left")
    return d.agg(
        F.count("*").alias("n"), F.count_if(F.col("pair_id").isNull()).alias("null_ids"), F.count_if(F.coalesce(F.length("raw_file_sha256") != 64, F.lit(True))).alias("bad_hashes"),
        F.count_if(F.from_json("raw_locator", "map<string,string>").isNull()).alias("bad_locators"), F.count_if(F.col("listed").isNull()).alias("unlisted_sources"),
    )


@query(f"SELECT 'domain' AS dimension, domain AS level, count(*) AS n FROM pair_registry WHERE {COHORT} GROUP BY domain UNION ALL SELECT 'source_id', source_id, count(*) FROM pair_registry WHERE {COHORT} GROUP BY source_id UNION ALL SELECT 'translation_direction', translation_direction, count(*) FROM pair_registry WHERE {COHORT} GROUP BY translation_direction")
def cohort_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry").where(COHORT)
    long = d.select(F.inline(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("level")) for c in ("domain", "source_id", "translation_direction")))))
    return long.groupBy("dimension", "level").agg(F.count("*").alias("n"))


GROUPS = """SELECT duplicate_group_id, min(pair_id) AS representative_pair_id, count(*) AS group_rows, min(translation_direction_raw) AS single_direction,
  count(DISTINCT translation_direction_raw) > 1 AS direction_conflict_flag, count(DISTINCT domain) > 1 AS domain_conflict_flag,
  count(DISTINCT source_id) > 1 AS source_id_conflict_flag, count(DISTINCT source_provenance_raw) > 1 AS source_provenance_raw_conflict_flag
FROM pair_registry GROUP BY duplicate_group_id"""


@query(GROUPS)
def group_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.group_resolved(table(spark, sf_dir, "pair_registry"))


@query(
    f"""WITH g AS ({GROUPS}) SELECT pair_id, g.representative_pair_id, g.direction_conflict_flag,
  CASE WHEN g.direction_conflict_flag OR g.single_direction IS NULL THEN 'UNKNOWN' ELSE g.single_direction END AS translation_direction,
  coalesce(p.translation_direction_review_flag, false) OR g.direction_conflict_flag AS translation_direction_review_flag
FROM pair_registry p JOIN g USING (duplicate_group_id)"""
)
def resolved_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.resolved_registry(table(spark, sf_dir, "pair_registry")).select("pair_id", "representative_pair_id", "direction_conflict_flag", "translation_direction", "translation_direction_review_flag")


@query("SELECT logical_corpus, sum(n - 1)::BIGINT AS duplicate_rows_after_first, count(*) AS duplicate_groups FROM (SELECT logical_corpus, duplicate_group_id, count(*) AS n FROM pair_registry GROUP BY ALL HAVING count(*) > 1) GROUP BY logical_corpus")
def duplicate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.duplicate_metrics(table(spark, sf_dir, "pair_registry"), "logical_corpus", "duplicate_group_id")


@query("SELECT count(*) AS groups FROM (SELECT duplicate_group_id FROM pair_registry WHERE logical_corpus IN ('025', '026') GROUP BY ALL HAVING count(DISTINCT logical_corpus) = 2)")
def cross_corpus_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry").where(F.col("logical_corpus").isin("025", "026"))
    return d.groupBy("duplicate_group_id").agg(F.min("logical_corpus").alias("a"), F.max("logical_corpus").alias("b")).where("a <> b").agg(F.count("*").alias("groups"))


@query("SELECT logical_corpus, count(*) AS collisions FROM (SELECT logical_corpus, source_record_id FROM pair_registry GROUP BY ALL HAVING count(*) > 1) GROUP BY logical_corpus")
def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry").groupBy("logical_corpus", "source_record_id").agg(F.count("*").alias("n")).where("n > 1")
    return d.groupBy("logical_corpus").agg(F.count("*").alias("collisions"))


@query(
    """WITH d AS (SELECT DISTINCT logical_corpus AS c, duplicate_group_id AS g FROM pair_registry WHERE logical_corpus IS NOT NULL),
n AS (SELECT logical_corpus AS c, count(*) AS rows_a, count(DISTINCT duplicate_group_id) AS distinct_a FROM pair_registry WHERE logical_corpus IS NOT NULL GROUP BY ALL)
SELECT c AS dim_a, c AS dim_b, rows_a, distinct_a, rows_a - distinct_a AS dup_rows_a, NULL::BIGINT AS shared_distinct FROM n UNION ALL
SELECT a.c, b.c, NULL, NULL, NULL, count(*) FROM d a JOIN d b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c"""
)
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.overlap_matrix(table(spark, sf_dir, "pair_registry"), "logical_corpus", "duplicate_group_id")


@query("""SELECT coalesce(sum(least(a.n, b.n)), 0)::BIGINT AS matchable FROM (SELECT duplicate_group_id AS g, count(*) AS n FROM pair_registry WHERE is_validation_upstream GROUP BY g) a
JOIN (SELECT duplicate_group_id AS g, count(*) AS n FROM pair_registry WHERE NOT is_validation_upstream GROUP BY g) b USING (g)""")
def matchable_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry")
    return rl.matchable(d.where("is_validation_upstream"), d.where("not is_validation_upstream"), "duplicate_group_id")


@query("""WITH f AS (SELECT duplicate_group_id, min((ingest_batch, raw_file_relative_path, pair_id)) AS first FROM pair_registry GROUP BY ALL)
SELECT logical_corpus, is_validation_upstream, count(*) AS n, count(*) FILTER (WHERE (ingest_batch, raw_file_relative_path, pair_id) > first) AS seen_before
FROM pair_registry JOIN f USING (duplicate_group_id) GROUP BY ALL""")
def seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rl.seen_before(table(spark, sf_dir, "pair_registry"), "duplicate_group_id", ["ingest_batch", "raw_file_relative_path", "pair_id"])
    return d.groupBy("logical_corpus", "is_validation_upstream").agg(F.count("*").alias("n"), F.count_if("seen_before").alias("seen_before"))


@query("""WITH c AS (SELECT duplicate_group_id, count(*) FILTER (WHERE translation_direction = 'KO_TO_EN') AS a, count(*) FILTER (WHERE translation_direction = 'EN_TO_KO') AS b FROM pair_registry GROUP BY ALL)
SELECT sum(greatest(a - 1, 0))::BIGINT AS within_first, sum(greatest(b - 1, 0))::BIGINT AS within_second, sum(least(a, b))::BIGINT AS across, count(*) FILTER (WHERE a > 0 AND b > 0) AS shared_distinct FROM c""")
def duplicate_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.mechanism(table(spark, sf_dir, "pair_registry"), "duplicate_group_id", "translation_direction", ("KO_TO_EN", "EN_TO_KO"))


@query("SELECT copies, count(*) AS digests FROM (SELECT count(*) AS copies FROM pair_registry GROUP BY duplicate_group_id) GROUP BY copies")
def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.multiplicity(table(spark, sf_dir, "pair_registry"), "duplicate_group_id")


@query("""SELECT source_provenance_raw, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM pair_registry
WHERE duplicate_group_id IN (SELECT duplicate_group_id FROM pair_registry GROUP BY ALL HAVING count(*) > 1) GROUP BY source_provenance_raw""")
def overlap_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pair_registry")
    many = d.groupBy("duplicate_group_id").agg(F.count("*").alias("n")).where("n > 1").select("duplicate_group_id")
    n = d.join(many, "duplicate_group_id", "left_semi").groupBy("source_provenance_raw").agg(F.count("*").alias("n"))
    return rl.share_within(n, "n").withColumn("share", F.round("share", 9))


@query("SELECT count(*) AS groups, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS singletons, quantile_cont(n, 0.99)::DOUBLE AS p99 FROM (SELECT count(*) AS n FROM pair_registry GROUP BY duplicate_group_id)")
def group_size_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "pair_registry").groupBy("duplicate_group_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"), F.percentile("n", F.lit(0.99)).alias("p99"))


@query("""SELECT pair_id, coalesce(min(pair_id) FILTER (logical_corpus IN ('025', '026')) OVER (PARTITION BY duplicate_group_id), min(pair_id) OVER (PARTITION BY duplicate_group_id)) AS representative FROM pair_registry""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.quality import PRIMARY, analysis_representative

    d = table(spark, sf_dir, "pair_registry").select("pair_id", "duplicate_group_id", "logical_corpus")
    return analysis_representative(d, "duplicate_group_id", "pair_id", F.col("logical_corpus").isin(*PRIMARY)).select("pair_id", F.col("analysis_representative_pair_id").alias("representative"))


@query("""SELECT source_id, s.logical_corpus, expected_row_count, count(p.pair_id) AS observed_rows, count(DISTINCT raw_file_relative_path) AS observed_files, expected_row_count = count(p.pair_id) AS as_expected
FROM source_registry s LEFT JOIN pair_registry p USING (source_id) GROUP BY source_id, s.logical_corpus, expected_row_count""")
def source_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import source_registry

    return source_registry(table(spark, sf_dir, "pair_registry"), table(spark, sf_dir, "source_registry"))


@query("""WITH n AS (SELECT 'direction' AS section, translation_direction AS c, ingest_batch, count(*) AS rows_seen, count(DISTINCT duplicate_group_id) AS distinct_seen FROM pair_registry GROUP BY ALL)
SELECT dim_a, r.ingest_batch, rows_a, rows_seen, distinct_a, distinct_seen FROM overlap_report r JOIN n ON n.section = r.section AND c = dim_a AND n.ingest_batch = r.ingest_batch WHERE dim_a = dim_b""")
def overlap_report_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored report's diagonal against the registry."""
    n = table(spark, sf_dir, "pair_registry").groupBy("translation_direction", "ingest_batch").agg(F.count("*").alias("rows_seen"), F.count_distinct("duplicate_group_id").alias("distinct_seen"))
    r = table(spark, sf_dir, "overlap_report").where("section = 'direction' and dim_a = dim_b")
    return r.join(n.withColumnRenamed("translation_direction", "dim_a"), ["dim_a", "ingest_batch"]).select("dim_a", "ingest_batch", "rows_a", "rows_seen", "distinct_a", "distinct_seen")


@query("SELECT pair_id, CASE WHEN translation_direction_raw IS NULL THEN 'UNKNOWN' WHEN translation_direction_raw IN ('KO_TO_EN', 'EN_TO_KO') THEN translation_direction_raw ELSE 'UNKNOWN' END AS direction, CASE WHEN raw_physical_row_number IS NULL THEN NULL ELSE raw_physical_row_number::VARCHAR END AS row_text FROM pair_registry")
def staged_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    direction = F.when(F.col("translation_direction_raw").isin("KO_TO_EN", "EN_TO_KO"), F.col("translation_direction_raw")).otherwise("UNKNOWN")
    return table(spark, sf_dir, "pair_registry").select("pair_id", direction.alias("direction"), tx.scalar_text(F.col("raw_physical_row_number").cast("double")).alias("row_text"))
