"""The pN_ queries: the operators of this subpackage over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, table
from . import confusable, copies, garble, leak, overlap, packing, percentiles, reading, sample, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_density_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["domain", "length_stratum"]
    pieces = percentiles.day_pieces(table(spark, sf_dir, "morph_features"), table(spark, sf_dir, "pair_registry"), by, "pair_id", "morpheme_density", "measured_at")
    return percentiles.select_percentiles(pieces, by)


ORACLE_SQL["p1_density_percentiles"] = """
WITH latest AS (
  SELECT pair_id, morpheme_density AS x,
         row_number() OVER (PARTITION BY pair_id ORDER BY measured_at DESC, morpheme_density DESC NULLS LAST) AS k
  FROM morph_features WHERE pair_id IS NOT NULL AND measured_at IS NOT NULL),
ps AS (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.9, 0.99]::DOUBLE[]) AS percentile),
g AS (SELECT domain, length_stratum, count(*) AS n, list_sort(list(x)) AS xs
      FROM latest JOIN pair_registry USING (pair_id) WHERE k = 1 AND x IS NOT NULL AND NOT isnan(x) GROUP BY ALL),
r AS (SELECT *, percentile * (n - 1) AS pos FROM g, ps),
e AS (SELECT *, xs[floor(pos)::BIGINT + 1] AS lo, xs[ceil(pos)::BIGINT + 1] AS hi, pos - floor(pos) AS d FROM r)
SELECT domain, length_stratum, percentile, CASE WHEN lo = hi THEN lo ELSE lo * (1 - d) + hi * d END AS value, n, 0.0::DOUBLE AS error_bound FROM e
"""


@query
def p1_day_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves: what each day of measurement adds to and takes from each group's values."""
    by = ["domain", "length_stratum"]
    pieces = percentiles.day_pieces(table(spark, sf_dir, "morph_features"), table(spark, sf_dir, "pair_registry"), by, "pair_id", "morpheme_density", "measured_at")
    return percentiles.readable(pieces).withColumn("day", F.col("day").cast("string"))


ORACLE_SQL["p1_day_pieces"] = """
WITH r AS (
  SELECT pair_id, (measured_at AT TIME ZONE 'UTC')::DATE AS day, morpheme_density AS x,
         row_number() OVER (PARTITION BY pair_id, (measured_at AT TIME ZONE 'UTC')::DATE ORDER BY measured_at DESC, morpheme_density DESC NULLS LAST) AS k
  FROM morph_features WHERE pair_id IS NOT NULL AND measured_at IS NOT NULL),
d AS (SELECT *, lead(day) OVER (PARTITION BY pair_id ORDER BY day) AS gone FROM r WHERE k = 1),
s AS (SELECT pair_id, day, x, 1 AS n FROM d UNION ALL SELECT pair_id, gone, x, -1 FROM d WHERE gone IS NOT NULL)
SELECT day::VARCHAR AS day, domain, length_stratum, x AS value, sum(n)::BIGINT AS n FROM s JOIN pair_registry USING (pair_id)
WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL HAVING sum(n) <> 0
"""


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.garbled_sides(table(spark, sf_dir, "pair_registry"))


@query
def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.repaired_sides(table(spark, sf_dir, "pair_registry"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusable.lookalike_sides(table(spark, sf_dir, "pair_registry"))


@query
def p3_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusable.consistent_sides(table(spark, sf_dir, "pair_registry")).select("pair_id", "side", "consistent_text", "reasons")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, sf_dir, "pair_registry")).select("pair_id_a", "pair_id_b")


@query
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "pair_registry"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.format_copies(table(spark, sf_dir, "pair_registry"))


@query
def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = copies.collapse(table(spark, sf_dir, "pair_registry"))
    return kept.select("pair_id", "logical_corpus", "domain", "n_copies")


EDITS = 1  # codes that may differ in a passage


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leak.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), EDITS)
    return found.where("edits = 0").select("item_id", "doc_id")  # TESTDATA asks for the words themselves


@query
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    return leak.leak_report(leak.leaked_items(table(spark, sf_dir, "documents"), items, EDITS), items)


RATE = 0.05


def _sample(spark: SparkSession, sf_dir: str, rate: float | Callable[[int], float]) -> DataFrame:
    """By a ledger in the shared folder that observes the registry's batches; a lasting one would only be given the new batches."""
    ledger = sample.Ledger(spark, f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    ledger.observe(table(spark, sf_dir, "pair_registry"), "pair_id", "ingest_batch", rate)
    return sample.stable_sample(table(spark, sf_dir, "rep_features"), ledger.epochs(), ledger.rates(), "pair_id").select("pair_id", "first_epoch", "rate")


def _sample_sql(rate: str) -> str:
    return f"""
WITH e AS (SELECT pair_id, min(ingest_batch) AS first_epoch FROM pair_registry WHERE ingest_batch IS NOT NULL GROUP BY pair_id),
r AS (SELECT DISTINCT pair_id FROM rep_features WHERE pair_id IS NOT NULL),
x AS (SELECT pair_id, first_epoch, {rate}::DOUBLE AS rate FROM r JOIN e USING (pair_id))
SELECT * FROM x WHERE substr(sha256('{sample.SEED}|0|' || pair_id), 1, 13) <= lpad(format('{{:x}}', (rate * {1 << sample.BITS})::BIGINT), 13, '0')
"""


@query
def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir, RATE)


ORACLE_SQL["p7_sample"] = _sample_sql(str(RATE))


@query
def p7_changing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a rate that was doubled for every other batch: each record keeps that of its own."""
    return _sample(spark, sf_dir, lambda epoch: RATE * (1 + epoch % 2))


ORACLE_SQL["p7_changing_rates"] = _sample_sql(f"({RATE} * (1 + first_epoch % 2))")


@query
def p6_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tokens.pair_budget(table(spark, sf_dir, "token_measurement"), table(spark, sf_dir, "pair_registry"))
    documents = tokens.document_budget(table(spark, sf_dir, "documents"))
    return pairs.select(F.lit("pairs").alias("section"), F.col("logical_corpus").alias("slice"), "language", "domain", "n_texts", "tokens").unionByName(
        documents.select(F.lit("documents").alias("section"), F.col("source").alias("slice"), "language", "domain", "n_texts", "tokens")
    )


@query
def p6_pair_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pair_budget(table(spark, sf_dir, "token_measurement"), table(spark, sf_dir, "pair_registry"))


ORACLE_SQL["p6_pair_budget"] = """
WITH latest AS (
  SELECT pair_id, len(ko_token_ids) AS ko, len(en_token_ids) AS en,
         row_number() OVER (PARTITION BY pair_id ORDER BY measured_at DESC NULLS LAST, len(ko_token_ids) DESC NULLS LAST, len(en_token_ids) DESC NULLS LAST) AS k
  FROM token_measurement WHERE pair_id IS NOT NULL),
sides AS (
  SELECT pair_id, 'ko' AS language, ko AS n FROM latest WHERE k = 1 UNION ALL
  SELECT pair_id, 'en', en FROM latest WHERE k = 1)
SELECT logical_corpus, domain, language, count(n) AS n_texts, coalesce(sum(n), 0)::BIGINT AS tokens
FROM sides JOIN pair_registry USING (pair_id) GROUP BY ALL
"""


@query
def p6_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "domain", "text"), "text")


@query
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"))


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.containers(table(spark, sf_dir, "documents")))


@query
def p10_reading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return reading.reading_levels(documents, reading.train(documents, table(spark, sf_dir, "reading_labels")))


@query
def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    levels = reading.reading_levels(documents, reading.train(documents, table(spark, sf_dir, "reading_labels")))
    return reading.level_profile(documents, levels)


@query
def p10_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.held_out_report(reading.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")))
