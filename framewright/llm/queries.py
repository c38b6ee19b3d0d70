"""The ten operators as queries over the tables, with production parameters; and the whole pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .fingerprints import fingerprints
from .jaccard import near_duplicates
from .language import identify
from .mixing import mix_sources
from .packing import pack
from .pii import detect
from .quality import quality_rules
from .secrets import find_secrets
from .toxicity import score
from .urls import filter_urls


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secrets, op2_fingerprints, op3_language, op4_toxicity, op5_pii, op6_jaccard, op7_mixing, op8_urls, op9_quality, op10_packing, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Mixing is the operator whose whole result SQL can express; the others hold trained or calibrated parts
    and are tested against brute-force versions."""
    return {"op7_mixing": MIXING}


#: Counts invert the Poisson distribution at the same hashed uniform; a rate stays below its split (400) here.
MIXING = """
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
cdf AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
),
u AS (SELECT d.*, coalesce(source, '') AS s, CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, CAST(count(*) AS INTEGER) AS n_copies FROM u JOIN cdf ON cdf.s = u.s AND cdf.c <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(i AS INTEGER) AS copy, md5('7:order:' || CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)) AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(n_copies)) AS i)
"""
