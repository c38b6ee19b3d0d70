"""A corpus pipeline: language ID, near-duplicate removal, redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; `run` writes each stage's
result as Parquet in the shared folder and reads it for the next. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import cut, held_out, numbered, table
from framewright.llm.jaccard import firsts, once, row_key
from framewright.llm.language import fit, relabel
from framewright.llm.mixing import mix_sources
from framewright.llm.packing import pack
from framewright.llm.pii import redact
from framewright.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a known language go; lang becomes the predicted one."""
    decoder = fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    return relabel(docs, decoder)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class stays, of a class without ids one; texts of different classes stay also
    where they share an id or have none. Of rows without words, those that differ in id or text stay."""
    rows = numbered(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    # join and dropDuplicates share one exchange of the texts
    kept = once(rows.withColumn("row", row_key(doc_id, text)), "row").join(firsts(docs), "row")
    return kept.dropDuplicates(["row"]).select(*rows.columns).toDF(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated to the mixture; the columns stay, also those named like the operator's own."""
    rows = numbered(docs)
    own = mix_sources(rows, id_col=f"c{docs.columns.index('doc_id')}", source=f"c{docs.columns.index('source')}")
    return own.select(*rows.columns).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [("language", language), ("duplicates", duplicates), ("private", private), ("mixing", mixing), ("packing", packing)]
#: The stages learn, hash and tokenize: SQL can't express them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
