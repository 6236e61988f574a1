"""The training-data pipeline: quality rules, near-duplicate join, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and
returns a frame; all but the last return the columns of ``docs``. Empty inputs give
empty outputs, null ids and texts pass as the stages say, and further columns of
``docs`` travel along unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import mixing, packing, quality, setjoin, substrings
from quillmark.llm.common import materialize, table, text_key
from quillmark.llm.queries import tokenizer_path


def _deciding(docs: DataFrame, verdicts: DataFrame, key) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, key) is among the verdicts; ids match null-safely."""
    ids = verdicts.select(F.col("doc_id").alias("_quill_id"), F.col(verdicts.columns[1]).alias("_quill_key")).distinct()
    keyed = docs.withColumn("_quill_k", key)
    on = keyed["doc_id"].eqNullSafe(ids["_quill_id"]) & (keyed["_quill_k"] == ids["_quill_key"])
    return keyed.join(ids, on, "left_semi").select(*[docs[c] for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or look anomalous go; repeated rows share a verdict."""
    verdicts = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    return _deciding(docs, verdicts.where("kept").select("doc_id", "text_key"), text_key())


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays; documents without words all stay."""
    found = materialize(setjoin.similar_documents(docs))
    some = found.where("n_shingles > 0")
    stay = some.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r")).select("r.doc_id", "r.key")
    stay = stay.unionByName(found.where("n_shingles = 0").select("doc_id", "key"))
    kept = _deciding(docs, stay, F.hash(F.coalesce("text", F.lit(""))))
    if found.groupBy("doc_id", "key").count().where("count > 1").limit(1).count():  # repeated rows are one document
        kept = kept.dropDuplicates([c for c, kind in docs.dtypes if not kind.startswith("map")])
    return kept


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut; n_chars follows."""
    cut = substrings.substring_dedup(docs).where("n_removed > 0").select(F.col("doc_id").alias("_quill_id"), F.col("key").alias("_quill_key"), F.col("kept").alias("_quill_text")).dropDuplicates(["_quill_id", "_quill_key"])
    key = F.hash(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("_quill_k", key).join(cut, (F.col("doc_id") == F.col("_quill_id")) & (F.col("_quill_k") == F.col("_quill_key")), "left")
    text = F.when(F.col("_quill_id").isNotNull(), F.col("_quill_text")).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_quill_id").isNotNull(), F.char_length("_quill_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to tempered source, language and topic weights."""
    return _deciding(docs, mixing.mix(docs).where("kept").select("doc_id", "key"), text_key())


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of at most 2048 tokens, with its sequence and place."""
    return packing.pack_documents(docs, tokenizer_path()).drop("key")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

#: A forest and a raking loop are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
