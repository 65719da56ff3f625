"""From raw documents to token ids: quality, near duplicates, contamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe, decontaminate, neardup, pii, quality
from pathloom.llm.common import DOCUMENT_COLUMNS, staged, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=tuple(DOCUMENT_COLUMNS), score_col="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*DOCUMENT_COLUMNS)


def _document_key(doc_id: Column, text: Column) -> Column:
    """A number for each id and text: ids below 2^42 in their order (two texts under one such id share a number with a
    probability of 5e-7), then the others."""
    bits = 21
    text = F.coalesce(text, F.lit(""))
    small = F.shiftleft(doc_id, bits) + F.pmod(F.xxhash64(text), F.lit(1 << bits))
    large = F.shiftrightunsigned(F.xxhash64(doc_id, text), 2) + F.lit(1 << 62)
    return F.when(F.abs(doc_id) < (1 << 42), small).when(doc_id.isNotNull(), large)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; rows without an id stay.

    Texts are compared, not ids: several texts under one id are documents of their own, equal rows are one.
    """
    keyed = docs.select("*", _document_key(F.col("doc_id"), F.col("text")).alias("__key"))
    verdicts = neardup.near_duplicates(keyed.select("__key", "text"), neardup.Rule(), "__key")
    kept = verdicts.where("kept AND __key IS NOT NULL").select("__key").distinct()
    named = keyed.where("doc_id IS NOT NULL").join(kept, "__key", "left_semi")
    one = named.groupBy("__key").agg(F.min(F.struct(*DOCUMENT_COLUMNS)).alias("row")).select("row.*")
    return one.unionByName(docs.where("doc_id IS NULL").select(*DOCUMENT_COLUMNS))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in benchmark passages."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(DOCUMENT_COLUMNS))
    return decontaminate.judged(found).where(~F.col("contaminated")).select(*DOCUMENT_COLUMNS)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; their length is that of the new text."""
    hidden = pii.mask_pii(docs.select(*DOCUMENT_COLUMNS))
    return hidden.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; ``round_trip`` tells whether they decode to its text."""
    coded = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             keep=("doc_id", "lang", "source", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"),
                        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), same.alias("round_trip"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", uncontaminated),
          ("pii", masked), ("bpe", encoded)]

#: SQL expresses neither the classifier nor the grouping; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
