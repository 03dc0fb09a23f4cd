"""From documents to packed training sequences: five stages, each written as Parquet and read again as the next one's input.

toxicity and quality drop the documents that their classifier rejects, near-dedup keeps one document of each group of near
copies (five-word shingles, similarity 0.8), secrets are replaced in the texts, and packing returns the pieces.

Defined results: the classifiers judge by id, so one rejected row of an id rejects all its rows; near-dedup judges by id and
text: rows of one id with different texts are documents of their own, and of rows equal in both the one with the least hash
of all its columns stays; rows with a null id take part under a key made from their text, so they are scored, rejected and
deduplicated like others, a row with an id staying before them; those without words are linked with nothing and all stay;
extra columns pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import discard, materialise, scratch, table
from riskweave.llm.minhash import minhash_components
from riskweave.llm.packing import added_tokens, best_fit_pack
from riskweave.llm.quality import quality
from riskweave.llm.secrets import redact_secrets
from riskweave.llm.toxicity import toxicity

ORACLE_SQL = None  # classifiers and packing can't be expressed in SQL


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(name).alias("y"))


def _free(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column has."""
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def _key() -> Column:
    """The id, or for a null id a number from 2**62 on made from the text."""
    made = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), 2) + F.lit(1 << 62)
    return F.coalesce(F.col("doc_id").cast("long"), made)


def _accepted(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], rejected: int) -> DataFrame:
    """docs without those to which the operator gives the rejected verdict."""
    key = _free(docs, "pipeline_key")
    dropped = operator(docs.withColumn("doc_id", _key())).where(F.col("predicted") == rejected).select(F.col("doc_id").alias(key))
    return docs.withColumn(key, _key()).join(dropped, key, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _accepted(docs, lambda keyed: toxicity(keyed, _labels(spark, sf_dir, "toxic")), rejected=1)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _accepted(docs, lambda keyed: quality(keyed, _labels(spark, sf_dir, "quality")), rejected=0)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, hashed = _free(docs, "pipeline_key"), _free(docs, "pipeline_text")
    text = F.col("text").cast("string")
    keyed = docs.withColumns({key: _key(), hashed: F.xxhash64(text)})
    found = minhash_components(keyed, shingle=5, similarity_percent=80, id_col=key)
    copies = found.where("not kept").select(key, F.col("text_hash").alias(hashed)).distinct()
    unnamed = F.col("doc_id").isNull() & ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    ordered = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = keyed.where(~unnamed).join(copies, [key, hashed], "left_anti").groupBy(key, hashed).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*ordered)).alias("row"))
    return one.select("row.*").unionByName(keyed.where(unnamed).select(*docs.columns))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs, dictionary_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near-dedup", drop_near_copies), ("secrets", remove_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as tables:  # what a stage has written goes once its result is there
            docs = materialise(stage(spark, docs, sf_dir), name)
            tables.keep(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
