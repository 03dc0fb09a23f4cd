"""The corpus operators as queries over whole tables; oracle_sql() has DuckDB SQL where SQL can express the rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, oracles
from .bpe import byte_bpe
from .centroids import hamerly_clusters
from .common import forget_at_exit, shared_dir, table
from .infill import fill_in_middle, restored
from .lattice import lattice_scores, read_pieces
from .minhash import minhash_components
from .neighbours import near_vectors
from .packing import added_tokens, best_fit_pack
from .quality import quality
from .topk import exact_topk
from .secrets import secret_findings
from .sharding import ShardStore
from .toxicity import toxicity
from .training import fold


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"), dictionary_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as small shards, are compacted, and are read from the committed version: each row with its shard."""
    store = ShardStore(spark, forget_at_exit(f"{shared_dir(spark)}/llm-shards-{uuid.uuid4().hex}"))
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum()
    shard = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return store.read().select("doc_id", F.crc32("text").alias("text_crc32"), shard.alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(store.version()).alias("version"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_findings(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("y"))
    scored = quality(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), shingle=2).drop("text_hash")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("y"))
    scored = toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the same vocabulary as byte_bpe_50k.json, as ranks
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return best_fit_pack(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, added=added)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a vocabulary's pieces and word counts come from documents outside the fold held out; all are scored."""
    remainder = fold("doc_id", 7)
    return lattice_scores(table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")), held_out=remainder == 2, learned=remainder != 2)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly_clusters(table(spark, sf_dir, "embeddings")).drop("scans")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scans, op2_byte_bpe, op3_sharding, op4_license_scans, op5_quality_classifier, op6_minhash_near_dedup, op7_toxicity, op8_best_fit_packing, op9_embedding_near_dedup, op10_exact_topk, op11_lm_scoring, op12_centroid_clustering, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scans": licenses.oracle(), "op6_minhash_near_dedup": oracles.COMPONENTS, "op10_exact_topk": oracles.TOPK, "op12_centroid_clustering": oracles.clusters(), "op13_fill_in_middle": oracles.INFILL}
