"""The corpus operators as registered queries, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, centroids, licenses, manifest, mixing, near_vectors, ngram_join, packing, pieces, pii, substrings, toxicity, urls
from .common import table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe())


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).alias("held_out")
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out, "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, threshold=(9, 10))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_digest(*centroids.cluster_vectors(table(spark, sf_dir, "embeddings")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    made = manifest.build(docs, check=F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    return manifest.verify(made).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_texts(table(spark, sf_dir, "documents"), piece_bpe())
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return pieces.decode_ids(encoded, piece_bpe()).select("doc_id", "n_tokens", digest("ids"), digest("decoded"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_near_vectors": op2_near_vectors,
        "op3_substrings": op3_substrings,
        "op4_licenses": op4_licenses,
        "op5_urls": op5_urls,
        "op6_mixing": op6_mixing,
        "op7_toxicity": op7_toxicity,
        "op8_pii": op8_pii,
        "op9_ann": op9_ann,
        "op10_ngram_join": op10_ngram_join,
        "op11_centroids": op11_centroids,
        "op12_manifest": op12_manifest,
        "op13_pieces": op13_pieces,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_urls": urls.ORACLE, "op6_mixing": mixing.ORACLE, "op11_centroids": centroids.oracle(), "op12_manifest": manifest.ORACLE}
