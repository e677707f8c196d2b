"""The queries and SQL of the corpus operators, by the names that __spark_entry__.py registers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, jaccard, langid, licenses, linededup, media, mixing, pivots, rnnlm, sharding
from .shared import documents


def tokenizer() -> bytes:
    """The tokenizer file, read on the driver."""
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()


def op1_media(spark, sf_dir):
    return media.text_media(documents(spark, sf_dir))


def op2_lines(spark, sf_dir):
    out = linededup.dedup_units(documents(spark, sf_dir))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["length"])), ",")
    return out.select("doc_id", "n_units", "n_removed", spans.alias("removed"), "text")


def op3_bpe(spark, sf_dir):
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer())


def op4_shards(spark, sf_dir):
    out = sharding.byte_shards(documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op6_mixing(spark, sf_dir):
    out, _ = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_pivots(spark, sf_dir):
    return pivots.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_licenses(spark, sf_dir):
    out = licenses.scan_licenses(documents(spark, sf_dir))
    span = F.transform("findings", lambda f: F.concat_ws(":", f["license"], f["start"], f["length"], f["saved"], f["differences"]))
    names = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["license"])))
    return out.select("doc_id", F.size("findings").cast("long").alias("n_found"), F.array_join(names, ",").alias("licenses"), F.array_join(span, ";").alias("spans"))


def op9_lm(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 7
    scorer, counts = rnnlm.build(docs, fold != 2)
    out = rnnlm.score_documents(docs, scorer, counts)
    return out.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", F.lit(scorer.n).cast("long").alias("train_tokens"), "base_score", "score")


def op10_langid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 4
    out = langid.identify(docs, langid.train(docs))
    return out.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def queries():
    return {f.__name__: f for f in (op1_media, op2_lines, op3_bpe, op4_shards, op5_jaccard, op6_mixing, op7_pivots, op8_licenses, op9_lm, op10_langid)}


def oracle_sql():
    return {"op2_lines": linededup.SQL, "op5_jaccard": jaccard.SQL, "op7_pivots": pivots.SQL}
