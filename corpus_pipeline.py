"""The corpus pipeline: language ID, near-duplicates, repeated lines, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Defined cases: documents whose text is null or has no letter leave at the first stage. Rows with a null or a repeated id
are rows like any other; line dedup leaves those with a null id as they are. Empty input gives empty output. Extra columns
leave at the third stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.llm import bpe, jaccard, langid, linededup, mixing
from gleaner.llm.queries import tokenizer
from gleaner.llm.shared import documents, materialize

ROW = "pipeline_row"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark, docs, sf_dir):
    """Keep the documents that have a language; operator 10. Clean prose of a known language scores far above the bound."""
    return langid.keep_identified(docs, langid.train(docs), least=0.35)


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of near-duplicates stays, the one with the least id (null last); operator 5, shingles of five
    words, similarity 0.8. Rows are told apart by all their columns, so rows that share an id, or have none, but differ in
    text stay unless a row like them does."""
    rows = docs.withColumn(ROW, F.xxhash64(*COLUMNS))
    groups = jaccard.jaccard_components(rows, id_col=ROW, words=5, num=80, den=100)
    ranks = rows.select(ROW, "doc_id").distinct().join(groups.select(ROW, "component_id").distinct(), ROW)
    kept = ranks.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)


def repeated_lines(spark, docs, sf_dir):
    """Lines and passages of 50 words that stand earlier in the corpus go, and documents of which nothing is left; operator 2."""
    out = linededup.dedup_units(docs, keep=["lang", "source"]).withColumn("n_chars", F.length("text").cast("long"))
    return out.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def mix_sources(spark, docs, sf_dir):
    """Each document's text is what the mix takes of it, in blocks of 64 words; operator 6."""
    _, pieces = mixing.mix(docs, keep=["lang"])
    out = mixing.mixed_texts(docs, pieces, keep=["lang"])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark, docs, sf_dir):
    """Token ids of each whole text, decoded again; operator 3."""
    return bpe.encode_documents(docs, tokenizer(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_lines", repeated_lines),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: Trained models, connected components and pseudorandom draws have no SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
