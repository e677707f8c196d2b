"""Each stage on its own input, and the whole."""

import numpy as np

import corpus_pipeline as cp
from gleaner.llm import mixing

from test_texts import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_lines", "mix_sources", "tokens"]
    first = cp.language_id(spark, docs, SF)
    assert first.columns == docs.columns and first.count() >= 0.97 * docs.count()
    second = cp.near_duplicates(spark, first, SF)
    groups = brute_components([(r["doc_id"], r["text"]) for r in first.collect()], 5, 80, 100)
    assert sorted(r["doc_id"] for r in second.collect()) == sorted({c for _, c in groups.values()})
    third = cp.repeated_lines(spark, second, SF)
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    lines = {rows[n][0]: t for n, t in brute_lines(rows, 25, 50).items()}
    assert {r["doc_id"]: r["text"] for r in third.collect()} == {i: t for i, t in lines.items() if t.split()}
    fourth = cp.mix_sources(spark, third, SF)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(third, keep=["lang"])[0].collect() if r["taken"]}
    assert {r["doc_id"]: len(r["text"].encode().split()) for r in fourth.collect()} == taken
    assert all(r["n_chars"] == len(r["text"]) for r in fourth.collect()) and set(fourth.columns) == set(cp.COLUMNS)
    last = cp.tokens(spark, fourth, SF)
    assert all(len(np.frombuffer(bytes(r["ids"]), "<u4")) == r["n_tokens"] for r in last.collect())


def test_edges(spark, edges, empty):
    counts = []
    docs = edges
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, None)
        counts.append(docs.count())
        assert name == "tokens" or set(docs.columns) >= set(cp.COLUMNS)
    assert counts[0] == 5 and counts[1] == 4 and counts[2] == 4 and 1 <= counts[3] == counts[4] <= 4
    for name, stage in cp.STAGES:
        assert stage(spark, empty, None).count() == 0, name
    kept = sorted((r["doc_id"] or 0 for r in cp.near_duplicates(spark, edges, None).collect()))
    assert kept == [0, 1, 2, 3, 4, 7, 8]  # a null id and texts without words stay; of equal texts the least id


def test_rows_of_one_id(spark, docs):
    one, other, more = "one text of some words that is here", "quite another text of other words there", "no id at all but a text of its own"
    rows = docs([(1, one, "en", "a"), (1, other, "en", "a"), (2, one, "en", "a"), (None, more, "en", "a"), (None, other, "en", "a"), (None, one + " with more words behind", "en", "b")])
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in cp.near_duplicates(spark, rows, None).collect())
    assert kept == sorted([(1, one), (1, other), (0, more), (0, one + " with more words behind")])
