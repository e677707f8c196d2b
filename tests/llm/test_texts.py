"""Lines, BPE and the Jaccard join against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import bpe, jaccard, linededup
from gleaner.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


def brute_lines(rows, min_words, run):
    """Texts by place in the list, without words that later units and later runs hold."""
    units, runs, out = set(), {}, {}
    for n, (i, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0])):
        if i is None or text is None:
            out[n] = text
            continue
        lines = text.split("\n")
        words = [w.lower() for line in lines for w in line.split()]
        gone, at = [False] * len(words), 0
        for line in lines:
            k = len(line.split())
            if k >= min_words:
                if tuple(words[at : at + k]) in units:
                    gone[at : at + k] = [True] * k
                units.add(tuple(words[at : at + k]))
            at += k
        for k in range(len(words) - run + 1):
            first = runs.setdefault(tuple(words[k : k + run]), (n, k))
            if first[0] != n or k >= first[1] + run:
                gone[k : k + run] = [True] * run
        kept, at = [], 0
        for line in lines:
            pieces = re.findall(r"\S+\s*", line)
            own = gone[at : at + len(pieces)]
            at += len(pieces)
            if not any(own):
                kept.append(line)
            elif not all(own):
                kept.append(line[: len(line) - len("".join(pieces))] + "".join(p for p, g in zip(pieces, own) if not g))
        out[n] = "\n".join(kept)
    return out


@pytest.mark.parametrize("min_words, run", [(3, 8), (6, 5), (4, 30)])
def test_lines_against_brute_force(docs, min_words, run):
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta.", "eps!", "zeta", "é", " "]
    passage = " ".join(f"p{k}" for k in range(40))
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) + (f" no{i} {passage[: rng.randint(60, 150)]} tail{i}" if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 6))), "en", "a") for i in range(120)]
    rows += [(200, passage.replace(" ", "\n") + "\n" + passage.upper(), "en", "a"), (201, "x " * 100, "en", "a"), (None, rows[3][1], "en", "a"), (202, None, "en", "a")]
    got = {r["doc_id"]: r for r in linededup.dedup_units(docs(rows), min_words=min_words, run=run).collect()}
    want = brute_lines([(i, t) for i, t, _, _ in rows], min_words, run)
    assert {i: r["text"] for i, r in got.items()} == {rows[n][0]: t for n, t in want.items()}
    for i, text, _, _ in rows:  # offsets are the original's: what is left is all but them and separators
        if text is not None:
            data, left, to = text.encode(), b"", 0
            for s in got[i]["removed"]:
                left, to = left + data[to : s["start"]], s["start"] + s["length"]
            assert (left + data[to:]).replace(b"\n", b"") == got[i]["text"].encode().replace(b"\n", b"") and got[i]["n_removed"] == len(got[i]["removed"])


def test_line_edges(docs, edges, empty):
    edge = {r["doc_id"]: r for r in linededup.dedup_units(edges, keep=["lang"], min_words=3).collect()}
    assert edge[1]["text"] is None and edge[2]["text"] == "" and edge[4]["text"] and edge[5]["text"] == "" and edge[None]["text"] == "no id at all" and edge[None]["lang"] == "fr"
    assert linededup.dedup_units(empty).count() == 0
    # rows of one id with different texts keep what doesn't repeat; equal rows of one id are one document
    rows = [(1, "the first of the lines here", "en", "a"), (2, "the first of the lines here\nand more", "en", "a"), (2, "éééé completely different words in this one", "en", "a"), (3, "a row that is twice there", "en", "a"), (3, "a row that is twice there", "en", "a")]
    out = linededup.dedup_units(docs(rows), min_words=3).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, rows[0][1]), (2, "and more"), (2, rows[2][1]), (3, rows[3][1]), (3, rows[3][1])]
    paragraphs = linededup.dedup_units(docs([(1, "one two\nthree four\n\nx", "en", "a"), (2, "y\n\none  two three four", "en", "a")]), unit="paragraph", min_words=4).collect()
    assert sorted(r["text"] for r in paragraphs) == ["one two\nthree four\n\nx", "y"]


def test_lines_against_sql(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, n_units, n_removed, text from ({linededup.SQL})").fetchall()}
    assert {r["doc_id"]: (r["n_units"], r["n_removed"], r["text"]) for r in linededup.dedup_units(d).collect()} == want


@pytest.fixture(scope="module")
def model():
    return bpe.Model(tokenizer())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(model, text, step):
    e = bpe.Encoder(model)
    data = b"".join(e.feed(text[i : i + step]) for i in range(0, len(text), step))
    return np.frombuffer(data + e.end(), "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinrstTH 'é́!<|>1中Σ\n .s"), max_size=300), st.integers(1, 50))
def test_bpe_equals_the_library(model, library, text, step):
    small, bpe.CHUNK = bpe.CHUNK, 32
    try:
        assert encoded(model, text, step) == library.encode(text, add_special_tokens=False).ids
    finally:
        bpe.CHUNK = small


def test_bpe_long_and_special(model, library):
    rng = random.Random(2)
    long = "".join(rng.choice("aeinrst") for _ in range(9000))
    for text in ["", long, "<|endoftext|>" + long + "<|startoftext|>x", "!" * 3000 + "'s", "'" * 700 + "re", "ab" * 4000]:
        want = library.encode(text, add_special_tokens=False).ids
        assert encoded(model, text, 1000) == encoded(model, text, 10**6) == want
        decoder = bpe.Decoder(model, True)
        assert "".join(decoder.feed(np.array(want[i : i + 7], np.int64)) for i in range(0, len(want), 7)) + decoder.end() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("word", ["'ll", "'re", "'ve", "'s", "'d", ".'ll", "''ll", "'l", "'lx", "x'll"])
def test_bpe_contractions_at_a_cut(model, library, word):
    """Long texts without white space are cut at a fixed place; wherever it falls in a contraction, ids are the library's."""
    cut = 2 * bpe.CHUNK - bpe.Encoder(model).tail
    for back in range(-1, len(word) + 2):
        fill = ("x." * (cut // 2 + 2))[: cut - back]
        for text in (fill + word + "y.y." * 50, fill[1:] + word + "Y." * 2 * bpe.CHUNK, fill + word):
            assert encoded(model, text, bpe.CHUNK) == library.encode(text, add_special_tokens=False).ids, (back, len(text))


def test_lookahead_is_sufficient(model):
    rng = random.Random(5)
    for _ in range(200):
        head = bytes(rng.choice(b"theaonirs") for _ in range(model.lookahead + 60))
        ends = []
        for tail in (b"", bytes(rng.choice(b"theaonirs") for _ in range(30))):
            ids, at, own = model.merge([model.first[b] for b in head + tail]), 0, []
            for i in ids:
                at += model.length[i]
                own.append(at)
            ends.append({e for e in own if e <= len(head) - model.lookahead})
        assert ends[0] == ends[1]


def test_byte_state_machine(model):
    decoder = bpe.Decoder(model, False)
    decoder.table = {i: bytes([i]) for i in range(256)}
    data = "hé中\U0001f600".encode() + b"\xff\xe4\xb8x\xf0\x9f"
    out = "".join(decoder.feed(np.array([b])) for b in data) + decoder.end()
    assert out == data.decode("utf-8", "replace")


def test_bpe_query(edges, edge_rows, empty, library):
    rows = {r["doc_id"]: r for r in bpe.encode_documents(edges, tokenizer(), with_ids=True).collect()}
    for i, text, _, _ in edge_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], bytes(rows[i]["ids"])) == (len(ids), hashlib.sha256(raw).hexdigest(), raw)
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(empty, tokenizer()).count() == 0


def brute_components(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words, num, den, fragments, unit", [(3, 90, 100, 8, 256), (5, 80, 100, 5, 3), (2, 50, 100, 1, 2)])
def test_jaccard_against_brute_force(docs, monkeypatch, words, num, den, fragments, unit):
    monkeypatch.setattr(jaccard, "UNIT", unit)
    monkeypatch.setattr(jaccard, "BLOCK", unit)
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.2 else "  ".join(text)))
    for g in range(8):  # chains: neighbours link, the ends don't; and parts of a text
        base = [rng.choice(vocabulary) for _ in range(100)]
        for k in range(6):
            rows.append((len(rows), " ".join(base[3 * k :] + [f"g{g}n{k}{i}" for i in range(3 * k)])))
        rows += [(len(rows) + k, " ".join(base[: 100 * keep // 100])) for k, keep in enumerate((91, 82, 70, 55))]
    rng.shuffle(rows)
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "one"), (len(rows) + 3, "One"), (len(rows) + 4, "one two")]
    got = jaccard.jaccard_components(docs([(i, t, "en", "a") for i, t in rows]), words=words, num=num, den=den, fragments=fragments)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, words, num, den)


def test_jaccard_against_its_sql(docs, tmp_path):
    rng = random.Random(9)
    pool = [" ".join(rng.choices("abcdefghij", k=n)) for n in (1, 2, 3, 60, 90, 120) for _ in range(4)]
    texts = pool + [t.upper() for t in pool[:9]] + [t + " zz" for t in pool] + [t + " yy zz" for t in pool] + [None, "", " ", "a  b\tc", "a b c"]
    docs([(i, t, "en", "a") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    out = jaccard.jaccard_components(docs([(i, t, "en", "a") for i, t in enumerate(texts)]))
    want = sorted(con.sql(f"select doc_id, n_shingles, component_id from ({jaccard.SQL})").fetchall())
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == want
    assert sum(a != c for a, _, c in want) > 20


def test_jaccard_edges(edges, empty, docs):
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(edges).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: None, 7: 7, 8: 8} and jaccard.jaccard_components(empty).count() == 0
    twice = jaccard.jaccard_components(docs([(1, "a b c d", "en", "a"), (1, "a b c d", "en", "a"), (None, "a b c d", "en", "a")])).collect()
    assert [r["component_id"] for r in twice] == [1, 1, 1]


@pytest.mark.parametrize("num, den", [(90, 100), (80, 100), (50, 100), (30, 100)])
def test_part_keys_lose_no_link(num, den):
    rng, linked = np.random.default_rng(8), 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        stay = rng.uniform(num / den, 1) if rng.random() < 0.5 else (num / den) + 0.01  # many of them subsets near the bound
        y = x[rng.permutation(len(x))[: max(1, round(len(x) * stay))]]
        y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, int(n * rng.random() * 0.05) if rng.random() < 0.5 else 0).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if common and den * common >= num * (len(x) + len(y) - common):
            linked += 1
            assert len(np.intersect1d(jaccard.part_keys(x, num, den), jaccard.part_keys(y, num, den)))
    assert linked > 100


@given(st.text(alphabet=st.sampled_from("aAbB é\n\t\x0b\x1c中"), max_size=80), st.integers(1, 9))
def test_word_hashes(text, chunk):
    data, old = text.encode(), jaccard.CHUNK
    whole = jaccard.word_hashes(data)
    try:
        jaccard.CHUNK = chunk
        parts = jaccard.word_hashes(data)
    finally:
        jaccard.CHUNK = old
    words = data.lower().split()
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(words) == len(whole[0])
    assert all(data[i : i + len(w)].lower() == w for i, w in zip(whole[1].tolist(), words))
    assert len(set(words)) == len(set(whole[0].tolist())) == len(set(zip(words, whole[0].tolist())))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 1 << 63, int(k)).astype(np.uint64)) for k in rng.integers(0, 900, 2))
        y = np.unique(np.concatenate([y, x[rng.random(len(x)) < rng.random()]]))
        a, b = (np.frombuffer(jaccard.sketch(h), np.uint8) for h in (x, y))
        size = min(len(a), len(b))
        assert np.bitwise_count(jaccard.folded(a, size) ^ jaccard.folded(b, size)).sum() <= len(np.setxor1d(x, y))


def test_groups_are_settled_by_rounds(spark, docs):
    """Sets of one group that don't link with its first one still find each other."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{(i // 5) * 7 + k}" if k > 30 else f"c{k}" for k in range(60)) + f" x{rng.randint(0, 1)}") for i in range(60)]
    text = {i: np.unique(jaccard.ngram_hashes(t.encode(), 2)) for i, t in rows}
    edges = np.arange(1, 4, dtype=np.uint64) * np.uint64(1 << 62)
    parts = [(i, f, len(h), int(lo), h[lo:hi].tobytes()) for i, h in text.items() for f, (lo, hi) in enumerate(zip([0, *np.searchsorted(h, edges)], [*np.searchsorted(h, edges), len(h)]))]
    parts += [(i, -1, len(h), 0, jaccard.sketch(h)) for i, h in text.items()]
    segments = spark.createDataFrame([(i, f, n, lo, bytearray(b)) for i, f, n, lo, b in parts], "x long, f int, n long, before long, grams binary").cache()
    groups = spark.createDataFrame([(0, i) for i in range(1, 60)], "anchor long, x long")
    first = jaccard.count_pairs(spark.createDataFrame([(0, i) for i in range(1, 60)], "a long, b long"), segments, 70, 100)
    from gleaner.llm.shared import materialize

    reached = jaccard._settle(groups, materialize(first, "first"), segments, 70, 100, width=1)
    got = {r["node"]: r["component"] for r in reached.collect()}
    assert {i: (0, got.get(i, i)) for i in range(60)} == {i: (0, c) for i, (_, c) in brute_components(rows, 2, 70, 100).items()}
    repeated = jaccard.jaccard_components(docs([(1, "a b c d", "en", "a"), (1, "e f g h", "en", "a"), (3, "e f g h", "en", "a"), (4, "a b c d", "en", "a")])).collect()
    assert sorted(r["component_id"] for r in repeated) == [1, 1, 1, 1]


def shuffled(spark):
    """Bytes that all stages so far wrote to shuffles."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty(30_000)
    none = gateway.jvm.java.util.ArrayList
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context.statusStore().stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none()))}


def test_jaccard_shuffles_only_texts_that_may_link(spark, docs):
    """Two near copies among texts that are like no other: the others' texts stay where they are."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.getrandbits(8000):x}" for _ in range(6))) for i in range(300)]
    rows += [(300, rows[7][1].upper()), (301, "a b c d e f g h i j k l m n o p q r s t u v w"), (302, "a b c d e f g h i j k l m n o p q r s t u v w x")]
    table, was, before = docs([(i, t, "en", "a") for i, t in rows]), spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(table).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {i: i for i in range(300)} | {300: 7, 301: 301, 302: 301}
    written = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert written < sum(len(t) for _, t in rows) / 4


@pytest.mark.parametrize("most", [1 << 27, 1 << 15])
def test_likely_rows_hold_all_that_are_wanted(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MOST", most)
    rows = spark.sql("select id, xxhash64(id) as r, 'text' as t from range(40000) union all select -1, -1, 't' union all select -2, bigint(-9223372036854775808), null")
    wanted = rows.filter("id < 0 or id % 7 = 0").select("r")
    got = [r["id"] for r in jaccard._likely(rows, wanted).collect()]
    ids = {-1, -2, *range(0, 40000, 7)}
    assert ids <= set(got) and len(got) == len(set(got)) and len(set(got) - ids) < (40000 * 0.08 if most > 1 << 15 else 40000 * 0.2)
    assert jaccard._likely(rows, wanted.limit(0)).count() == 0
