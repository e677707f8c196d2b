import io
import struct

import pytest
from pyspark.sql import functions as F

from gleaner import cli, sql
from gleaner.operators.kernel import FINDINGS
from gleaner.plans import presets
from gleaner.plans.options import FileSelection, Job, OptionError, Options
from gleaner.plans.control import cancel, cancellable
from gleaner.sources.files import observed, scan_chunks, scan_paths, unreadable
from gleaner.sources.inspect import hex_lines
from gleaner.sources.spans import label_offsets, pe_sections, plan_spans, read_sections
from gleaner.sources.store import Store
from gleaner.streaming.live import watch


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "ignored").mkdir()
    (tmp_path / "one.TXT").write_bytes(b"x http://one.site.com/a " + b"." * 300 + b" http://far.site.com/b ")
    (tmp_path / "two.bin").write_bytes(b"http://two.site.com/a ")
    (tmp_path / "ignored" / "three.txt").write_bytes(b"http://three.site.com/a ")
    return str(tmp_path)


def values(df):
    return {(r["value"], r["offset"]) for r in df.collect()}


def test_files(spark, tree):
    chosen = FileSelection(include="*.txt", exclude="ignored", min_size=5)
    assert values(scan_paths(spark, [tree], selection=chosen)) == {("http://one.site.com/a", 2), ("http://far.site.com/b", 325)}
    assert len(values(scan_paths(spark, [tree]))) == 4
    assert values(scan_paths(spark, [tree], selection=FileSelection(include="one*", range_start=10, range_end=400))) == {("http://far.site.com/b", 325)}


def test_chunks_do_not_depend_on_the_window(spark, tree):
    for window in (64, 200, 1 << 20):
        assert values(scan_chunks(spark, tree, window=window, overlap=64, perTask=2)) == values(scan_paths(spark, [tree]))
    bad = spark.read.format("bytechunks").load(f"{tree}/none")
    assert unreadable(bad).first()["source"] == f"{tree}/none"


def test_progress_and_cancel(spark, tree):
    import threading
    import time

    rows, seen = observed(spark.read.format("bytechunks").load(f"{tree}/one.TXT,{tree}/none"))
    rows.count()
    assert seen.get == {"bytes": 347, "windows": 1, "unreadable": 1}
    stopped = []

    def work():
        try:
            with cancellable(spark, "slow"):
                spark.range(0, 4, 1, 2).mapInArrow(lambda batches: (time.sleep(20) or b for b in batches), "id long").count()
        except Exception as e:
            stopped.append(e)

    t = threading.Thread(target=work)
    t.start()
    for _ in range(100):
        time.sleep(0.2)
        cancel(spark, "slow")
        if not t.is_alive():
            break
    t.join(30)
    assert stopped


def test_spans_and_sections(spark):
    spans = spark.createDataFrame([("p", 0, 100, True, "heap"), ("p", 200, 100, True, ""), ("p", 400, 50, False, "x")], "source string, base long, size long, readable boolean, label string")
    assert [(r["base"], r["size"]) for r in plan_spans(spans, 10, 0, 120).orderBy("base").collect()] == [(10, 90), (200, 30)]
    f = spark.createDataFrame([("g", "v", "ASCII", "p", 99, "", "", [], 1), ("g", "v", "ASCII", "p", 150, "", "", [], 1)], FINDINGS)
    assert sorted(r["source"] for r in label_offsets(f, spans, 64).collect()) == ["p", "p [heap]"]
    image = bytearray(0x200)
    image[:2], image[0x80:0x84] = b"MZ", b"PE\0\0"
    struct.pack_into("<I", image, 60, 0x80)
    struct.pack_into("<H", image, 0x86, 1)
    struct.pack_into("<H", image, 0x94, 40)
    struct.pack_into("<I", image, 0x80 + 56, 0x1000)
    struct.pack_into("<8sIII", image, 0x80 + 24 + 40, b".text", 0x1234, 0x1000, 0)
    assert read_sections(bytes(image)) == [(".text", 0x1000, 0x3000)] and read_sections(b"MZ") == []
    assert pe_sections(spark.createDataFrame([("f", bytes(image)), ("n", None)], "source string, data binary")).count() == 1


def test_inspector(spark):
    rows = hex_lines(spark.createDataFrame([(1, b"0123456789abcdef\x00xyz")], "id int, d binary"), "d", 3, 40, ["id"]).collect()
    assert [(r["offset"], r["ascii"]) for r in rows] == [("000000000000", "0123456789abcdef"), ("000000000010", ".xyz")] and rows[1]["hex"] == "00 78 79 7A"


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    f = spark.createDataFrame([("g", "KEY-42", "ASCII", "s", 1, "", "", [("a", "b")], 1)], FINDINGS)
    a, b = s.save_session(f, "one", "x"), s.save_session(f.withColumn("value", F.lit("KEY-43")), "two", "x")
    assert [r["id"] for r in s.sessions().collect()] == [b, a] == [2, 1] and s.load_session(a).collect() == f.collect()
    assert {(r["status"], r["value"]) for r in s.compare_sessions(a, b).collect()} == {("added", "KEY-43"), ("removed", "KEY-42")}
    with pytest.raises(OptionError):
        s.load_session(9)
    s.save_job(Job("b", ("/x",)))
    s.save_job(Job("A", ("/y",)))
    s.save_job(Job("b", ("/z",)))
    assert [r["name"] for r in s.jobs().collect()] == ["A", "b"] and s.load_job("b").sources == ("/z",)
    s.set_favorite("source", "q")
    s.set_favorite("source", "p")
    s.set_favorite("source", "q", False)
    assert [r[0] for r in s.favorites("source").collect()] == ["p"]
    s.set_ignore_rules(["b", "a"])
    assert [r["rule"] for r in s.ignore_rules().collect()] == ["b", "a"]


def test_presets(tmp_path):
    p = presets.UserPreset("Tickets", "two\nlines", r"\bTKT-[0-9]{6}\b", "TKT-123456", "ABC-1", hex=True)
    path = str(tmp_path / "p.ini")
    presets.save(path, [p])
    presets.save(path, [p, presets.UserPreset("Mail", custom=False, email=True, regex="x")])
    assert presets.parse("\ufeff" + presets.render([p])) == [p] and presets.example_failures(p) == []
    o = presets.profile(presets.load(path))
    assert o.presets == ("email",) and o.custom == p.regex and o.custom_label == "Tickets" and o.hex
    open(path, "w").write("[broken")
    assert presets.load(path) == [p]
    presets.save(path, [p])
    assert presets.parse(open(path + ".bak").read()) == [p]
    for bad in ("Regex=x", "[Regex User Preset: a]\nASCII=1", "[Regex User Preset: a]\nRegex=x\nRegex=y", "[Regex User Preset: a]\nRegex=x\nASCII=maybe", "[Regex User Preset: a]\nRegex=x\n[Regex User Preset: A]\nRegex=x", "[Regex User Preset: a]\nRegex=x\nFoo=1"):
        with pytest.raises(OptionError):
            presets.parse(bad)


def test_cli(spark, tree, tmp_path):
    out = io.StringIO()
    db = str(tmp_path / "db")
    run = lambda *a: cli.main([*a, "--db", db], spark, out)
    assert run(tree, "--include", "two*", "--save-session", "s", "--save-job", "j") == 0 and "two.site.com  (1)" in out.getvalue()
    assert run(tree, "--regex", "nothing-here") == 1 and run(tree, "--regex", "(") == 2 and run(tree + "/none") == 2 and run() == 2
    assert run(tree, "--regex", "x", "--preset", "email") == 2 and run(tree, "--scheme", "gopher") == 2 and run(tree, "--format", "xml") == 2
    assert run(tree, "--ignore", "site.com") == 1 and run("--run-job", "j", "--format", "csv") == 0 and run("--list-jobs") == 0
    assert run(tree, "--out", str(tmp_path / "o.json"), "--format", "json") == 0 and run("--open-session", "1") == 0 and run("--compare-sessions", "1", "1") == 0


def test_sql_functions(spark):
    sql.register(spark)
    rows = spark.sql("SELECT f.value, f.offset FROM VALUES ('see http://a.com/x now') t(x), LATERAL scan_text(x, 's', '{}') f").collect()
    assert [tuple(r) for r in rows] == [("http://a.com/x", 4)]


def test_live(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    sink = lambda df, n: seen.append(sorted(r["value"] for r in df.collect()))
    for i, part in enumerate([["a", "b"], ["b", "c"]]):
        spark.createDataFrame([("g", v) for v in part], "`group` string, value string").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("`group` string, value string").parquet(str(folder))
        watch(stream, str(tmp_path / "state"), sink, str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [["a", "b"], ["c"]] and Options().mode == "urls"
