import pytest

from gleaner.operators import results
from gleaner.operators.export import export_text, lines
from gleaner.operators.kernel import FINDINGS


def make(spark, rows):
    return spark.createDataFrame([(g, v, e, s, o, "b", "a", c, 1) for g, v, e, s, o, c in [(*r, [])[:6] for r in rows]], FINDINGS)


def test_dedup_fold_dashboard(spark):
    f = make(spark, [("g", "v", "Base64", "s", 5), ("g", "v", "ASCII", "s", 5), ("g", "v", "ASCII", "s", 9), ("g", "v", "ASCII", "a", 7), ("g", "w", "ASCII", "s", None)])
    d = results.dedup(f)
    assert sorted((r["source"], r["offset"] or -1, r["encoding"]) for r in d.collect()) == [("a", 7, "ASCII"), ("s", -1, "ASCII"), ("s", 5, "ASCII"), ("s", 9, "ASCII")]
    once = {r["value"]: (r["source"], r["offset"], r["occurrences"]) for r in results.fold(d).collect()}
    assert once == {"v": ("a", 7, 3), "w": ("s", None, 1)}
    assert {r["value"]: r["occurrences"] for r in results.fold(results.fold(d)).collect()} == {"v": 3, "w": 1}
    board = {(r["kind"], r["name"]): r["findings"] for r in results.dashboard(d).collect()}
    assert board == {("total", ""): 4, ("group", "g"): 4, ("source", "s"): 3, ("source", "a"): 1, ("encoding", "ASCII"): 4}
    assert [r["value"] for r in results.ordered(d).collect()][0] == "w"


def test_compare_and_new(spark):
    old, new = make(spark, [("g", "A", "ASCII", "s", 1), ("g", "C", "ASCII", "s", 3)]), make(spark, [("g", "A", "ASCII", "t", 2), ("g", "B", "ASCII", "s", 1)])
    assert {(r["status"], r["value"]) for r in results.compare(old, new).collect()} == {("unchanged", "A"), ("added", "B"), ("removed", "C")}
    assert [r["value"] for r in results.new_only(new, old).collect()] == ["B"]


def test_ignore_search_view(spark):
    f = make(spark, [("a.Site.com", "http://a.Site.com/x", "ASCII", "s", 1), ("b.com", "http://b.com/TRACK", "ASCII", "s", 2), ("c.com", "http://c.com/z", "ASCII", "q", 3), ("notsite.com", "http://notsite.com", "ASCII", "s", 4)])
    rules = results.IgnoreRules.parse("# c\n\n site.com\n*track\n=http://none/\n")
    assert rules.groups == ("site.com",) and {r["group"] for r in results.ignore(f, rules).collect()} == {"c.com", "notsite.com"}
    assert results.hidden_count(f, rules).first()["hidden"] == 2
    assert {r["group"] for r in results.search(f, "Q").collect()} == {"c.com"} and results.search(f, "").count() == 4
    assert [r["group"] for r in results.view(f, make(spark, [("c.com", "http://c.com/z", "ASCII", "s", 3)]), rules, "com").collect()] == ["notsite.com"]


def test_download_hosts(spark):
    d = "Download URL"
    f = make(spark, [
        ("a.com", "https://a.com/dl/win/index.html", "ASCII", "s [heap]", 1), ("b.com", "https://b.com/other/x", "ASCII", "s", 2), ("c.com", "http://c.com/tie/1", "ASCII", "s", 3), ("e.com", "http://e.com/tie/2", "ASCII", "s", 4),
        (d, "/dl/win/setup.exe", "ASCII", "s", 5), (d, "/nowhere/x.zip", "ASCII", "s", 6), (d, "/tie/x.zip", "ASCII", "s", 7), (d, "b.com/z/q.zip", "ASCII", "s", 8), (d, "/dl/win/setup.exe", "ASCII", "t", 9),
    ])
    got = {(r["source"], r["offset"]): (r["value"], [c["value"] for c in r["captures"]]) for r in results.resolve_download_hosts(f).collect()}
    assert len(got) == 9 and got["s", 5] == ("https://a.com/dl/win/setup.exe", ["/dl/win/setup.exe", "https://a.com/dl/win/index.html"])
    assert got["s", 6][0] == "/nowhere/x.zip" and got["s", 7][0] == "/tie/x.zip" and got["t", 9][0] == "/dl/win/setup.exe"
    assert got["s", 8][0] == "https://b.com/z/q.zip"


def test_export(spark):
    f = make(spark, [("g", '=1+"x"', "ASCII", "s", 255, [("n", "v"), ("m", "w")]), ("g", "z\x01", "Hex", "s", None)])
    assert export_text(f, "txt") == 'g  (2)\r\n\r\nz\x01\r\n=1+"x"  @0xFF\r\n'
    assert export_text(f, "csv").split("\r\n")[2] == '"g","\'=1+""x""","ASCII","s","255","b","a","n=v; m=w"'
    import json

    data = json.loads(export_text(f, "json"))
    assert data[1]["captures"] == {"n": "v", "m": "w"} and data[0]["offset"] is None and data[0]["value"] == "z\x01"
    assert [r["line"] for r in lines(f, "plain").collect()][2:] == ["z\x01", '=1+"x"']
    with pytest.raises(ValueError):
        lines(f, "xml")


def test_empty(spark):
    f = spark.createDataFrame([], FINDINGS)
    assert results.fold(results.dedup(f)).count() == 0 and results.resolve_download_hosts(f).count() == 0
    assert results.dashboard(f).count() == 0 and results.hidden_count(f, results.IgnoreRules()).first()["findings"] == 0
