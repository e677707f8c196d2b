"""Every registered engine query against its SQL at the smallest scale."""

import duckdb
import pytest

from gleaner import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents pages events conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.catalogue()))
def test_query(spark, db, name, tmp_path):
    run, sql = queries.catalogue()[name]
    df = run(spark, SF)
    columns = sorted(df.columns)
    shown = ", ".join(f'"{c}"' for c in columns)
    want = sorted(db.sql(f"select {shown} from ({sql})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == want


def test_decoded_urls_of_all_lengths(spark, tmp_path):
    """Past a line of Base64 (57 bytes), with letters beyond ASCII, and longer than Java's stack takes rounds."""
    tails = ["x" * n for n in (20, 42, 43, 44, 100, 5000)] + ["utm?source=feed#" + "y" * 44, "café/中文/" + "z" * 60, "né?x=a+b/c_d-e~"]
    spark.createDataFrame([(i, f"https://a.org/{t}") for i, t in enumerate(tails)], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("decode_base64_urls", "decode_hex_urls"):
        run, sql = queries.catalogue()[name]
        got = sorted(map(tuple, run(spark, str(tmp_path)).collect()))
        assert len(got) == len(tails) and got == sorted(con.sql(sql).fetchall()), name


def test_native_and_kernel_agree(spark):
    from pyspark.sql import functions as F

    from gleaner.operators.kernel import scan_bytes
    from gleaner.operators.results import dedup
    from gleaner.operators.scan import scan_column

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    options = queries._regex("email", "ipv4", custom=r"[0-9a-f]{40}")
    pick = ["group", "value", "encoding", "source", "offset"]
    native = dedup(scan_column(docs, "text", F.col("doc_id"), options)).select(*pick)
    kernel = dedup(scan_bytes(docs.select(F.col("doc_id").alias("source"), F.col("text").cast("binary").alias("data")), options)).select(*pick)
    assert native.exceptAll(kernel).count() == 0 and kernel.exceptAll(native).count() == 0


def test_entry():
    import __spark_entry__ as e

    assert set(queries.catalogue()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
