"""Every query of the engine against its SQL on the smallest tables."""

import os

import pytest

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


def shown(v):
    if v is None or str(v) in ("NaT", "<NA>", "nan", "None"):
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
        return f"{float(v) + 0.0:.9g}"
    return str(v)[:10] if str(v).endswith("00:00:00") else str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(shown(v) for v in r) for r in df.itertuples(index=False))


def names():
    from tidemark.plans import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from tidemark.plans import QUERIES, SQL

    got = QUERIES[name](spark, D).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=here, check=True)


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    from tidemark.plans.proxies import documents
    from tidemark.streaming import ingest

    docs = documents(spark, D)
    docs.write.parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # the second run sees the same files again
        stream = ingest.read_documents(spark, str(tmp_path / "in"), docs.schema)
        ingest.ingest(stream, str(tmp_path / "docs"), str(tmp_path / "daily"), str(tmp_path / checkpoint)).awaitTermination()
        kept = spark.read.parquet(str(tmp_path / "docs"))
        assert kept.count() == kept.select("doc_id").distinct().count()
        daily = spark.read.parquet(str(tmp_path / "daily")).agg({"doc_cnt": "sum"}).first()[0]
        assert daily == kept.where("published_utc IS NOT NULL").count()
