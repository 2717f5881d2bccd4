"""Every fixture query against its SQL on DuckDB, as the driver compares them."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__
from typeloom.plans import fixtures, programs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, list | np.ndarray):
        return str([plain(y) for y in x])
    return "nan" if x is None else str(x) if not isinstance(x, int | np.integer) or isinstance(x, bool) else int(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [*fixtures.SQL, *programs.SQL])
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(__spark_entry__.oracle_sql()[name]).df())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["source", "n", "c", "pass_at_1", "pass_at_3"] and df.count() > 0


@pytest.mark.parametrize("n", [1, 4, 17])
def test_partitions_change_nothing(spark, n):
    from pyspark.sql import functions as F

    from typeloom.operators import curate, packing

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.transform(F.split("text", " "), lambda x: F.length(x)).alias("ids"))
    one = packing.constant_length(docs, "ids", "doc_id", 512, -1, seed=3).select("chunk", F.md5(F.concat_ws(",", "input_ids")).alias("m"))
    two = packing.constant_length(docs.repartition(n), "ids", "doc_id", 512, -1, seed=3).select("chunk", F.md5(F.concat_ws(",", "input_ids")).alias("m"))
    assert sorted(one.collect()) == sorted(two.collect())
    assert [r.doc_id for r in curate.sample_exact(docs, 20, "doc_id", 1).collect()] == [r.doc_id for r in curate.sample_exact(docs.repartition(n), 20, "doc_id", 1).collect()]
