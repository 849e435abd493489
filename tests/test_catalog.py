"""The driver contract, and a sample of the catalogue against its SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["stride_splits", "split_gain", "tree_predict", "affinity_targets", "truth_components", "max_spanning_forest", "watershed",
          "malis_gradient", "pooled_fscore", "rand_index", "stencil_forest"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def test_contract(spark):
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    own = {name for name in queries if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(sql) == {"gaussian_bank", "image_spanning_forest", "adaptive_rand_threshold", "malis_sampled_loss", "malis_boost"}
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("lineitem", "embeddings", "documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    answer = con.execute(contract.oracle_sql()[name])
    names = [column[0] for column in answer.description]
    order = sorted(names)
    want = sorted((tuple(row[names.index(c)] for c in order) for row in answer.fetchall()), key=repr)
    df = contract.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == order
    assert sorted((tuple(row[c] for c in order) for row in df.collect()), key=repr) == want
