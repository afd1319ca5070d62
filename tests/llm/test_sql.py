"""Queries of the subpackage against their SQL in another engine."""

import os

import duckdb
import numpy as np
import pytest
from conftest import DATA

from ramify.llm import registry


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return con


def rows(frame):
    plain = frame.astype(object).where(frame.notna(), None)
    return sorted(map(repr, map(tuple, plain.values.tolist())))


def test_links_parity(spark, tmp_path):
    """The given embeddings hold no link; here groups of near and of equal vectors are planted."""
    rng = np.random.RandomState(21)
    far, near = rng.standard_normal((200, 64)), rng.standard_normal((30, 64))
    x = np.concatenate([far, near, near.repeat(4, axis=0) + 0.08 * rng.standard_normal((120, 64)), near[:5], -near[:3]]).astype(np.float32)
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [None] + [1.0] * 63]
    values = [v.tolist() for v in x[rng.permutation(len(x))]] + odd
    frame = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<float>")
    frame.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["op3_embeddings"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(registry.SQL["op3_embeddings"]).df()
    assert want["n_links"].sum() > 600
    assert rows(got.select(*want.columns).toPandas()) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_parity(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(registry.SQL[name]).df()
    assert sorted(want.columns) == columns
    assert rows(got.select(*columns).toPandas()) == rows(want[columns])
