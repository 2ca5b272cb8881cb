import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from larkspur.llm.topk import products, top_k

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.IntegerType())])


def brute(rows, asked, k):
    ok = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    out = []
    for i, q in ok:
        if i in asked:
            best = sorted(((-int(q[: len(x)] @ x[: len(q)]), j) for j, x in ok if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k=20, step=20, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_k(df, df.filter(f"vec_id % {step} = 0"), k, **options).collect()))


def test_clusters_and_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.1 * rng.normal(size=(900, 16))
    x[rng.random(900) < 0.3] = x[0]  # a third are copies of one vector
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    want = brute(rows, set(range(0, 900, 20)), 20)
    assert run(spark, rows, cell_rows=40, block_rows=50, query_rows=16) == want
    assert run(spark, rows) == want


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [0.0, -1.0]), (3, []), (4, [1.0]), (5, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows, {0, 100}, 20)
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0])]) == []


def test_whole_table_by_registered_query(spark):
    from larkspur.llm.queries import queries

    got = sorted(map(tuple, queries()["op3_exact_top_k"](spark, "/root/testdata/sf0.001").collect()))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert got == brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)


@given(st.integers(0, 2**31), st.integers(1, 2**40))
@settings(max_examples=20, deadline=None)
def test_products_are_exact(seed, most):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-min(most, 2**28), min(most, 2**28), (3, 5)), rng.integers(-min(most, 2**28), min(most, 2**28), (4, 5))
    assert products(a, b).tolist() == [[int(sum(int(u) * int(w) for u, w in zip(x, y))) for y in b] for x in a]


@pytest.mark.parametrize("case", ["copies of one id", "one id in a close cell", "repeated queries"])
def test_repeated_ids_as_the_sql_has_them(spark, case):
    import duckdb
    import pyarrow as pa

    from larkspur.llm.oracles import exact_top_k

    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4)).round(3)
    rows = [(i, v) for i, v in enumerate(x.tolist(), 1)]
    if case == "copies of one id":
        rows += [(0, [3.0, 3.0, 3.0, 3.0])] * 30 + [(i, [3.0, 3.0, 3.0, 3.0]) for i in range(1000, 1030)]
    elif case == "one id in a close cell":
        rows += [(0, (9 + rng.normal(size=4) / 50).tolist()) for _ in range(40)]
    else:
        rows += [(40, rows[39][1])] + [(0, [1.0, 0.0, 0.0, 0.0])] * 2 + [(0, [0.0, -1.0, 0.0, 0.0])]
    embeddings = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    with duckdb.connect() as con:
        con.register("embeddings", embeddings)
        want = sorted(con.execute(exact_top_k()).fetchall())
    assert run(spark, rows, cell_rows=20, block_rows=50, query_rows=16) == want


def test_null_ids_and_blocks_that_many_queries_need(spark):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)] + [(None, [9.0, 9.0, 9.0, 9.0]), (1000, [1e300, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = lambda df: sorted(map(tuple, df.collect()))
    plain = key(top_k(vectors, vectors, k=3, cell_rows=50, block_rows=40))
    assert key(top_k(vectors, vectors, k=3, cell_rows=50, block_rows=40, query_rows=7)) == plain
    assert len(plain) == 900 and {r[2] for r in plain} <= set(range(300))
