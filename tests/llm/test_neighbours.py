import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenframe.llm.neighbours import Forest, nearest, op10_hash_prefix_forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, qid, q, k):
    d = np.sqrt(((x - q) ** 2).sum(1))
    d[ids == qid] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[o]), float(d[o])) for o in order if np.isfinite(d[o])]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3_000, 32)).astype(np.float32)
    x[100:200] = x[100] + 0.01 * rng.standard_normal((100, 32))
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    rows = nearest(df, F.col("id") % 100 == 0, 10, block_rows=1_000).collect()
    ids, xd = np.arange(3_000), x.astype(float)
    hits = 0
    for q in range(0, 3_000, 100):
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        assert all(r["score"] == pytest.approx(np.sqrt(((xd[r["vec_id"]] - xd[q]) ** 2).sum()), abs=1e-12) and r["vec_id"] != q for r in mine)
        hits += len({r["vec_id"] for r in mine} & {v for v, _ in brute(ids, xd, q, xd[q], 10)})
    assert hits / 300 >= 0.9


def test_candidates_share_the_longest_prefixes():
    x = np.random.default_rng(1).standard_normal((500, 16))
    f = Forest(np.arange(500), x, trees=4, bits=12)
    strings = f.codes[:, 0]
    first = f.candidates(strings, 1)
    assert {int(f.order[t, 0]) for t in range(4)} & set(first.tolist())
    assert len(f.candidates(strings, 100)) >= 100 and len(f.candidates(strings, 500)) == 500


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (100, [1.0, 0.0], 0), (1, [1.0, 0.0], None), (2, [0.0, 1.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [1.0], 0), (None, [1.0, 1.0], 0), (200, [0.0, 0.0], 0), (9, [], 0), (2, [0.0, 1.0], 0), (-100, [0.5, 0.5], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit(1), "block": F.lit(2), "id": F.lit(3), "x": F.lit(4)})
    out = nearest(df, F.col("id") % 100 == 0, 10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in out if r["query_id"] == 0] == [(0, 1), (0, 100), (0, -100), (0, 2)]
    assert {r["query_id"] for r in out} == {0, 100, -100}
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0, 10).count() == 0


def test_op10_columns(spark):
    assert op10_hash_prefix_forest(spark, "/root/testdata/sf0.001").columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_op10_recall_on_the_test_tables(spark, sf):
    """Of all queries, against all rows."""
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").to_pydict()
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"], np.float32).astype(float)
    found = {}
    for r in op10_hash_prefix_forest(spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    queries = ids[ids % 100 == 0].tolist()
    hits = 0
    for q in queries:
        best = dict(brute(ids, x, q, x[ids == q][0], 10))
        hits += len(best.keys() & found[q].keys())
        assert all(found[q][v] == pytest.approx(best[v], abs=1e-12) for v in best.keys() & found[q].keys()) and len(found[q]) == 10
    assert hits / (10 * len(queries)) >= 0.9
