from quarry.operators import search as S
from quarry.plans import queries as Q


def test_blocks_and_due_ids(spark, tmp_path):
    rows = [(i, [float(i % 7 + 1), float(i % 11), float(i % 13)]) for i in range(301)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    d.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.knn_batch(spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == set(range(0, 301, 50)) and len(got) == 7 * 5
    v = d.selectExpr("vec_id id", "embedding vector")
    q = v.selectExpr("id query_id", "vector query_vector").filter("query_id < 10")
    assert sorted(S.nearest_batch(v, q, block=3).collect()) == sorted(S.nearest_batch(v, q).collect())
