"""Queries that leave no rows or labels of their table out; their values are held against SQL in test_queries."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_erp_baseline_of_all_vectors(spark):
    got = {r.vec_id for r in entry.queries()["erp_baseline_all"](spark, SF).select("vec_id").distinct().collect()}
    assert got == {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


def test_accllr_and_correlations_of_all_labels(spark):
    q, e = entry.queries(), spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    for name in ("accllr_cumulative_all", "accllr_levels_all"):
        assert {r.vec_id for r in q[name](spark, SF).collect()} == {r.vec_id for r in e}
    alt = {r.vec_id for r in e if r.label < 5}
    assert {r.vec_id for r in q["accllr_latency_all"](spark, SF).collect()} <= alt
    n = len({r.label for r in e})
    assert sum(r.n for r in q["correlation_over_distance_all"](spark, SF).collect()) == n * (n - 1) // 2


def test_tfr_mean_of_all_vectors(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        want.setdefault(r.label, []).extend(r.embedding[8:24])
    got = {r.label: r.power for r in entry.queries()["tfr_mean_all"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - sum(v) / len(v)) < 1e-6 for k, v in want.items())


def test_vector_geometry_of_whole_vectors(spark):
    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {r.vec_id: r.distance for r in entry.queries()["vector_geometry_halves"](spark, SF).collect()}
    assert got.keys() == e.keys()
    for i, v in e.items():
        h = len(v) // 2
        assert abs(got[i] - sum((float(x) - float(y)) ** 2 for x, y in zip(v[:h], v[h:], strict=True)) ** 0.5) < 2e-6
