from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import neighbours
from pairloom.functions import vectors as vec
from pairloom.plans import retrieve

FORMS = {
    "scan": {},
    "cells": {"broadcast_queries": 0},
    "small cells": {"broadcast_queries": 0, "block_rows": 7},
}
each_form = pytest.mark.parametrize("form", FORMS)


def frame(spark, matrix, groups=None, id_name="vec_id", kind="float", first=0):
    rows = [
        (first + i, [float(x) for x in v], int(groups[i]) if groups is not None else 0) for i, v in enumerate(matrix)
    ]
    return spark.createDataFrame(rows, f"{id_name} long, vector array<{kind}>, grp_id long")


def brute(matrix, queries, k, groups=None, q_groups=None):
    found = {}
    matrix, queries = np.asarray(matrix, np.float32).astype(float), np.asarray(queries, np.float32).astype(float)
    for q, query in enumerate(queries):
        gap = ((matrix - query) ** 2).sum(axis=1)
        allowed = [i for i in range(len(matrix)) if groups is None or groups[i] == q_groups[q]]
        best = sorted(allowed, key=lambda i: (gap[i], i))[:k]
        found[q] = [(i, round(gap[i], 6)) for i in best]
    return {q: hits for q, hits in found.items() if hits}


def hits(df):
    found = {}
    for r in df.sort("query_id", "rank").collect():
        assert r["rank"] == len(found.get(r["query_id"], [])) + 1
        found.setdefault(r["query_id"], []).append((r["vec_id"], round(r["distance"], 6)))
    return found


@each_form
def test_against_brute_force_with_ties(spark, form):
    rng = np.random.default_rng(2)
    matrix = rng.integers(-2, 3, (90, 4))  # coarse, so many distances tie
    queries = rng.integers(-2, 3, (25, 4))
    got = neighbours.search(frame(spark, matrix), frame(spark, queries, id_name="query_id"), 4, **FORMS[form])
    assert hits(got) == brute(matrix, queries, 4)


@each_form
@pytest.mark.parametrize("partitions", [1, 13])
def test_groups_of_very_uneven_size(spark, form, partitions):
    rng = np.random.default_rng(3)
    groups = np.where(rng.random(120) < 0.5, 1, rng.integers(2, 30, 120))  # one group holds half
    q_groups = np.where(rng.random(50) < 0.5, 1, rng.integers(2, 40, 50))  # some have no vectors
    matrix, queries = rng.normal(size=(120, 8)), rng.normal(size=(50, 8))
    got = neighbours.search(
        frame(spark, matrix, groups).repartition(partitions),
        frame(spark, queries, q_groups, "query_id").repartition(partitions),
        3,
        group="grp_id",
        **FORMS[form],
    )
    assert hits(got) == brute(matrix, queries, 3, groups, q_groups)


@each_form
def test_many_copies(spark, form):
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(60, 6))
    matrix[rng.permutation(60)[:30]] = 0.25
    got = neighbours.search(frame(spark, matrix), frame(spark, matrix, id_name="query_id"), 3, **FORMS[form])
    assert hits(got) == brute(matrix, matrix, 3)


def test_copies_beyond_k_are_dropped_before_distances():
    ids = np.array([5, 1, 9, 3, 7])
    matrix = np.array([[1, 2], [1, 2], [1, 2], [1, 2], [3, 4]], np.float32)
    kept = neighbours._without_spare_copies(np.zeros(5, np.int64), ids, matrix, 2)
    assert sorted(ids[kept]) == [1, 3, 7]
    apart = neighbours._without_spare_copies(np.array([0, 0, 1, 1, 0]), ids, matrix, 2)
    assert sorted(ids[apart]) == [1, 3, 5, 7, 9]


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e17])
def test_rounding_of_the_matrix_product_is_covered(spark, scale):
    # Vectors far from the origin and very near each other: a float32 product alone is wrong.
    rng = np.random.default_rng(5)
    matrix = np.float32(scale) * (100 + rng.normal(size=(300, 16)).astype(np.float32) * 1e-3)
    got = hits(neighbours.search(frame(spark, matrix), frame(spark, matrix[:40], id_name="query_id"), 3))
    expected = brute(matrix, matrix[:40], 3)
    assert {q: [v for v, _ in h] for q, h in got.items()} == {q: [v for v, _ in h] for q, h in expected.items()}


def test_forms_agree_on_double_vectors(spark):
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(80, 5))
    df, asked = frame(spark, matrix, kind="double"), frame(spark, matrix, id_name="query_id", kind="double")
    results = [hits(neighbours.search(df, asked, 5, **limits)) for limits in FORMS.values()]
    assert results[0] == results[1] == results[2]
    assert all(h[0] == (q, 0.0) for q, h in results[0].items())


@each_form
def test_fewer_vectors_than_k_and_no_vectors(spark, form):
    df = frame(spark, [[1.0, 0.0], [0.0, 1.0]])
    asked = frame(spark, [[1.0, 0.0], [2.0, 0.0]], groups=[0, 8], id_name="query_id")
    found = neighbours.search(df, asked, 3, group="grp_id", **FORMS[form])
    assert hits(found) == {0: [(0, 0.0), (1, 2.0)]}
    matrix = neighbours.result_matrix(found, 3, asked).sort("query_id").collect()
    missing = neighbours.MISSING_DISTANCE
    assert [tuple(r) for r in matrix] == [(0, [0.0, 2.0, missing], [0, 1, -1]), (1, [missing] * 3, [-1] * 3)]
    assert neighbours.search(df.filter("false"), asked, 3, **FORMS[form]).count() == 0
    assert neighbours.search(df, asked.filter("false"), 3, **FORMS[form]).count() == 0


@each_form
def test_a_vector_that_is_not_finite_is_no_neighbour(spark, form):
    df = frame(spark, [[1.0], [float("nan")], [float("inf")], [2.0]])
    assert hits(neighbours.search(df, frame(spark, [[0.0]], id_name="query_id"), 4, **FORMS[form])) == {0: [(0, 1.0), (3, 4.0)]}


@each_form
def test_a_row_without_a_group_meets_nothing(spark, form):
    df = frame(spark, [[1.0], [2.0], [3.0]], groups=[1, 1, 2])
    df = df.withColumn("grp_id", F.when(F.col("vec_id") > 0, F.col("grp_id")))
    found = neighbours.search(df, df.withColumnRenamed("vec_id", "query_id"), 3, group="grp_id", **FORMS[form])
    assert hits(found) == {1: [(1, 0.0)], 2: [(2, 0.0)]}


@each_form
def test_mixed_dimensions_fail(spark, form):
    df = frame(spark, [[1.0, 2.0], [1.0]])
    with pytest.raises(Exception, match="one dimension"):
        neighbours.search(df.coalesce(1), frame(spark, [[1.0, 2.0]], id_name="query_id"), 1, **FORMS[form]).collect()
    with pytest.raises(Exception, match="dimension 2"):
        retrieve.search_all(df, 2).collect()


@each_form
def test_integer_tiny_and_too_long_vectors(spark, form):
    rng = np.random.default_rng(4)
    whole = rng.integers(-9, 9, (60, 5))
    for kind, matrix in (("int", whole), ("float", (whole * 1e-22).astype(np.float32))):
        df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], f"vec_id long, vector array<{kind}>")
        found = hits(neighbours.search(df, df.withColumnRenamed("vec_id", "query_id"), 3, **FORMS[form]))
        exact = ((matrix[:, None].astype(float) - matrix[None].astype(float)) ** 2).sum(axis=2)
        for q, got in found.items():
            assert [i for i, _ in got] == np.lexsort((np.arange(60), exact[q]))[:3].tolist()
    long = spark.createDataFrame([(0, [1e200]), (1, [1.0])], "vec_id long, vector array<double>")
    with pytest.raises(Exception, match="too long"):
        neighbours.search(long, long.withColumnRenamed("vec_id", "query_id"), 1, **FORMS[form]).collect()


def test_limits_go_by_bytes(spark, monkeypatch):
    df = frame(spark, np.random.default_rng(5).normal(size=(40, 4)))
    queries = df.withColumnRenamed("vec_id", "query_id")
    wanted = hits(neighbours.search(df, queries, 3))
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 16 * 7)
    found = neighbours.search(df, queries, 3)
    assert "FlatMapCoGroups" in found._jdf.queryExecution().executedPlan().toString() and hits(found) == wanted


def test_dimension_check(spark):
    df = frame(spark, [[1.0, 2.0], [1.0]]).unionByName(
        spark.createDataFrame([(7, None, 0), (8, [1.0, None], 0)], "vec_id long, vector array<float>, grp_id long")
    )
    good, bad = neighbours.check_dimension(df, "vector", 2)
    assert [r["vec_id"] for r in good.collect()] == [0]
    assert sorted(r["vec_id"] for r in bad.collect()) == [1, 7, 8]


def test_normalize(spark):
    df = frame(spark, [[3.0, 4.0], [0.0, 0.0]])
    unit = [r["vector"] for r in retrieve.normalized(df).sort("vec_id").collect()]
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1] == [0.0, 0.0]
    pair = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    assert pair.select(vec.squared_l2(F.col("a"), F.col("b"))).first()[0] == 25.0


def test_added_vectors_go_on_from_the_highest_id(spark):
    base = frame(spark, [[1.0], [2.0]], first=10)
    new = spark.createDataFrame([("b", [3.0], 0), ("a", [4.0], 0)], "name string, vector array<float>, grp_id long")
    grown = neighbours.add_vectors(base.withColumn("name", F.lit("old")), new, "name")
    assert {r["vec_id"]: r["vector"][0] for r in grown.collect()} == {10: 1.0, 11: 2.0, 12: 4.0, 13: 3.0}
    first = neighbours.add_vectors(base.withColumn("name", F.lit("")).filter("false"), new, "name")
    assert sorted(r["vec_id"] for r in first.collect()) == [0, 1]


def test_search_first_finds_itself(spark):
    found = hits(retrieve.search_first(frame(spark, np.random.default_rng(7).normal(size=(20, 4))), 3))
    assert sorted(found) == [0, 1, 2] and all(h[0] == (q, 0.0) for q, h in found.items())


def test_a_query_meets_near_regions_only(spark):
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(4000, 2)).astype(np.float32)
    groups = np.where(np.arange(4000) < 3900, 1, 2)  # the second one fits a block
    df = frame(spark, matrix, groups).withColumnRenamed("grp_id", "grp")
    asked = df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    candidates = neighbours._many(df, asked, 3, 100, 8)
    # All blocks of a group gave three rows each for every query: 39 * 3 of them.
    assert candidates.count() < 200 * 3 * 5
    found = neighbours.search(df, asked, 3, group="grp", broadcast_queries=0, block_rows=100)
    near = brute(matrix, matrix[::20], 3, groups, groups[::20])
    assert hits(found) == {q * 20: got for q, got in near.items()}


def test_masses_of_copies_in_a_crowded_group(spark):
    rng = np.random.default_rng(9)
    matrix = rng.integers(0, 2, (600, 2)) * [1, 3]  # four points
    matrix = np.concatenate([matrix, rng.normal(size=(50, 2)), [[np.nan, 0.0]]])
    df = frame(spark, matrix)
    asked = df.filter("vec_id % 10 = 0 AND vec_id < 650").withColumnRenamed("vec_id", "query_id")
    found = neighbours.search(df, asked, 4, broadcast_queries=0, block_rows=40)
    near = brute(matrix[:650], matrix[:650:10], 4)
    assert hits(found) == {q * 10: got for q, got in near.items()}


def test_no_vector_within_reach_is_in_a_region_left_out():
    rng = np.random.default_rng(10)
    for matrix in (rng.normal(size=(500, 3)), rng.integers(0, 3, (500, 3)).astype(float), np.ones((500, 3))):
        groups = rng.integers(0, 3, 500)
        regions = neighbours._Regions(groups, matrix, 20)
        leaves = regions.leaf(groups, matrix)
        queries, q_groups, reach = rng.normal(size=(80, 3)), rng.integers(0, 3, 80), rng.random(80)
        rows, near = regions.near(q_groups, queries, reach)
        met = set(zip(rows.tolist(), near.tolist()))
        assert len(met) == len(rows) and (np.diff(rows) >= 0).all()
        gap = ((queries[:, None] - matrix[None]) ** 2).sum(axis=2)
        for q, v in zip(*np.nonzero((gap <= reach[:, None]) & (q_groups[:, None] == groups[None]))):
            assert (q, leaves[v]) in met
        for leaf in np.flatnonzero(regions.stuck):
            assert len(np.unique(matrix[leaves == leaf], axis=0)) == 1


@pytest.mark.parametrize("name", ["knn_grouped", "knn_grouped_cells", "knn_stored"])
def test_grouped_searches_ask_with_every_vector(spark, tmp_path, name):
    from pairloom.registry import QUERIES

    dice = np.random.default_rng(4)
    matrix = dice.normal(size=(70, 64)).astype(np.float32)
    rows = [(i + 1, matrix[i].tolist(), i % 3) for i in range(70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {}
    for r in QUERIES[name](spark, str(tmp_path)).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert sorted(found) == [v for v, _, _ in rows]
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    for i in range(70):
        own = [j for j in range(70) if j % 3 == i % 3]
        nearest = sorted(own, key=lambda j: (((unit[i] - unit[j]) ** 2).sum(), j))[:3]
        assert found[i + 1] == {n: j + 1 for n, j in enumerate(nearest, 1)}


def test_datastore_lookup_asks_with_every_entry(spark, tmp_path):
    from pairloom.registry import QUERIES

    turns = [(c, t, ("user", "assistant")[t % 2], f"one two three word{c % 4} and then some more") for c in range(12) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["datastore_lookup"](spark, str(tmp_path))
    entries = QUERIES["datastore_build"](spark, str(tmp_path)).count()
    first = [(r["query_id"], r["distance"]) for r in found.filter("rank = 1").collect()]
    assert entries > 50 and sorted(first) == [(i, 0.0) for i in range(entries)]
