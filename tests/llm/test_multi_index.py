"""Exact with all cells; recall with the shares in use; special rows."""

from __future__ import annotations

import numpy as np
import pytest

from pairloom.llm import multi_index as mi

SF_DIR = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, cell int"


def brute(rows, queries, k):
    """Rows are (id, vector) that take part; nearest by score and id."""
    out = {}
    for query, q in queries:
        scored = sorted((-float(np.sum(np.array(v, float) * np.array(q, float))), i) for i, v in rows if i != query)
        out[query] = [(i, pytest.approx(-s)) for s, i in scored[:k]]
    return out


def found_by(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [4_096, 7])
def test_all_cells_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(mi, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # a heap of copies: ties by id
    odd = [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] + [1.0] * 5), (2004, [float("inf")] * 6), (2005, [1.0, 2.0]), (None, [1.0] * 6)]
    good = [r for r in rows if any(r[1])]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd + rows[:3]], SCHEMA)
    queries = table.filter("vec_id % 20 = 0")
    found = found_by(mi.search(table, queries, k=20, centroids=4, share=1.0))
    assert found == brute(good, [r for r in good if r[0] % 20 == 0], 20)


def test_few_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 1.0], 1)], SCHEMA)
    assert found_by(mi.search(table, table, k=20)) == {0: [(1, 1.25), (2, 1.0)], 1: [(0, 1.25), (2, 1.0)], 2: [(0, 1.0), (1, 1.0)]}
    assert mi.search(table.limit(0), table, k=3).collect() == [] and mi.search(table, table.limit(0), k=3).collect() == []


def recalled(table, found):
    wanted = mi.exact(table.toPandas(), np.array(list(found)))
    return sum(len({i for i, _ in found[q]} & set(ids)) for q, ids in wanted.items()) / sum(map(len, wanted.values()))


def test_recall(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    found = found_by(mi.search(table, table.filter("vec_id % 20 = 0")))
    assert len(found) == 100 and recalled(table, found) >= 0.9


def test_structure_is_searched_by_few_entries(spark, monkeypatch):
    """Clustered vectors: a few per cent of the entries hold nine in ten of the neighbours."""
    rng, shares, real = np.random.default_rng(3), [], mi._share_for
    monkeypatch.setattr(mi, "_share_for", lambda *a: shares.append(real(*a)) or shares[-1])
    centres = rng.normal(size=(60, 16)) * 4
    points = centres[rng.integers(0, 60, 6_000)] + rng.normal(size=(6_000, 16)) * 0.3
    table = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], "vec_id long, embedding array<float>, cell int")
    found = found_by(mi.search(table, table.filter("vec_id % 60 = 0")))
    assert len(found) == 100 and recalled(table, found) >= 0.9
    assert shares[0] < 0.1
