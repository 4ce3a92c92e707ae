from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom.functions import arrays as ar
from pairloom.operators import batching, row_index


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_row_index_does_not_depend_on_partitions(spark, partitions):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(partitions)
    index = row_index.index_rows(df, "k", unique=True)
    assert index.total == 1000
    assert index.table().filter("k != row_idx").count() == 0
    assert [r["k"] for r in index.at(421).collect()] == [421]
    assert sorted(r["k"] for r in index.between(395, 610).collect()) == list(range(395, 610))
    assert index.between(1000, 2000).count() == 0


def test_descending_order_and_ties(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), "id").repartition(5)
    rows = row_index.index_rows(df, F.col("g").desc(), "id", name="n").table().sort("n").collect()
    assert [(r["g"], r["id"]) for r in rows] == sorted(((i % 3, i) for i in range(300)), key=lambda p: (-p[0], p[1]))


def test_ties_are_broken_alike_for_any_partitioning(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), "id")
    numbered = [
        {r["id"]: r["row_idx"] for r in row_index.index_rows(df.repartition(n), "k").table().collect()} for n in (2, 7)
    ]
    assert numbered[0] == numbered[1]
    assert sorted(numbered[0].values()) == list(range(500))


def test_copies_are_spread_over_ranges(spark):
    # One row in three is the same whole row; no range gets them all.
    df = spark.range(0, 30000, 1, 12).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    index = row_index.index_rows(df, "k", partitions=12)
    assert index.total == 30000
    assert max(rows for _, _, rows in index.spans) < 0.2 * 30000
    positions = index.table().agg(F.countDistinct("row_idx"), F.min("row_idx"), F.max("row_idx")).first()
    assert tuple(positions) == (30000, 0, 29999)


def test_numbering_by_key_keeps_other_columns_and_null_keys(spark):
    df = spark.createDataFrame([("b", "x", 1), (None, "y", 2), ("a", "z", 3), ("a", None, 4)], "k string, l string, v int")
    rows = row_index.number_rows(df, "k", "l", unique=True)
    assert rows.columns == ["k", "l", "v", "row_idx"]
    assert {r["v"]: r["row_idx"] for r in rows.collect()} == {2: 0, 4: 1, 3: 2, 1: 3}


def test_a_wrong_promise_of_unique_keys_fails(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    for number in (lambda: row_index.index_rows(df, "k", unique=True), lambda: row_index.number_rows(df, "k", unique=True)):
        with pytest.raises(ValueError, match="do not tell rows apart"):
            number()
    assert row_index.index_rows(df, F.col("k").desc(), unique=["k", "v"]).total == 3
    with pytest.raises(ValueError, match="name the columns"):
        row_index.index_rows(df, F.col("k").desc(), unique=True)


def test_ranges_follow_the_measured_size(spark, monkeypatch):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert row_index._range_count(3, usual) == 1
    assert row_index._range_count(32 << 20, usual) == usual
    assert row_index._range_count(32 << 30, usual) == 256
    # A join without statistics: the planner multiplies its sides, the measure does not.
    left = spark.range(0, 20_000, 1, 4).select("id", F.concat(F.lit("x"), "id").alias("l"))
    pairs = left.join(left.withColumnRenamed("l", "r"), "id").hint("merge")
    estimate = int(str(pairs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimate > 1 << 30
    assert len(row_index.index_rows(pairs, "id", unique=True).spans) == 1
    # A table that is large by measure gets many ranges, whatever is planned.
    monkeypatch.setattr(row_index, "RANGE_BYTES", 1 << 16)
    assert len(row_index.index_rows(pairs, "id", unique=True).spans) == 11


def test_the_measure_counts_every_kind_of_value(spark):
    df = spark.sql(
        "SELECT 1 AS a, 'abcd' AS b, array('xy', null) AS c, array(1.0D, 2.0D) AS d, map('k', 'vv') AS e, "
        "named_struct('f', 'ggg', 'h', 1L) AS s, cast(null AS string) AS n, cast(null AS array<string>) AS m"
    )
    _, measured = row_index._staged(df)
    assert measured == 8 + (4 + 8) + (8 + 10 + 8) + (2 * 8 + 8) + (8 + 9 + 8 + 10) + (8 + 11 + 8) + 8 + 8


def test_empty_table(spark):
    index = row_index.index_rows(spark.range(0), "id")
    assert index.total == 0 and index.table().count() == 0 and index.at(0).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_batches(spark, partitions):
    df = spark.range(120).select("id", F.concat(F.lit("s"), "id").alias("s")).repartition(partitions)
    batched = batching.assign_batches(df, "id", unique=True)
    lists = batching.collate(batched, ["id", "s"]).sort("batch_id").collect()
    assert [len(r["id"]) for r in lists] == [50, 50, 20]
    assert lists[1]["id"] == list(range(50, 100)) and lists[1]["s"][0] == "s50"
    assert [r["id"] for r in batching.first_batch(df, "id").collect()] == list(range(50))
    small = batching.assign_batches(df, "id", size=7)
    assert small.agg(F.max("batch_id")).first()[0] == 17


def test_padding_fixture(spark):
    df = spark.createDataFrame(
        [(0, 0, [5, 6, 2]), (0, 1, [7, 2]), (1, 0, [9, 2])], "batch_id long, pos_in_batch int, ids array<int>"
    )
    rows = batching.pad_batches(df, {"ids": 1}).sort("batch_id", "pos_in_batch").collect()
    assert [r["ids_padded"] for r in rows] == [[5, 6, 2], [7, 2, 1], [9, 2]]
    assert [r["ids_attention"] for r in rows] == [[1, 1, 1], [1, 1, 0], [1, 1]]
    shapes = batching.batch_shapes(df, "ids").sort("batch_id").collect()
    assert [(r["n_rows"], r["longest"]) for r in shapes] == [(2, 3), (1, 2)]


def test_array_helpers(spark):
    df = spark.createDataFrame([([10, 5, 6, 2, 1], [1, 0, 0, 1, 1])], "ids array<int>, mask array<int>")
    ids, mask = F.col("ids"), F.col("mask")
    got = df.select(
        ar.compress(ids, mask),
        ar.special_tokens_mask(ids, [10, 2, 1]),
        ar.from_end(ids),
        ar.at(ids, 1),
        ar.at(ids, 9),
        ar.shifted_entries(ids, ids),
    ).first()
    assert list(got[:5]) == [[5, 6], [1, 0, 0, 1, 1], 1, 5, None]
    assert [tuple(e) for e in got[5]] == [(1, 10, 5, 10), (2, 5, 6, 5), (3, 6, 2, 6), (4, 2, 1, 2)]
    empty = spark.createDataFrame([([],), ([3],)], "ids array<int>")
    assert [r[0] for r in empty.select(ar.shifted_entries(ids, ids)).collect()] == [[], []]


def test_gather_and_first(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 5, "z")], "k int, pos int, v string")
    assert {r["k"]: r["v"] for r in batching.gather_positions(df, "k", "pos", "v").collect()} == {1: ["a", "b", "c"], 2: ["z"]}
    first = batching.first_per_group(df, "k", F.col("pos"), "pos", "v").collect()
    assert {r["k"]: (r["pos"], r["v"]) for r in first} == {1: (0, "a"), 2: (5, "z")}


def test_gathered_positions_with_gaps(spark):
    """Nulls keep their places, and what is shuffled is lists of positions and of values, not of pairs."""
    rows = [(1, 2, "c"), (1, 0, "a"), (1, 1, None), (2, None, "x"), (2, None, None), (3, 5, None), (None, 1, "z"), (1, 1, "b")]
    df = spark.createDataFrame(rows, "k int, pos int, v string").repartition(3)
    gathered = batching.gather_positions(df, "k", "pos", "v")
    assert {r["k"]: r["v"] for r in gathered.collect()} == {1: ["a", None, "b", "c"], 2: [], 3: [None], None: ["z"]}
    plan = gathered._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(" in plan and "collect_list(struct" not in plan and "THEN struct(" not in plan and "THEN named_struct(" not in plan


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint", "double", "string"])
def test_gathered_positions_of_any_type(spark, kind):
    """Order is that of the column's type, equal positions go by value, and whole numbers are not shuffled whole."""
    spread = {"tinyint": (-128, -1, 0, 5, 127), "string": (0, 1, 255, 256, 9), "double": (-0.5, 0.25, 300.0, -300.5)}
    places = spread.get(kind, (-70_000, -257, -256, -1, 0, 1, 127, 128, 255, 256, 257, 65_535, 65_536))
    rows = [(k, str(p), f"{k} {p}") for k in (1, None) for p in places] + [(1, "0", "b"), (1, "0", "a"), (1, "1", None), (1, None, "x"), (2, None, None)]
    df = spark.createDataFrame(rows, "k int, pos string, v string").withColumn("pos", F.col("pos").cast(kind)).repartition(3)
    expected = {}
    for r in df.collect():
        expected.setdefault(r["k"], []).extend([] if r["pos"] is None else [(r["pos"], r["v"] is not None, r["v"] or "")])
    gathered = batching.gather_positions(df, "k", "pos", "v")
    assert {r["k"]: r["v"] for r in gathered.collect()} == {k: [v if known else None for _, known, v in sorted(e)] for k, e in expected.items()}
    plan = gathered._jdf.queryExecution().optimizedPlan().toString()
    assert ("shiftright" in plan) == (kind not in ("double", "string"))


def test_gathered_vectors_and_nested_positions(spark):
    df = spark.createDataFrame([(1, (300,), [1.0]), (1, (-2,), [2.0]), (1, (299,), None)], "k int, at struct<pos:int>, v array<double>")
    assert [r["v"] for r in batching.gather_positions(df, ["k"], "at.pos", "v").collect()] == [[[2.0], None, [1.0]]]
    assert batching.gather_positions(df.limit(0), "k", "at.pos", "v").collect() == []
