"""A store that grows: whole appends only, ids that go on, files by group."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pairloom.plans import retrieve
from pairloom.sources import growing_store as gs
from pairloom.sources.files import Taken


def vectors(spark, low, high):
    df = spark.range(low, high).select(F.col("id").alias("name"), (F.col("id") % 5).cast("int").alias("grp"))
    return df.withColumn("vector", F.array(*[((F.col("name") * (7 + i)) % 31).cast("float") for i in range(4)]))


@pytest.fixture
def store(spark, tmp_path):
    schema = vectors(spark, 0, 1).withColumn("vec_id", F.col("name")).schema
    return gs.create_growing(spark, str(tmp_path / "store"), schema, "grp", 3)


def test_appends_go_on_and_failed_ones_are_not_seen(spark, store):
    assert store.table().count() == 0 and store.directory().count() == 0
    one = store.append(vectors(spark, 0, 60), "name", unique=True)
    one.write_generation(vectors(spark, 500, 600).withColumn("vec_id", F.col("name")))  # and no commit
    two = gs.open_growing(spark, store.path).append(vectors(spark, 60, 100), "name", unique=True)
    assert (one.version, two.version, two.next_id) == (1, 2, 100)
    assert two.table().filter("vec_id != name").count() == 0 and two.table().count() == 100
    assert gs.open_growing(spark, store.path, 1).table().count() == 60
    queries = vectors(spark, 0, 100).filter("name % 9 = 0").withColumnRenamed("name", "query_id")
    whole = vectors(spark, 0, 100).withColumnRenamed("name", "vec_id")
    wanted = sorted(retrieve.search(whole, queries, 3, "grp").collect())
    assert sorted(retrieve.search_growing(two, queries).collect()) == wanted
    three = two.compact(1_000)
    assert len(three.generations) == 1 and sorted(retrieve.search_growing(three, queries).collect()) == wanted
    assert three.compact(1_000) is three and sorted(two.table().collect()) == sorted(three.table().collect())
    with pytest.raises(ValueError):
        two.vacuum()
    assert len(three.vacuum()) == 3
    assert sorted(retrieve.search_growing(gs.open_growing(spark, store.path), queries).collect()) == wanted


def test_of_two_appends_at_a_time_one_is_made_again(spark, store):
    other = gs.open_growing(spark, store.path)
    store.append(vectors(spark, 0, 10), "name", unique=True)
    with pytest.raises(Taken):
        other.append(vectors(spark, 10, 20), "name", unique=True)
    assert gs.open_growing(spark, store.path).append(vectors(spark, 10, 20), "name", unique=True).table().count() == 20
    assert not [n for n in os.listdir(f"{store.path}/manifests") if "json." in n and not n.endswith(".crc")]


def test_only_files_with_wanted_groups_are_read(spark, store):
    grown = store.append(vectors(spark, 0, 60), "name", unique=True).append(vectors(spark, 60, 90), "name", unique=True)
    wanted = spark.createDataFrame([(2,), (2,), (None,), (77,)], "grp int")
    files = grown.files_of(wanted)
    rows = grown.rows_of(wanted)
    assert 0 < len(files) < len(grown.files_of(vectors(spark, 0, 5)))
    assert {f.split("generations/")[1] for f in rows.inputFiles()} == {f.split("generations/")[1] for f in files}
    assert rows.filter("grp = 2").count() == 18
    counts = {r["grp"]: r["n"] for r in grown.directory().groupBy("grp").agg(F.sum("rows").alias("n")).collect()}
    assert counts == {g: 18 for g in range(5)}
    assert grown.rows_of(spark.createDataFrame([(77,)], "grp int")).count() == 0


def test_rows_without_a_group_and_empty_appends(spark, store):
    odd = vectors(spark, 0, 6).withColumn("grp", F.when(F.col("name") > 3, F.col("grp")))
    grown = store.append(odd, "name", unique=True).append(vectors(spark, 0, 0), "name", unique=True)
    assert grown.table().count() == 6 and grown.table().filter("grp IS NULL").count() == 4
    with pytest.raises(Taken):
        gs.create_growing(spark, store.path, store.schema, "grp", 3)
    with pytest.raises(ValueError):
        gs.open_growing(spark, store.path + "-none")
