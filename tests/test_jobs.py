from __future__ import annotations

import glob
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import stand_ins
from pairloom.operators import datastore, tokens
from pairloom.plans import curate, embed, retrieve
from pairloom.scratch import drop_scratch, scratch_path, write_scratch
from pairloom.sources import bitext, vector_tables
from pairloom.streaming.curate_stream import curate_stream

CSV = 'english,german\n"Good day, sir",Guten Tag\nHello,Hallo\n,leer\nNA,leer\n"two\nlines here",zwei\nab cde..........,x\nfine words,\n'
COUNTS = {"kept": 2, "null_source": 2, "null_target": 1, "letter_spread": 1, "nonletter_ratio": 1}
KEPT = [("Good day, sir", "Guten Tag"), ("two\nlines here", "zwei")]


def test_curation(spark, tmp_path):
    (tmp_path / "in.csv").write_text(CSV)
    out = str(tmp_path / "out")
    assert curate.curate_bitext(spark, str(tmp_path / "in.csv"), out) == COUNTS
    assert sorted(map(tuple, bitext.read_bitext(spark, curate.kept_path(out)).collect())) == KEPT
    assert len(glob.glob(f"{out}/outcome=letter_spread/*.csv")) >= 1


def test_streamed_curation_takes_each_file_once(spark, tmp_path):
    source, out, marks = (str(tmp_path / d) for d in ("in", "out", "marks"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(CSV)
    curate_stream(spark, source, out, marks).awaitTermination()
    (tmp_path / "in" / "b.csv").write_text("english,german\nmore good words,mehr\n")
    for _ in range(2):
        curate_stream(spark, source, out, marks).awaitTermination()
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    counts = {r["outcome"]: r["count"] for r in reader.csv(out).groupBy("outcome").count().collect()}
    assert counts == {**COUNTS, "kept": 3}


def test_datastore_keys_are_the_states_before_their_tokens(spark):
    df = spark.createDataFrame(
        [(1, [90, 5, 6, 7, 1], [[0.0], [1.0], [2.0], [3.0], [4.0]], [30, 31, 32, 33, 34])],
        "id int, ids array<int>, states array<array<float>>, groups array<int>",
    )
    rows = datastore.datastore_entries(df, ["id"], "groups", "ids", "states", special_ids=[1, 90]).collect()
    assert [tuple(r) for r in rows] == [(32, 1, 2, [1.0], 6), (33, 1, 3, [2.0], 7)]
    rows = datastore.datastore_entries(df, ["id"], "groups", "ids", "states").collect()
    assert [(r["key_vector"][0], r["value_token_id"]) for r in rows] == [(0.0, 5), (1.0, 6), (2.0, 7), (3.0, 1)]


def test_built_store_is_laid_out_by_group(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a b c", "x y z w"), (2, "c a", "z x")], "id int, source string, target string")
    encoded = embed.encode_pairs(pairs)
    path = str(tmp_path / "store")
    on_disk = embed.build_datastore(encoded, "id", stand_ins.make_pair_model, path=path, n_buckets=4)
    held = embed.build_datastore(encoded, "id", stand_ins.make_pair_model)
    assert sorted(map(str, on_disk.select(*held.columns).collect())) == sorted(map(str, held.collect()))
    group = held.first()["group_token_id"]
    found = vector_tables.read_groups(spark, path, "group_token_id", [group])
    assert found.count() == held.filter(F.col("group_token_id") == group).count() > 0


def test_group_lookup_prunes_buckets_and_pushes_the_group(spark, tmp_path):
    path = str(tmp_path / "grouped")
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).cast("int").alias("g"))
    vector_tables.write_grouped(df, path, "g", 8)
    assert spark.read.parquet(path).count() == 2000
    found = vector_tables.read_groups(spark, path, "g", [7, 9])
    assert found.count() == df.filter("g in (7, 9)").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(g, [7,9])" in plan


def test_stored_search_reads_the_buckets_of_its_queries(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(400).select(
        F.col("id").alias("vec_id"), (F.col("id") % 20).alias("g"), F.array(F.col("id").cast("float")).alias("vector")
    )
    vector_tables.write_grouped(df, path, "g", 8)
    queries = df.filter("g in (3, 4)").withColumnRenamed("vec_id", "query_id")
    read = vector_tables.read_groups_of(spark, path, "g", queries)
    assert read.count() == 40
    assert re.search(r"PartitionFilters: \[[^]]*bucket#", read._jdf.queryExecution().executedPlan().toString())
    found = retrieve.search_store(path, queries, "g", k=2).collect()
    assert len(found) == 80 and all((r["vec_id"] == r["query_id"]) == (r["rank"] == 1) for r in found)
    assert {abs(r["vec_id"] - r["query_id"]) for r in found if r["rank"] == 2} == {20}
    plan = retrieve.search_store(path, queries, "g", k=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") <= 1 or "AdaptiveSparkPlan" in plan
    for n in (4, 16, 64):  # the store says how many buckets it has
        other = f"{path}-{n}"
        vector_tables.write_grouped(df, other, "g", n)
        assert len(retrieve.search_store(other, queries, "g", k=2).collect()) == 80


def test_a_store_without_its_number_of_buckets_fails(spark, tmp_path):
    plain = str(tmp_path / "plain")
    df = spark.range(10).select("id", (F.col("id") % 3).alias("g"))
    df.write.parquet(plain)
    mixed = str(tmp_path / "mixed")
    vector_tables.write_grouped(df, mixed, "g", 2)
    vector_tables.write_grouped(df, mixed, "g", 3, mode="append")
    for path in (plain, mixed):
        with pytest.raises(ValueError, match="not one store"):
            vector_tables.read_groups(spark, path, "g", [1])


def test_a_hot_group_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "hot")
    df = spark.range(0, 40000, 1, 8).select("id", F.lit(1).alias("g"), F.array_repeat(F.rand(1), 16).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200kb")
    try:
        vector_tables.write_grouped(df, path, "g", 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(glob.glob(f"{path}/n_buckets=4/bucket=*/*.parquet")) > 2
    assert spark.read.parquet(path).count() == 40000


def test_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    vector_tables.write_shards(spark.range(1000), path, 10, "id")
    assert sorted(glob.glob(f"{path}/shard=*")) == sorted(f"{path}/shard={i}" for i in range(10))
    assert spark.read.parquet(path).select("id").distinct().count() == 1000


def test_a_large_shard_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "shards")
    df = spark.range(0, 40000, 1, 8).select("id", F.array_repeat(F.rand(1), 16).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200kb")
    try:
        vector_tables.write_shards(df, path, 2, "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert all(len(glob.glob(f"{path}/shard={i}/*.parquet")) > 2 for i in range(2))
    assert spark.read.parquet(path).count() == 40000


def test_an_unknown_token_keeps_its_place_in_the_store(spark):
    known = tokens.build_vocabulary(
        spark.createDataFrame([("x y z w",)], "t string").select(F.split("t", " ").alias("tokens")), "tokens",
        reserved=(tokens.PAD, tokens.END, tokens.UNKNOWN, "<src>", "<tgt>"),
    )
    pairs = spark.createDataFrame([(1, "x", "x NEW z w")], "id int, source string, target string")
    encoded = embed.encode_pairs(pairs, vocabulary=known)
    ids = encoded.table.first()["target_ids"]
    source, target = (np.array(x) for x in (encoded.table.first()["source_ids"], ids))
    states = stand_ins.make_pair_model()([source], [target], [np.ones_like(source)])[1][0].tolist()
    store = {r["pos"]: r for r in embed.build_datastore(encoded, "id", stand_ins.make_pair_model).collect()}
    assert sorted(store) == [2, 3, 4] and ids[2] == 2
    assert all(r["key_vector"] == states[pos - 1] and r["value_token_id"] == ids[pos] for pos, r in store.items())


def test_clean_files_without_header_and_streams_by_name(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "a longer line", "x"), (2, "q", "y")]
    bitext.write_bitext(spark.createDataFrame(rows, "id int, english string, german string").coalesce(1), source)
    assert curate.curate_bitext(spark, source, out, header=False)["kept"] == 1
    (name,) = glob.glob(f"{curate.kept_path(out)}/*.csv")
    assert open(name).read() == '"a longer line","x"\n'
    streamed = str(tmp_path / "streamed")
    curate_stream(spark, source, streamed, str(tmp_path / "marks")).awaitTermination()
    found = spark.read.option("header", True).csv(streamed).select("outcome", "english", "german").collect()
    assert sorted(map(tuple, found)) == [("kept", "a longer line", "x"), ("letter_spread", "q", "y")]


def test_scratch_lives_in_the_configured_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    df = write_scratch(spark.range(5), "t")
    assert df.count() == 5
    (file,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert drop_scratch(spark) >= 2
    assert not glob.glob(file.removeprefix("file://"))
