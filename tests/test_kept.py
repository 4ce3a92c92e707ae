"""What is kept between jobs: vocabularies, row indexes, finished parts, counts of a stream."""

from __future__ import annotations

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from pairloom import stand_ins
from pairloom.operators import ledger, row_index, tokens
from pairloom.plans import embed
from pairloom.sources import vocabularies
from pairloom.sources.bitext import write_bitext
from pairloom.streaming.curate_stream import curate_stream, stream_counts


@pytest.fixture
def words(spark):
    return spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", None, "b"]), (3, None)], "id int, tokens array<string>")


def test_a_kept_vocabulary_gives_the_same_ids(spark, words, tmp_path):
    path = str(tmp_path / "voc'abulary")
    built = tokens.build_vocabulary(words, "tokens")
    vocabularies.save_vocabulary(built, path, 4)
    other = spark.newSession()  # another catalog
    opened = vocabularies.open_vocabulary(other, path)
    assert (opened.size, opened.reserved, opened.n_bytes) == (built.size, built.reserved, built.n_bytes)
    again = other.createDataFrame(words.collect(), words.schema)
    for shared in (True, False):
        ours, kept = (sorted(map(str, tokens.encode(d, "tokens", v, shared=shared).collect())) for d, v in ((words, built), (again, opened)))
        assert ours == kept
    with pytest.raises(ValueError):
        vocabularies.open_vocabulary(spark, path + "-none")


def test_the_vocabulary_side_is_not_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD_TOKENS", 0)  # all tokens are joined
    path = str(tmp_path / "vocabulary")
    df = spark.range(3000).select("id", F.array(F.concat(F.lit("w"), F.col("id") % 997)).alias("tokens"))
    kept = vocabularies.save_vocabulary(tokens.build_vocabulary(df, "tokens"), path, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        coded = tokens.encode(df, "tokens", kept, shared=False)
        plan = coded._jdf.queryExecution().executedPlan().toString()
        assert coded.select(F.countDistinct("ids")).first()[0] == 997
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    at = plan.index("Bucketed: true")
    join = plan.rindex("SortMergeJoin", 0, at)
    assert "Exchange" not in plan[max(join, plan.rindex("Exchange", 0, at) + 400) : at] or plan.count("hashpartitioning(token") == 1


def test_new_tokens_go_behind_the_old_ones(spark, words, tmp_path):
    path = str(tmp_path / "vocabulary")
    kept = vocabularies.save_vocabulary(tokens.build_vocabulary(words, "tokens"), path, 4)
    more = spark.createDataFrame([(["z", "b", "y", "z"],), (["y", "x"],)], "t array<string>")
    grown = vocabularies.save_vocabulary(vocabularies.extend_vocabulary(kept, more, "t", least=2), path, 4)
    rows = [tuple(r) for r in grown.table.sort("token_id").collect()]
    old = [tuple(r) for r in kept.table.sort("token_id").collect()]
    assert rows == old + [(6, "y", 2), (7, "z", 2)] and grown.size == 8
    assert vocabularies.open_vocabulary(spark, path).size == 8 and vocabularies.open_vocabulary(spark, path, 0).size == 6
    same = vocabularies.extend_vocabulary(grown, words, "tokens")
    assert same.size == 8 and same.table.count() == 8


def test_a_kept_index_opens_the_files_of_its_rows_only(spark, tmp_path):
    path = str(tmp_path / "index")
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit("x").alias("v")).repartition(3)
    made = row_index.index_rows(df, "k", unique=True, partitions=8, path=path)
    opened = row_index.open_index(spark.newSession(), path)
    assert opened.total == made.total == 1000 and opened.table().filter("k != row_idx").count() == 0
    one = opened.at(421)
    assert [r["k"] for r in one.collect()] == [421] and len(one.inputFiles()) == 1
    some = opened.between(100, 400)
    assert sorted(r["k"] for r in some.collect()) == list(range(100, 400)) and 1 < len(some.inputFiles()) < 8
    assert opened.at(1000).count() == 0 and opened.at(-1).count() == 0
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        row_index.index_rows(df, "k", unique=True, path=path)
    nothing = row_index.index_rows(df.limit(0), "k", unique=True, path=str(tmp_path / "empty"))
    assert nothing.total == 0 and nothing.table().count() == 0


def counted_model(marks: str, broken: int | None = None):
    """A model that leaves a mark for each source it sees, and breaks at one of them."""

    def make():
        model = stand_ins.make_pair_model()

        def call(sources, targets, masks):
            for s in sources:
                if broken is not None and broken in s:
                    raise RuntimeError("broken")
                with open(f"{marks}/{s[1]}", "a") as file:
                    file.write("x")
            return model(sources, targets, masks)

        return call

    return make


def test_a_broken_run_goes_on(spark, tmp_path):
    marks, path = tmp_path / "marks", str(tmp_path / "out")
    marks.mkdir()
    rows = spark.range(60).select(
        "id", F.array(F.lit(1), F.col("id").cast("int") + 100).alias("source_ids"), F.array(F.lit(5), F.lit(6)).alias("target_ids")
    )
    encoded = embed.EncodedPairs(rows, None)
    part = {r["id"]: r["p"] for r in rows.select("id", F.pmod(F.xxhash64("id"), F.lit(6)).alias("p")).collect()}
    last = next(i for i in range(60) if part[i] == 5)
    with pytest.raises(Exception, match="broken"):
        embed.embed_in_parts(encoded, "id", counted_model(str(marks), 100 + last), path, n_parts=6, at_a_time=1)
    done = ledger.finished_parts(rows, path)
    assert done == {0, 1, 2, 3, 4}
    before = {name: os.path.getsize(marks / name) for name in os.listdir(marks)}
    found = embed.embed_in_parts(encoded, "id", counted_model(str(marks)), path, n_parts=6, at_a_time=1)
    assert sorted(r["id"] for r in found.collect()) == list(range(60))
    after = {name: os.path.getsize(marks / name) for name in os.listdir(marks)}
    assert all(after[str(100 + i)] == 1 for i in range(60) if part[i] < 5) and len(after) == 60 and set(before) <= set(after)
    whole = embed.embed_pairs  # the states are those of a plain run
    plain = embed.score_pairs(rows, "source_ids", "target_ids", stand_ins.make_pair_model)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.select(*found.columns).collect())) and whole
    with pytest.raises(ValueError, match="begun with"):
        ledger.run_parts(rows, "id", lambda x: x, path, n_parts=7)
    assert ledger.run_parts(rows.limit(0), "id", lambda x: x, str(tmp_path / "none"), n_parts=3).collect() == []


def test_a_replayed_batch_counts_once(spark, tmp_path):
    given, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    rows = [("Hello there, my friend", "a"), ("ok", "b"), (None, "c"), ("123 456 789 0 a b", "d"), ("Another good sentence", None)]
    write_bitext(spark.createDataFrame(rows, "english string, german string").coalesce(1), given, ["english", "german"])
    curate_stream(spark, given, out, marks).awaitTermination()
    wanted = {"kept": 1, "letter_spread": 1, "null_source": 1, "null_target": 1, "nonletter_ratio": 1}
    counted = lambda: {r["outcome"]: r["n"] for r in stream_counts(spark, out).collect()}
    first = counted()
    assert sum(first.values()) == 5 and set(first) <= set(wanted)
    # The batch was written, but its end was not recorded: it is run again.
    for commit in glob.glob(f"{marks}/commits/*") + glob.glob(f"{marks}/commits/.*"):
        os.remove(commit)
    curate_stream(spark, given, out, marks).awaitTermination()
    assert counted() == first
    read = spark.read.option("header", True).option("escape", '"').csv(out)
    assert read.count() == 5 and {r["outcome"]: r["count"] for r in read.groupBy("outcome").count().collect()} == first
    shutil.copy(glob.glob(f"{given}/part-*.csv")[0], f"{given}/more.csv")
    curate_stream(spark, given, out, marks).awaitTermination()
    assert counted() == {o: 2 * n for o, n in first.items()}
