from __future__ import annotations

from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from pairloom import registry
from pairloom.operators import tokens


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "b a b c"), (2, "a b, b! Ü"), (3, "123"), (4, None)]
    return tokens.tokenize(spark.createDataFrame(rows, "id int, text string"), "text").drop("text")


@pytest.fixture(scope="module")
def vocabulary(docs):
    return tokens.build_vocabulary(docs, "tokens")


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_vocabulary(vocabulary):
    rows = vocabulary.table.sort("token_id").collect()
    assert [tuple(r) for r in rows] == [
        (0, "<pad>", 0), (1, "</s>", 0), (2, "<unk>", 0), (3, "b", 4), (4, "a", 2), (5, "c", 1), (6, "Ü", 1),
    ]
    assert vocabulary.size == 7 and vocabulary.special_ids == [0, 1] and vocabulary.reserved_ids == [0, 1, 2]


@pytest.mark.parametrize("shared", [True, False])
@pytest.mark.parametrize("head", [0, 2, 50_000])
def test_encode_and_back(spark, docs, vocabulary, shared, head, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD_TOKENS", head)  # below it tokens are joined by shuffle
    more = docs.unionByName(spark.createDataFrame([(5, ["zzz", "a", None])], "id int, tokens array<string>"))
    encoded = tokens.encode(more, "tokens", vocabulary, shared=shared)
    assert by_id(encoded, "ids") == {1: [3, 4, 3, 5], 2: [4, 3, 3, 6], 3: [], 4: None, 5: [2, 4, 2]}
    back = tokens.ids_to_tokens(encoded, "ids", vocabulary, "back", shared=shared)
    assert by_id(back, "back") == {1: list("babc"), 2: list("abbÜ"), 3: [], 4: None, 5: ["<unk>", "a", "<unk>"]}


def test_prefix_suffix_and_decode(docs, vocabulary):
    encoded = tokens.encode(docs, "tokens", vocabulary, prefix=[0], suffix=[1])
    assert by_id(encoded, "ids") == {1: [0, 3, 4, 3, 5, 1], 2: [0, 4, 3, 3, 6, 1], 3: [0, 1], 4: None}
    decoded = tokens.batch_decode(encoded, "ids", vocabulary)
    assert by_id(decoded, "text") == {1: "b a b c", 2: "a b b Ü", 3: "", 4: None}


def test_a_null_key_keeps_its_row(spark, vocabulary):
    df = spark.createDataFrame([(None, ["a"]), (1, ["b"])], "id int, tokens array<string>")
    for shared in (True, False):
        assert by_id(tokens.encode(df, "tokens", vocabulary, shared=shared), "ids") == {None: [4], 1: [3]}


@pytest.mark.parametrize("shared", [True, False])
def test_rows_of_equal_keys_stay_apart(spark, vocabulary, shared):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (1, ["c"])], "id int, tokens array<string>")
    encoded = tokens.encode(df, "tokens", vocabulary, shared=shared)
    assert sorted(r["ids"] for r in encoded.collect()) == [[4, 3], [5], [5]]
    back = tokens.ids_to_tokens(encoded, "ids", vocabulary, "back", shared=shared)
    assert all(r["back"] == r["tokens"] for r in back.collect()) and back.columns == ["id", "tokens", "ids", "back"]


def test_joined_lookup_scans_its_input_once(spark, vocabulary, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame([("a b",), ("c",)], "text string").write.parquet(path)
    rows = tokens.tokenize(spark.read.parquet(path), "text")
    plan = tokens.encode(rows, "tokens", vocabulary, shared=False)._jdf.queryExecution().optimizedPlan().toString()
    assert path not in plan and "regexp_extract_all" not in plan


def test_id_out_of_range_is_unknown(spark, vocabulary):
    df = spark.createDataFrame([(1, [-1, 99, 3])], "id int, ids array<int>")
    for shared in (True, False):
        back = tokens.ids_to_tokens(df, "ids", vocabulary, shared=shared)
        assert by_id(back, "tokens") == {1: ["<unk>", "<unk>", "b"]}


def test_large_vocabulary_is_not_collected(vocabulary, docs, monkeypatch):
    monkeypatch.setattr(tokens, "SHARED_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        vocabulary.in_order()
    plan = tokens.encode(docs, "tokens", vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "ArrowEval" not in plan


def test_custom_tokenizer(spark):
    df = spark.createDataFrame([("a-b c",)], "s string")
    assert tokens.tokenize(df, "s", tokenizer=lambda c: F.split(c, "-")).first()["tokens"] == ["a", "b c"]


def test_lang_prefix(spark):
    df = spark.createDataFrame([("en", [1]), ("de", [2])], "lang string, ids array<int>")
    codes = spark.createDataFrame([("en", 70), ("de", 71)], "lang_code string, token_id int")
    got = {r["lang"]: r["ids"] for r in tokens.lang_prefix(df, "lang", "ids", codes).collect()}
    assert got == {"en": [70, 1], "de": [71, 2]}
    with pytest.raises(Exception, match="unknown language code: de"):
        tokens.lang_prefix(df, "lang", "ids", codes.limit(1)).collect()


def test_prefixes(spark):
    df = spark.createDataFrame([(1, [10, 5, 6]), (2, [])], "id int, ids array<int>")
    rows = tokens.unroll_prefixes(df, "id", "ids").sort("n").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 10), (1, 2, 5), (1, 3, 6)]


def test_joined_lookup_leaves_other_columns(spark, vocabulary, monkeypatch):
    """Token strings are neither shuffled with the ids nor needed for them, and both columns share one lookup."""
    monkeypatch.setattr(tokens, "HEAD_TOKENS", 4)
    df = spark.createDataFrame([(1, ["a", "c", None, "a"], ["zzz"]), (2, None, ["Ü", "b", "Ü"]), (2, [], None)], "id int, s array<string>, t array<string>")
    encoded = tokens.encode_sides(df, {"s": "x", "t": "y"}, vocabulary, shared=False)
    assert encoded.columns == ["id", "s", "t", "x", "y"]
    assert sorted((r["x"] or [], r["y"] or []) for r in encoded.collect()) == [([], []), ([], [6, 3, 6]), ([4, 5, 2, 4], [2])]
    back = tokens.decode_sides(encoded, {"x": "u", "y": "v"}, vocabulary, shared=False)
    assert sorted((r["u"] or [], r["v"] or []) for r in back.collect()) == [([], []), ([], ["Ü", "b", "Ü"]), (["a", "c", "<unk>", "a"], ["<unk>"])]
    plan = encoded.select("id", "x")._jdf.queryExecution().optimizedPlan().toString()
    left = plan[: plan.index("Generate")]  # the rows, before the tokens that are looked up
    assert "Relation" in left and not any(f" {c}#" in line or f"[{c}#" in line for c in ("s", "t") for line in left.splitlines() if "Project" in line)


def test_shifted_pairs_are_counted_as_one_column(spark, tmp_path):
    """Odd texts, repeated rows and all kinds of blanks; a task holds one text for each pair."""
    texts = ["a b a b", "a b a b", None, "", "one", "\u00e9t\u00e9\u00a0b\tb\nb", "x1y_z", "\u4f60\u597d, \u4e16\u754c!", "  a  b  ", "\U00010400a B"]
    rows = [(i % 8, text) for i, text in enumerate(texts)] + [(None, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = Counter()
    for _, text in rows:
        words = regex.findall(r"\p{L}+", text or "")
        expected.update(zip(words, words[1:]))
    counted = registry.shifted_pairs(spark, str(tmp_path))
    assert counted.dtypes == [("prev", "string"), ("cur", "string"), ("n", "bigint")]
    assert Counter({(r["prev"], r["cur"]): r["n"] for r in counted.collect()}) == expected
    assert "Aggregate [pair#" in counted._jdf.queryExecution().optimizedPlan().toString()
