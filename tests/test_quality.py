from __future__ import annotations

import time

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.operators import rows

EDGES = {
    "letter_spread": [
        "", "a", "a b", "12345", "Hello", "abcde", "ab cd", "ab\ncdef", "abcde" + "1" * 8,
    ],
    "ok": [
        "abcdef", "a bcde", "ab cde", "abcd e", "abc\rdef", "abc\u0085def", "abc def", "abc\x0bdef",
        "ab cde 123456", "ab cde !!!!", "ab cde" + " " * 8, "abcdef" + "1" * 11, "abcdefg" + "." * 12,
        "Größe über", "école ét", "日本語 テキスト", "𝒜𝒷 𝒸𝒹ℯ", "😀😀ab cde",
    ],
    "nonletter_ratio": [
        "ab cde 1234567890", "ab cde" + " " * 9, "abcdef" + "1" * 12, "abcdefg" + "." * 13,
    ],
}

# The four patterns that define the spread.
PATTERNS = [
    r"(\pL{1,}).+(\pL{4,})",
    r"(\pL{2,}).+(\pL{3,})",
    r"(\pL{3,}).+(\pL{2,})",
    r"(\pL{4,}).+(\pL{1,})",
]


def expected(text: str) -> str:
    if not any(regex.search(p, text) for p in PATTERNS):
        return "letter_spread"
    letters = len(regex.findall(r"\pL", text))
    return "nonletter_ratio" if len(text) - letters >= 0.65 * len(text) else "ok"


def outcomes(spark, texts: list[str]) -> list[str]:
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1)
    reason = F.coalesce(tx.reject_reason(F.col("s")), F.lit("ok"))
    return [r[0] for r in df.select(reason, "i").sort("i").collect()]


def test_edge_table(spark):
    cases = [(s, outcome) for outcome, texts in EDGES.items() for s in texts]
    assert len(cases) == 31
    got = outcomes(spark, [s for s, _ in cases])
    assert list(zip([s for s, _ in cases], got)) == cases


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdé日𝒜 .,1\n\r\u0085 ́😀"), max_size=24), min_size=60, max_size=120))
def test_gate_equals_patterns(spark, texts):
    assert outcomes(spark, texts) == [expected(t) for t in texts]


def test_other_total(spark):
    # A total of 3 asks for 1+2 or 2+1 letters.
    df = spark.createDataFrame([("a bc",), ("ab c",), ("a b",)], "s string").coalesce(1)
    assert [r[0] for r in df.select(tx.letter_spread(F.col("s"), 3)).collect()] == [True, True, False]


def test_more_letters_at_the_end_keep_a_line_passing(spark):
    passing = EDGES["ok"]
    assert outcomes(spark, [s + "xyz" for s in passing]) == ["ok"] * len(passing)


def test_long_line_without_a_match_takes_linear_time(spark):
    began = time.time()
    assert outcomes(spark, ["a " * 200_000]) == ["letter_spread"]
    assert time.time() - began < 20  # an unanchored search needs hours


def test_null_routing_and_counts(spark):
    df = spark.createDataFrame(
        [("ab cde", "x"), (None, "x"), ("ab cde", None), ("a", None), (None, None), ("a", "x")], "s string, t string"
    )
    reasons = [r[0] for r in rows.with_reject_reason(df, "s", "t").select("reject_reason").collect()]
    assert sorted(reasons, key=str) == sorted(
        [None, "null_source", "null_target", "null_target", "null_source", "letter_spread"], key=str
    )
    counts = {r["outcome"]: r["n"] for r in rows.count_outcomes(df, "s", "t").collect()}
    assert counts == {"ok": 1, "null_source": 2, "null_target": 2, "letter_spread": 1}
    kept, rejected = rows.quality_filter(df, "s", "t"), rows.rejected_rows(df, "s", "t")
    assert kept.count() + rejected.count() == df.count()
    mask = [r[0] for r in rows.with_quality(df, "s").select("quality_ok").collect()]
    assert None not in mask and sum(mask) == 2


def test_gate_is_one_narrow_jvm_stage(spark):
    df = spark.createDataFrame([("x", "y")], "s string, t string")
    plan = rows.with_reject_reason(df, "s", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
