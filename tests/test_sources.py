from __future__ import annotations

import glob

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.operators import rows
from pairloom.sources import bitext

ROWS = [
    (' lead "q", x ', "a\nb"),
    ("null", "NA"),
    ("", 'back\\slash"z'),
    ("ü", "tab\t"),
    ("a\rb", "c\r\nd"),
    ("#c", '"'),
]
AS_FILE = (
    '"english","german"\n" lead ""q"", x ","a\nb"\n"null","NA"\n"","back\\slash""z"\n"ü","tab\t"\n'
    '"a\rb","c\r\nd"\n"#c",""""\n'
)


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(ROWS, "english string, german string").coalesce(1)


def written(path) -> str:
    (part,) = glob.glob(f"{path}/*.csv")
    return open(part, encoding="utf-8", newline="").read()


@pytest.mark.parametrize("header", [True, False])
def test_round_trip(spark, pairs, tmp_path, header):
    path = str(tmp_path / "out")
    bitext.write_bitext(pairs, path, header=header)
    assert written(path) == (AS_FILE if header else AS_FILE.split("\n", 1)[1])
    back = bitext.read_bitext(spark, path, header=header)
    assert [tuple(r) for r in back.collect()] == [(s or None, t) for s, t in ROWS]


def test_na_tokens_become_null(spark, pairs, tmp_path):
    path = str(tmp_path / "out")
    bitext.write_bitext(pairs, path)
    back = bitext.read_bitext(spark, path, na_tokens=bitext.NA_TOKENS).collect()
    assert tuple(back[1]) == (None, None)
    assert back[0]["english"] == ROWS[0][0]


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,german,english\n1,"x, y",a\n2,z,b\n')
    assert [tuple(r) for r in bitext.read_bitext(spark, str(path)).collect()] == [("a", "x, y"), ("b", "z")]
    one = bitext.read_text_column(spark, str(path), "german")
    assert [r[0] for r in one.collect()] == ["x, y", "z"]
    assert "ReadSchema: struct<german:string>" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(AnalysisException):
        bitext.read_text_column(spark, str(path), "french")


def test_another_header_fails_instead_of_being_misread(spark, tmp_path):
    (tmp_path / "a.csv").write_text("english,german\na,b\n")
    (tmp_path / "b.csv").write_text("german,english\nb,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        bitext.read_bitext(spark, str(tmp_path), multiline=False).collect()


def test_rendered_line_is_what_the_sink_writes(pairs):
    lines = [r[0] for r in pairs.select(tx.csv_line(F.col("english"), F.col("german"))).collect()]
    assert "".join(lines) == AS_FILE.split("\n", 1)[1]


def test_rendered_line_of_null_is_null(spark):
    df = spark.createDataFrame([("a", None)], "s string, t string")
    assert df.select(tx.csv_line(F.col("s"), F.col("t"))).first()[0] is None


def test_inline_pairs(spark):
    assert [tuple(r) for r in bitext.inline_pairs(spark, ["a", None], ["b", "c"]).collect()] == [("a", "b"), (None, "c")]
    with pytest.raises(ValueError):
        bitext.inline_pairs(spark, ["a"], [])


def test_whitelist_and_required_values(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, None, "x"), (3, "b", "y")], "id int, inputs_raw string, labels_raw string")
    assert rows.whitelist(df, rows.PAIR_BATCH_COLUMNS).columns == ["inputs_raw", "labels_raw"]
    assert rows.whitelist(df, rows.TEXT_BATCH_COLUMNS).columns == ["inputs_raw"]
    names = ["inputs_raw", "labels_raw"]
    assert [r[0] for r in df.select(rows.first_missing(names)).collect()] == ["labels_raw", "inputs_raw", None]
    assert [r[0] for r in df.select(rows.first_missing(names, accept_blank=True)).collect()] == [None, "inputs_raw", None]
    assert rows.require_values(df.filter("id = 3"), names).count() == 1
    with pytest.raises(Exception, match="Missing required value 'labels_raw'"):
        rows.require_values(df.filter("id = 1"), names).count()


def test_map_subset(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},)], "m map<string,string>")
    assert df.select(tx.map_subset(F.col("m"), ["b", "z"])).first()[0] == {"b": "2"}
