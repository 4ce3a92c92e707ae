"""Named queries over the test tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import stand_ins
from pairloom.functions import arrays as ar
from pairloom.functions import text as tx
from pairloom.functions import vectors as vec
from pairloom.operators import alignment, batching, datastore, neighbours, row_index, rows, scoring, tokens
from pairloom.plans import curate, embed, retrieve, translate
from pairloom.session import spread
from pairloom.scratch import scratch_path, write_scratch
from pairloom.sources import bitext, growing_store, vector_tables, vocabularies
from pairloom.streaming.curate_stream import curate_stream, stream_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of texts, which are costly to work on."""
    return spread(table(spark, sf, name).select(*columns))


def pairs(spark: SparkSession, sf: str, source: str = "source", target: str = "target") -> DataFrame:
    """User turns with the assistant's turn that follows. Joining on conversation *and* turn
    spreads a very long conversation, which a window over it would not."""
    turns = table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias(source))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias(target)
    )
    return asked.join(answered, ["conv_id", "turn"])


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "line")
    )


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.tokenize(texts(spark, sf, "documents", "doc_id", "text"), "text").drop("text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


PAIR_KEY = ["conv_id", "turn"]


def encoded_pairs(spark: SparkSession, sf: str) -> embed.EncodedPairs:
    return embed.encode_pairs(pairs(spark, sf))


def joined(values: Column | str) -> Column:
    column = F.col(values) if isinstance(values, str) else values
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


PAIRS_SQL = """
pairs AS (SELECT u.conv_id, u.turn, u.text AS source, a.text AS target
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')
"""
SPREAD_SQL = r"(?:\pL{1}.+\pL{4})|(?:\pL{2}.+\pL{3})|(?:\pL{3}.+\pL{2})|(?:\pL{4}.+\pL{1})"


def ok_sql(column: str) -> str:
    return (
        rf"(regexp_matches({column}, '{SPREAD_SQL}') AND NOT length(regexp_replace({column}, '\pL', '', 'g'))"
        f" >= CAST(0.65 AS DOUBLE) * length({column}))"
    )


def outcome_sql(column: str, limit: str = "0.65", passed: str = "ok") -> str:
    return (
        rf"CASE WHEN NOT regexp_matches({column}, '{SPREAD_SQL}') THEN 'letter_spread' "
        rf"WHEN length(regexp_replace({column}, '\pL', '', 'g')) >= CAST({limit} AS DOUBLE) * length({column})"
        f" THEN 'nonletter_ratio' ELSE '{passed}' END"
    )


# Ids of both sides of the pairs: reserved 0-4 (pad, end, unknown, source, target language), then
# words by frequency.
def encoded_sql(vocabulary: str = "TRUE", least: int = 1) -> str:
    """The vocabulary has words that come ``least`` times in the pairs that meet a condition; others are unknown (2)."""
    return f"""
{PAIRS_SQL},
words AS (SELECT conv_id, turn, 'source' AS side, regexp_extract_all(source, '\\pL+') AS w FROM pairs
          UNION ALL SELECT conv_id, turn, 'target', regexp_extract_all(target, '\\pL+') FROM pairs),
toks AS (SELECT conv_id, turn, side, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM words),
vocab AS (SELECT token, CAST(4 + row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS id
          FROM toks WHERE {vocabulary} GROUP BY token HAVING count(*) >= {least}),
ids AS (SELECT conv_id, turn, side, p, coalesce(id, 2) AS id, CASE WHEN id IS NULL THEN '<unk>' ELSE token END AS token
        FROM toks LEFT JOIN vocab USING (token)
        UNION ALL SELECT conv_id, turn, side, 0, CASE side WHEN 'source' THEN 3 ELSE 4 END,
                         CASE side WHEN 'source' THEN '<src>' ELSE '<tgt>' END FROM words
        UNION ALL SELECT conv_id, turn, side, len(w) + 1, 1, '</s>' FROM words),
encoded AS (SELECT conv_id, turn,
                   list(id ORDER BY p) FILTER (side = 'source') AS source_ids,
                   list(id ORDER BY p) FILTER (side = 'target') AS target_ids,
                   list(token ORDER BY p) FILTER (side = 'source') AS source_toks,
                   list(token ORDER BY p) FILTER (side = 'target') AS target_toks
            FROM ids GROUP BY conv_id, turn),
batched AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 50 AS batch_id FROM encoded),
sized AS (SELECT *, max(len(source_ids)) OVER (PARTITION BY batch_id) AS ls,
                    max(len(target_ids)) OVER (PARTITION BY batch_id) AS lt FROM batched)
"""

ENCODED_SQL = encoded_sql()


def states_sql(encoded: str = ENCODED_SQL) -> str:
    """States of the stand-in model."""
    return f"""
{encoded},
src_states AS (SELECT conv_id, turn, p AS pos, id AS token_id, id + 7 * p AS s FROM ids WHERE side = 'source'),
src_sums AS (SELECT conv_id, turn, sum(id) AS total FROM ids WHERE side = 'source' GROUP BY ALL),
tgt_states AS (SELECT conv_id, turn, p AS pos, id AS token_id,
                      CAST(total + sum(id) OVER (PARTITION BY conv_id, turn ORDER BY p) AS BIGINT) AS s
               FROM ids JOIN src_sums USING (conv_id, turn) WHERE side = 'target')
"""


STATES_SQL = states_sql()
STATE_COLUMNS_SQL = ", ".join(f"CAST(s * {j + 1} % 97 AS DOUBLE) AS v{j}" for j in range(stand_ins.DIMENSION))


def state_columns(vector: str) -> list[Column]:
    return [F.get(vector, F.lit(j)).cast("double").alias(f"v{j}") for j in range(stand_ins.DIMENSION)]


# ---------------------------------------------------------------- sources and sinks


def _written_pairs(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "csv")
    bitext.write_bitext(pairs(spark, sf, "english", "german"), path, ["english", "german"])
    return path


@query(f"WITH {PAIRS_SQL} SELECT source AS english, target AS german FROM pairs")
def csv_scan(spark, sf):
    return bitext.read_bitext(spark, _written_pairs(spark, sf))


@query(f"WITH {PAIRS_SQL} SELECT source AS english FROM pairs")
def csv_scan_single(spark, sf):
    return bitext.read_text_column(spark, _written_pairs(spark, sf), "english")


@query("""SELECT CASE WHEN lang NOT IN ('de', 'fr') THEN lang END AS lang,
                 CASE WHEN source NOT IN ('src0', 'src1') THEN source END AS source FROM documents""")
def csv_null_tokens(spark, sf):
    path = scratch_path(spark, "csv")
    bitext.write_bitext(table(spark, sf, "documents"), path, ["lang", "source"])
    marks = bitext.NA_TOKENS + ("de", "fr", "src0", "src1")
    return bitext.read_bitext(spark, path, "lang", "source", multiline=False, na_tokens=marks)


@query("SELECT text AS english, source AS german FROM documents")
def csv_sink_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    bitext.write_bitext(table(spark, sf, "documents"), path, ["text", "source"], header=False)
    return bitext.read_bitext(spark, path, header=False)


@query("""SELECT doc_id, '"' || replace(text, '"', '""') || '","' || replace(source, '"', '""') || '"' || chr(10)
                 AS csv_line FROM documents""")
def csv_render_line(spark, sf):
    line = tx.csv_line(F.col("text"), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", line.alias("csv_line"))


@query(f"""WITH {PAIRS_SQL} SELECT source, target FROM pairs UNION ALL
           VALUES ('Hello, how are you?', 'Hallo, wie geht''s?'), ('What a nice day', 'Was ein sehr sohn tag!')""")
def inline_pairs(spark, sf):
    literal = bitext.inline_pairs(
        spark,
        ["Hello, how are you?", "What a nice day"],
        ["Hallo, wie geht's?", "Was ein sehr sohn tag!"],
    )
    return pairs(spark, sf).select("source", "target").unionByName(literal)


ELEMENTS_SQL = """SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS pos, CAST(x AS DOUBLE) AS x
                  FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"""


def elements(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@query(ELEMENTS_SQL)
def sharded_sink(spark, sf):
    path = scratch_path(spark, "shards")
    vector_tables.write_shards(vectors(spark, sf), path, 10, "vec_id")
    return elements(spark.read.parquet(path))


@query(ELEMENTS_SQL)
def grouped_layout(spark, sf):
    path = scratch_path(spark, "grouped")
    vector_tables.write_grouped(vectors(spark, sf), path, "label", 4)
    return elements(spark.read.parquet(path))


def _ordered_csv(spark: SparkSession, sf: str) -> str:
    """Pairs written in order, over several files."""
    path = scratch_path(spark, "csv")
    ordered = pairs(spark, sf, "english", "german").repartitionByRange(4, *PAIR_KEY).sortWithinPartitions(*PAIR_KEY)
    bitext.write_bitext(ordered, path, ["english", "german"])
    return path


@query(f"""WITH {PAIRS_SQL} SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_idx, source AS english, target AS german
           FROM pairs QUALIFY row_idx BETWEEN 5 AND 24""")
def csv_row_at(spark, sf):
    """Rows of a CSV by their place in its files."""
    return bitext.numbered(bitext.read_bitext(spark, _ordered_csv(spark, sf), position=True)).between(5, 25).drop(*bitext.POSITION)


@query(f"""WITH {PAIRS_SQL} SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1) // 50 AS batch_id,
                  CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) % 50 AS INTEGER) AS pos_in_batch, source AS english FROM pairs""")
def csv_batches(spark, sf):
    rows = bitext.read_text_column(spark, _ordered_csv(spark, sf), "english", position=True)
    return batching.assign_batches(rows, *bitext.POSITION, unique=True).drop("row_idx", *bitext.POSITION)


# ---------------------------------------------------------------- projections and filters


@query(f"SELECT doc_id, regexp_matches(text, '{SPREAD_SQL}') AS spread FROM documents")
def letter_spread(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", tx.letter_spread(F.col("text")).alias("spread"))


@query(rf"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, regexp_matches(line, '{SPREAD_SQL}') AS spread
            FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
                  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def letter_spread_lines(spark, sf):
    return text_lines(spark, sf).select("doc_id", "line_no", tx.letter_spread(F.col("line")).alias("spread"))


@query(r"""SELECT doc_id, length(text) AS n_chars,
                  length(regexp_replace(text, '\pL', '', 'g')) >= CAST(0.65 AS DOUBLE) * length(text) AS over_65,
                  length(regexp_replace(text, '\pL', '', 'g')) >= CAST(0.30 AS DOUBLE) * length(text) AS over_30
           FROM documents""")
def nonletter_ratio(spark, sf):
    text = F.col("text")
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id",
        F.length(text).cast("long").alias("n_chars"),
        tx.nonletter_ratio(text).alias("over_65"),
        tx.nonletter_ratio(text, 0.30).alias("over_30"),
    )


@query(r"""SELECT page_id, CAST(length(regexp_replace(html, '\pL', '', 'g')) AS INTEGER) AS n_nonletters FROM pages""")
def nonletter_count(spark, sf):
    return texts(spark, sf, "pages", "page_id", "html").select("page_id", tx.nonletter_count(F.col("html")).alias("n_nonletters"))


@query(f"SELECT doc_id, {ok_sql('text')} AS quality_ok FROM documents")
def quality_mask(spark, sf):
    return rows.with_quality(texts(spark, sf, "documents", "doc_id", "text"), "text").select("doc_id", "quality_ok")


@query(f"SELECT page_id, {ok_sql('html')} AS quality_ok FROM pages")
def quality_mask_pages(spark, sf):
    return rows.with_quality(texts(spark, sf, "pages", "page_id", "html"), "html").select("page_id", "quality_ok")


@query(f"SELECT item_id, {ok_sql('text')} AS quality_ok FROM benchmark")
def quality_mask_benchmark(spark, sf):
    return rows.with_quality(table(spark, sf, "benchmark"), "text").select("item_id", "quality_ok")


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, source, target FROM pairs WHERE {ok_sql('source')}")
def quality_filter(spark, sf):
    return rows.quality_filter(pairs(spark, sf), "source", "target")


@query(f"SELECT outcome, count(*) AS n FROM (SELECT {outcome_sql('text')} AS outcome FROM documents) GROUP BY outcome")
def reject_reasons(spark, sf):
    return rows.count_outcomes(texts(spark, sf, "documents", "text"), "text")


@query(f"SELECT outcome, count(*) AS n FROM (SELECT {outcome_sql('text', '0.30')} AS outcome FROM documents) GROUP BY ALL")
def reject_reasons_strict(spark, sf):
    return rows.count_outcomes(texts(spark, sf, "documents", "text"), "text", limit=0.30)


@query(f"""SELECT outcome, count(*) AS n FROM (
             SELECT {outcome_sql('line')} AS outcome
             FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY outcome""")
def reject_reasons_lines(spark, sf):
    return rows.count_outcomes(text_lines(spark, sf), "line")


@query(f"""SELECT doc_id, line, reject_reason FROM (
             SELECT doc_id, line, {outcome_sql('line')} AS reject_reason
             FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
           WHERE reject_reason <> 'ok'""")
def rejected_lines(spark, sf):
    return rows.rejected_rows(text_lines(spark, sf), "line").select("doc_id", "line", "reject_reason")


@query(f"""WITH {PAIRS_SQL} SELECT {outcome_sql('source', passed='kept')} AS outcome,
                                   source AS english, target AS german FROM pairs""")
def curate_job(spark, sf):
    path = scratch_path(spark, "curated")
    curate.write_outcomes(pairs(spark, sf, "english", "german"), path, "english", "german")
    return bitext_outcomes(spark, path)


@query(f"""WITH {PAIRS_SQL} SELECT {outcome_sql('source', passed='kept')} AS outcome,
                                   source AS english, target AS german FROM pairs""")
def curate_stream_job(spark, sf):
    out = scratch_path(spark, "streamed")
    marks = scratch_path(spark, "stream-marks")
    curate_stream(spark, _written_pairs(spark, sf), out, marks).awaitTermination()
    return bitext_outcomes(spark, out)


@query(f"WITH {PAIRS_SQL} SELECT outcome, count(*) AS n FROM (SELECT {outcome_sql('source', passed='kept')} AS outcome FROM pairs) GROUP BY outcome")
def curate_stream_counts(spark, sf):
    """Pairs per outcome as the stream has counted them."""
    out = scratch_path(spark, "streamed")
    curate_stream(spark, _written_pairs(spark, sf), out, scratch_path(spark, "stream-marks")).awaitTermination()
    return stream_counts(spark, out)


def bitext_outcomes(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.csv(path).select("outcome", "english", "german")


@query(f"WITH {PAIRS_SQL} SELECT source, target FROM pairs")
def select_pair(spark, sf):
    return pairs(spark, sf).select("source", "target")


@query("SELECT text AS inputs_raw, lang AS labels_raw FROM documents")
def whitelist_select(spark, sf):
    renamed = table(spark, sf, "documents").withColumnsRenamed({"text": "inputs_raw", "lang": "labels_raw"})
    return rows.whitelist(renamed, rows.PAIR_BATCH_COLUMNS)


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'lang' WHEN source IN ('src0', 'src1') THEN 'source' END
                 AS first_missing FROM documents""")
def required_values(spark, sf):
    docs = table(spark, sf, "documents").withColumns(
        {
            "lang": F.when(F.col("lang") != "de", F.col("lang")),
            "source": F.when(F.col("source").isin("src0", "src1"), "").otherwise(F.col("source")),
        }
    )
    return docs.select("doc_id", rows.first_missing(["lang", "source"]).alias("first_missing"))


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k,
                  CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS click,
                  1 + CAST(event_type = 'click' AS INTEGER) AS n_keys FROM events""")
def map_subset(spark, sf):
    """Of maps with a key named by the event's type, one of the event and one that is always there."""
    user = F.col("user_id").cast("string")
    given = F.map_concat(
        F.from_json("props", "map<string,string>"), F.create_map("event_type", user), F.create_map(F.lit("spare"), user)
    )
    kept = tx.map_subset(given, ["k", "click", "absent"])
    picked = [F.try_element_at(kept, F.lit(key)).alias(key) for key in ("k", "click")]
    return table(spark, sf, "events").select("event_id", *picked, F.size(kept).alias("n_keys"))


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY ch")
def chars_explode(spark, sf):
    chars = texts(spark, sf, "documents", "text").select(F.explode(tx.characters(F.col("text"))).alias("ch"))
    return chars.groupBy("ch").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, bool_or({ok_sql('line')}) AS any_line_ok
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def any_flags(spark, sf):
    flags = F.transform(tx.lines(F.col("text")), lambda line: tx.quality_ok(line))
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", tx.any_of(flags).alias("any_line_ok"))


# ---------------------------------------------------------------- rows and batches


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
                 row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_idx FROM orders""")
def row_index_orders(spark, sf):
    """Narrow keys are numbered, and the numbers joined back to the other columns."""
    payload = ["o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus", "o_orderpriority"]
    orders = table(spark, sf, "orders").select(*payload)
    return row_index.number_rows(orders, "o_orderdate", "o_orderkey", unique=True).drop("o_orderdate")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
                 row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS row_idx
          FROM lineitem""")
def row_index_lineitem(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    return row_index.index_rows(table(spark, sf, "lineitem").select(*keys), *keys).table()


@query("""SELECT doc_id, n_chars, row_idx FROM (
            SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS row_idx FROM documents)
          WHERE row_idx = 100""")
def row_at(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return row_index.index_rows(docs, "n_chars", "doc_id", unique=True).at(100)


@query("""SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events
          QUALIFY row_idx BETWEEN 1000 AND 1499""")
def row_index_kept(spark, sf):
    """Rows of an index that is kept on disk and opened again."""
    path = scratch_path(spark, "index")
    row_index.index_rows(table(spark, sf, "events").select("event_id", "user_id"), "event_id", unique=True, path=path)
    return row_index.open_index(spark, path).between(1000, 1500)


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 3")
def first_n(spark, sf):
    return row_index.first_rows(table(spark, sf, "embeddings").select("vec_id", "label"), 3, "vec_id")


@query("""SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch_id,
                 CAST((row_number() OVER (ORDER BY doc_id) - 1) % 50 AS INTEGER) AS pos_in_batch, text, source FROM documents""")
def assign_batches(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return batching.assign_batches(docs, "doc_id", unique=True).drop("row_idx")


@query(f"""WITH {PAIRS_SQL} SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1) // 50 AS batch_id,
                  CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) % 50 AS INTEGER) AS pos, source, target FROM pairs""")
def collate_batches(spark, sf):
    batched = batching.assign_batches(pairs(spark, sf), *PAIR_KEY, unique=True)
    lists = batching.collate(batched, ["source", "target"])
    rows_again = lists.select("batch_id", F.posexplode(F.arrays_zip("source", "target")).alias("pos", "pair"))
    return rows_again.select("batch_id", "pos", "pair.source", "pair.target")


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50")
def first_batch(spark, sf):
    return batching.first_batch(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query(r"""SELECT b AS batch_id, count(*) AS n_rows, CAST(max(len(w)) AS INTEGER) AS longest
           FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS b,
                        regexp_extract_all(text, '\pL+') AS w FROM documents) GROUP BY b""")
def batch_shapes(spark, sf):
    batched = batching.assign_batches(doc_tokens(spark, sf), "doc_id", unique=True)
    return batching.batch_shapes(batched, "tokens")


@query("SELECT count(*) AS n_rows FROM lineitem")
def row_count(spark, sf):
    return batching.row_count(table(spark, sf, "lineitem"))


@query(r"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n, array_to_string(w, ' ') AS gathered
           FROM (SELECT doc_id, regexp_extract_all(text, '\pL+') AS w FROM documents) WHERE len(w) > 0""")
def gather_positions(spark, sf):
    long = doc_tokens(spark, sf).select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    gathered = batching.gather_positions(long, "doc_id", "pos", "token")
    return gathered.select("doc_id", F.size("token").alias("n"), joined("token").alias("gathered"))


@query(f"SELECT * FROM ({ELEMENTS_SQL}) WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)")
def first_per_group(spark, sf):
    return elements(batching.first_per_group(vectors(spark, sf), "label", F.col("vec_id"), "vec_id", "vector"))


# ---------------------------------------------------------------- tokens


@query(r"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w, ' ') AS tokens
           FROM (SELECT doc_id, regexp_extract_all(text, '\pL+') AS w FROM documents)""")
def tokenize(spark, sf):
    return doc_tokens(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens"), joined("tokens").alias("tokens"))


@query(rf"""WITH {PAIRS_SQL} SELECT conv_id, turn, array_to_string(regexp_extract_all(source, '\pL+'), ' ') AS source_tokens,
                   array_to_string(regexp_extract_all(target, '\pL+'), ' ') AS target_tokens FROM pairs""")
def tokenize_pair(spark, sf):
    both = tokens.tokenize_pair(pairs(spark, sf), "source", "target")
    return both.select(*PAIR_KEY, joined("source_tokens").alias("source_tokens"), joined("target_tokens").alias("target_tokens"))


@query(r"""SELECT CAST(2 + row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS token_id, token, count(*) AS n
           FROM (SELECT unnest(regexp_extract_all(text, '\pL+')) AS token FROM documents) GROUP BY token
           UNION ALL VALUES (0, '<pad>', 0), (1, '</s>', 0), (2, '<unk>', 0)""")
def vocabulary(spark, sf):
    return tokens.build_vocabulary(doc_tokens(spark, sf), "tokens").table


_DOC_IDS_SQL = r"""
WITH toks AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS p
              FROM (SELECT doc_id, regexp_extract_all(text, '\pL+') AS w FROM documents)),
vocab AS (SELECT token, 2 + row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM toks GROUP BY token),
enc AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p) AS ids FROM toks JOIN vocab USING (token) GROUP BY doc_id)
SELECT d.doc_id, coalesce(ids, '') AS ids FROM documents d LEFT JOIN enc USING (doc_id)
"""


@query(_DOC_IDS_SQL)
def encode_ids(spark, sf):
    docs = doc_tokens(spark, sf)
    found = tokens.build_vocabulary(docs, "tokens")
    return tokens.encode(docs, "tokens", found).select("doc_id", joined("ids").alias("ids"))


@query(_DOC_IDS_SQL)
def encode_ids_joined(spark, sf):
    docs = doc_tokens(spark, sf)
    found = tokens.build_vocabulary(docs, "tokens")
    return tokens.encode(docs, "tokens", found, shared=False).select("doc_id", joined("ids").alias("ids"))


@query(r"""WITH old AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\pL+')) AS token FROM documents) GROUP BY token),
           first AS (SELECT CAST(2 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS token_id, token, n FROM old
                     UNION ALL VALUES (0, '<pad>', 0), (1, '</s>', 0), (2, '<unk>', 0)),
           fresh AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\pL+')) AS token FROM conversations)
                     WHERE token NOT IN (SELECT token FROM old) GROUP BY token)
           SELECT * FROM first UNION ALL
           SELECT CAST((SELECT count(*) FROM first) - 1 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER), token, n FROM fresh""")
def vocabulary_kept(spark, sf):
    """The documents' vocabulary, kept, opened, and extended by the words of the conversations."""
    path = scratch_path(spark, "vocabulary")
    vocabularies.save_vocabulary(tokens.build_vocabulary(doc_tokens(spark, sf), "tokens"), path, 8)
    turns = tokens.tokenize(table(spark, sf, "conversations").select("text"), "text")
    more = vocabularies.extend_vocabulary(vocabularies.open_vocabulary(spark, path), turns, "tokens")
    return vocabularies.save_vocabulary(more, path, 8).table


def _sides(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*PAIR_KEY, *[joined(f"{side}_{suffix}").alias(f"{side}_{suffix}") for side in ("source", "target")])


@query(f"""WITH {ENCODED_SQL} SELECT conv_id, turn,
                  array_to_string(list_concat(source_ids, list_transform(range(ls - len(source_ids)), lambda x: 0)), ' ')
                      AS source_ids_padded,
                  array_to_string(list_concat(target_ids, list_transform(range(lt - len(target_ids)), lambda x: 0)), ' ')
                      AS target_ids_padded
           FROM sized""")
def pad_batch(spark, sf):
    return _sides(embed.collate_pairs(encoded_pairs(spark, sf), *PAIR_KEY, unique=True), "ids_padded")


@query(f"""WITH {ENCODED_SQL} SELECT conv_id, turn,
                  array_to_string(list_transform(range(ls), lambda x: CASE WHEN x < len(source_ids) THEN 1 ELSE 0 END), ' ')
                      AS source_ids_attention,
                  array_to_string(list_transform(range(lt), lambda x: CASE WHEN x < len(target_ids) THEN 1 ELSE 0 END), ' ')
                      AS target_ids_attention
           FROM sized""")
def attention_mask(spark, sf):
    return _sides(embed.collate_pairs(encoded_pairs(spark, sf), *PAIR_KEY, unique=True), "ids_attention")


@query(f"""WITH {ENCODED_SQL} SELECT conv_id, turn,
                  array_to_string(list_transform(range(lt),
                      lambda x: CASE WHEN x = 0 OR x >= len(target_ids) - 1 THEN 1 ELSE 0 END), ' ') AS special_mask
           FROM sized""")
def special_tokens_mask(spark, sf):
    encoded = encoded_pairs(spark, sf)
    collated = embed.collate_pairs(encoded, *PAIR_KEY, unique=True)
    mask = ar.special_tokens_mask(F.col("target_ids_padded"), encoded.vocabulary.special_ids)
    return collated.select(*PAIR_KEY, joined(mask).alias("special_mask"))


@query(f"""WITH {ENCODED_SQL} SELECT conv_id, turn, array_to_string(source_toks, ' ') AS source_back,
                  array_to_string(target_toks, ' ') AS target_back FROM encoded""")
def ids_to_tokens(spark, sf):
    encoded = encoded_pairs(spark, sf)
    back = encoded.table.select(*PAIR_KEY, "source_ids", "target_ids")
    return _sides(tokens.decode_sides(back, {"source_ids": "source_back", "target_ids": "target_back"}, encoded.vocabulary), "back")


@query(f"""WITH {ENCODED_SQL} SELECT conv_id, turn, array_to_string(target_toks, ' ') AS target_back FROM encoded""")
def ids_to_tokens_joined(spark, sf):
    encoded = encoded_pairs(spark, sf)
    ids = encoded.table.select(*PAIR_KEY, "target_ids")
    back = tokens.ids_to_tokens(ids, "target_ids", encoded.vocabulary, "target_back", shared=False)
    return back.select(*PAIR_KEY, joined("target_back").alias("target_back"))


@query(rf"""WITH {PAIRS_SQL} SELECT conv_id, turn, array_to_string(regexp_extract_all(target, '\pL+'), ' ') AS text FROM pairs""")
def batch_decode(spark, sf):
    encoded = encoded_pairs(spark, sf)
    decoded = tokens.batch_decode(encoded.table.select(*PAIR_KEY, "target_ids"), "target_ids", encoded.vocabulary)
    return decoded.select(*PAIR_KEY, "text")


@query(f"""WITH codes AS (SELECT lang, 9999999 + row_number() OVER (ORDER BY lang) AS code FROM (SELECT DISTINCT lang FROM documents)),
           encoded AS ({_DOC_IDS_SQL})
           SELECT doc_id, rtrim(code || ' ' || ids) AS ids FROM documents JOIN codes USING (lang) JOIN encoded USING (doc_id)""")
def lang_prefix(spark, sf):
    docs = tokens.tokenize(texts(spark, sf, "documents", "doc_id", "lang", "text"), "text").drop("text")
    langs = row_index.index_rows(docs.select("lang").distinct(), "lang", unique=True).table()
    docs = tokens.encode(docs, "tokens", tokens.build_vocabulary(docs, "tokens"))
    codes = langs.select(F.col("lang").alias("lang_code"), (F.col("row_idx") + 10_000_000).cast("int").alias("token_id"))
    return tokens.lang_prefix(docs, "lang", "ids", codes).select("doc_id", joined("ids").alias("ids"))


@query(f"WITH {ENCODED_SQL} SELECT conv_id, turn, CAST(p + 1 AS INTEGER) AS n, id AS last_id FROM ids WHERE side = 'target'")
def prefix_unroll(spark, sf):
    return tokens.unroll_prefixes(encoded_pairs(spark, sf).table, PAIR_KEY, "target_ids")


@query(r"""SELECT doc_id, w[len(w)] AS last_token, w[3] AS third_token
           FROM (SELECT doc_id, regexp_extract_all(text, '\pL+') AS w FROM documents)""")
def element_pick(spark, sf):
    words = F.col("tokens")
    return doc_tokens(spark, sf).select(
        "doc_id", ar.from_end(words).alias("last_token"), ar.at(words, 2).alias("third_token")
    )


# ---------------------------------------------------------------- scoring and the datastore


@query(f"SELECT conv_id, turn, replace(text, 'e', '3') AS output_text, {ok_sql('text')} AS quality_ok FROM conversations")
def score_text(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return translate.translate(turns, "text", stand_ins.make_text_model).select("conv_id", "turn", "translation.*")


@query(f"WITH {STATES_SQL} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, token_id, {STATE_COLUMNS_SQL} FROM src_states")
def flatten_vectors(spark, sf):
    scored = embed.embed_pairs(encoded_pairs(spark, sf), PAIR_KEY, stand_ins.make_pair_model)
    flat = scoring.flatten_states(scored, PAIR_KEY, "source_states", "source_ids")
    return flat.select(*PAIR_KEY, "pos", "token_id", *state_columns("vector"))


@query(f"WITH {STATES_SQL} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, token_id, {STATE_COLUMNS_SQL} FROM tgt_states")
def token_vectors(spark, sf):
    encoded = encoded_pairs(spark, sf)
    padded = embed.collate_pairs(encoded, *PAIR_KEY, unique=True)
    needed = padded.select(*PAIR_KEY, "source_ids_padded", "source_ids_attention", "target_ids_padded", "target_ids_attention")
    scored = scoring.score_pairs(
        needed, "source_ids_padded", "target_ids_padded", stand_ins.make_pair_model, source_mask="source_ids_attention"
    )
    flat = scoring.flatten_states(scored, PAIR_KEY, "target_states", "target_ids_padded", "target_ids_attention")
    return flat.select(*PAIR_KEY, "pos", "token_id", *state_columns("vector"))


@query(f"""WITH {STATES_SQL},
           told AS (SELECT conv_id, turn, side, string_agg(token, ' ' ORDER BY p) AS tokens FROM ids GROUP BY ALL),
           every AS (SELECT 'source' AS side, * FROM src_states UNION ALL SELECT 'target', * FROM tgt_states)
           SELECT conv_id, turn, side, tokens, CAST(pos AS INTEGER) AS pos, token_id, {STATE_COLUMNS_SQL}
           FROM every JOIN told USING (conv_id, turn, side)""")
def embed_pairs_job(spark, sf):
    """Token strings of both sides next to the states of both sides."""
    done = embed.embed_pairs(encoded_pairs(spark, sf), PAIR_KEY, stand_ins.make_pair_model)
    sides = [
        scoring.flatten_states(
            done.withColumns({"side": F.lit(side), "tokens": joined(f"{side}_tokens")}), [*PAIR_KEY, "side", "tokens"], f"{side}_states", f"{side}_ids"
        )
        for side in ("source", "target")
    ]
    return sides[0].unionByName(sides[1]).select(*PAIR_KEY, "side", "tokens", "pos", "token_id", *state_columns("vector"))


@query(f"WITH {STATES_SQL} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, token_id, {STATE_COLUMNS_SQL} FROM tgt_states")
def embed_in_parts(spark, sf):
    """States written part by part, with a ledger of the finished ones."""
    path = scratch_path(spark, "parts")
    scored = embed.embed_in_parts(encoded_pairs(spark, sf), PAIR_KEY, stand_ins.make_pair_model, path, n_parts=8, at_a_time=4)
    flat = scoring.flatten_states(scored, PAIR_KEY, "target_states", "target_ids")
    return flat.select(*PAIR_KEY, "pos", "token_id", *state_columns("vector"))


@query(f"""WITH {ENCODED_SQL} SELECT conv_id, turn,
                  coalesce(array_to_string(list_filter(target_ids, lambda x: x > 4), ' '), '') AS kept FROM encoded""")
def compress_masked(spark, sf):
    encoded = encoded_pairs(spark, sf)
    kept = datastore.drop_special(encoded.table, "target_ids", encoded.vocabulary.special_ids)
    return kept.select(*PAIR_KEY, joined("target_ids").alias("kept"))


@query(rf"""SELECT prev, cur, count(*) AS n FROM (
              SELECT unnest(w[:-2]) AS prev, unnest(w[2:]) AS cur
              FROM (SELECT regexp_extract_all(text, '\pL+') AS w FROM documents) WHERE len(w) > 1) GROUP BY prev, cur""")
def shifted_pairs(spark, sf):
    """Counts of neighbouring words. A pair is counted as one text, which takes less room in a task than two
    columns; words are letters only, so the blank between them tells them apart again."""
    words = F.col("tokens")
    pair = F.transform(ar.shifted_entries(words, words), lambda e: F.concat(e["key_vector"], F.lit(" "), e["value_token_id"]))
    counted = doc_tokens(spark, sf).select(F.explode(pair).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counted.select(F.substring_index("pair", " ", 1).alias("prev"), F.substring_index("pair", " ", -1).alias("cur"), "n")


def _store_sql(states: str = STATES_SQL) -> str:
    """Each target token with the state right before it, without padding, end and language marks on either side."""
    return f"""{states},
           lined AS (SELECT conv_id, turn, CAST(p AS INTEGER) AS pos, id AS value_token_id, lag(s) OVER w AS s, lag(id) OVER w AS before
                     FROM (SELECT conv_id, turn, pos AS p, token_id AS id, s FROM tgt_states)
                     WINDOW w AS (PARTITION BY conv_id, turn ORDER BY p)),
           store AS (SELECT lined.*, source_ids[least(pos + 1, len(source_ids))] AS group_token_id
                     FROM lined JOIN encoded USING (conv_id, turn) WHERE value_token_id NOT IN (0, 1, 3, 4) AND before NOT IN (0, 1, 3, 4))"""


_STORE_COLUMNS_SQL = f"SELECT group_token_id, conv_id, turn, pos, value_token_id, {STATE_COLUMNS_SQL} FROM store"


def _store_columns(store: DataFrame) -> DataFrame:
    return store.select("group_token_id", *PAIR_KEY, "pos", "value_token_id", *state_columns("key_vector"))


@query(f"WITH {_store_sql()} {_STORE_COLUMNS_SQL}")
def datastore_build(spark, sf):
    return _store_columns(embed.build_datastore(encoded_pairs(spark, sf), PAIR_KEY, stand_ins.make_pair_model))


@query(f"WITH {_store_sql(states_sql(encoded_sql('TRUE', 3)))} {_STORE_COLUMNS_SQL}")
def datastore_build_unseen(spark, sf):
    """All pairs, with a vocabulary of the words that come three times or more: others are unknown, in their places."""
    both = write_scratch(tokens.tokenize_pair(pairs(spark, sf), "source", "target"), "tokenized")
    reserved = (tokens.PAD, tokens.END, tokens.UNKNOWN, "<src>", "<tgt>")
    known = tokens.build_vocabulary(both, "source_tokens", "target_tokens", reserved=reserved, least=3)
    encoded = embed.encode_pairs(pairs(spark, sf), vocabulary=known)
    return _store_columns(embed.build_datastore(encoded, PAIR_KEY, stand_ins.make_pair_model))


ROUNDS = 3  # of alignment, in the registered queries
_CONTENT_SQL = """a_pairs AS (SELECT conv_id, turn, list_filter(source_ids, lambda x: x NOT IN (0, 1, 3, 4)) AS src,
                  list_filter(target_ids, lambda x: x NOT IN (0, 1, 3, 4)) AS tgt FROM encoded)"""
ALIGNED_SQL = f"{_CONTENT_SQL},\n{alignment.oracle_sql('a_pairs', 'conv_id, turn', ROUNDS)}"


@query(f"WITH {ENCODED_SQL}, {ALIGNED_SQL} SELECT * FROM shares")
def translation_shares(spark, sf):
    """The share with which each source token gives each target token, in parts of a thousand million."""
    encoded = encoded_pairs(spark, sf)
    learned = alignment.align(encoded.table, "source_ids", "target_ids", encoded.vocabulary.special_ids, ROUNDS)
    return learned.shares.select("source_id", "target_id", "share")


@query(f"""WITH {ENCODED_SQL}, {ALIGNED_SQL}
           SELECT conv_id, turn, CAST(p AS INTEGER) AS pos, id AS target_id, e AS source_id
           FROM ids JOIN links USING (conv_id, turn) WHERE side = 'target' AND f = id""")
def word_alignment(spark, sf):
    """The source token that each target position belongs to."""
    encoded = encoded_pairs(spark, sf)
    learned = alignment.align(encoded.table, "source_ids", "target_ids", encoded.vocabulary.special_ids, ROUNDS)
    return alignment.link_positions(learned.table, PAIR_KEY, "target_ids")


@query(f"""WITH {STATES_SQL}, {ALIGNED_SQL},
           lined AS (SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, token_id AS value_token_id, lag(s) OVER w AS s, lag(token_id) OVER w AS before
                     FROM tgt_states WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
           store AS (SELECT lined.*, e AS group_token_id FROM lined LEFT JOIN links ON links.conv_id = lined.conv_id AND links.turn = lined.turn
                     AND f = value_token_id WHERE value_token_id NOT IN (0, 1, 3, 4) AND before NOT IN (0, 1, 3, 4))
           {_STORE_COLUMNS_SQL}""")
def datastore_aligned(spark, sf):
    """The datastore with each target token filed under the source token that it is aligned to."""
    encoded = embed.align_pairs(encoded_pairs(spark, sf), ROUNDS)
    return _store_columns(embed.build_datastore(encoded, PAIR_KEY, stand_ins.make_pair_model, group_ids="group_ids"))


# ---------------------------------------------------------------- vectors


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 1)) AS e FROM embeddings),
          n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v)
          SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(CAST(x / norm AS FLOAT) AS DOUBLE), 6) AS x
          FROM (SELECT vec_id, norm, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM n)""")
def l2_normalize(spark, sf):
    scaled = vectors(spark, sf).withColumn(
        "vector", F.transform("vector", lambda x: x.cast("double") * (F.col("label") + 1))
    )
    unit = scaled.select("vec_id", F.posexplode(vec.l2_normalize(F.col("vector"))).alias("pos", "x"))
    return unit.select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("SELECT vec_id, label <> 0 AS fits FROM embeddings")
def vector_dim_check(spark, sf):
    cut = vectors(spark, sf).withColumn(
        "vector", F.when(F.col("label") == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector"))
    )
    good, bad = neighbours.check_dimension(cut, "vector", 64)
    return good.select("vec_id", F.lit(True).alias("fits")).unionByName(bad.select("vec_id", F.lit(False).alias("fits")))


@query(f"""WITH old AS ({ELEMENTS_SQL}),
           fresh AS (SELECT vec_id AS old_id, (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY label, vec_id) AS vec_id
                     FROM embeddings)
           SELECT * FROM old UNION ALL SELECT f.vec_id, label, pos, x FROM old JOIN fresh f ON f.old_id = old.vec_id""")
def vector_ids(spark, sf):
    base = vectors(spark, sf).withColumn("old_id", F.col("vec_id"))
    return elements(neighbours.add_vectors(base, base.drop("vec_id"), "label", "old_id", unique=True))


def _knn_sql(where: str = "TRUE") -> str:
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: CAST(CAST(x / sqrt(list_inner_product(e, e)) AS FLOAT) AS DOUBLE)) AS e FROM v),
d AS (SELECT q.vec_id AS query_id, x.vec_id, pow(list_distance(q.e, x.e), 2) AS dist FROM u q JOIN u x ON {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, round(dist, 6) AS distance FROM r WHERE rank <= 3"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


QUERIES_SQL = "q.vec_id % 100 = 0"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated queries of a search: vectors whose id is divisible by 100."""
    return vectors(spark, sf).filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


@query(_knn_sql(QUERIES_SQL))
def knn_exact(spark, sf):
    return _rounded(retrieve.search_table(vectors(spark, sf), 64, asked(spark, sf)))


@query(_knn_sql(QUERIES_SQL))
def knn_exact_cells(spark, sf):
    # Limits far below the defaults, so that many cells are used on small tables too.
    return _rounded(retrieve.search_table(vectors(spark, sf), 64, asked(spark, sf), broadcast_queries=0, block_rows=512))


@query(_knn_sql("q.vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 3)"))
def knn_first_vectors(spark, sf):
    return _rounded(retrieve.search_first(vectors(spark, sf), 3))


@query(_knn_sql(QUERIES_SQL))
def knn_matrix(spark, sf):
    found = retrieve.search_table(vectors(spark, sf), 64, asked(spark, sf))
    matrix = neighbours.result_matrix(found, neighbours.NEIGHBOURS)
    flat = matrix.select("query_id", F.posexplode(F.arrays_zip("distances", "vec_ids")).alias("pos", "hit"))
    return flat.select(
        "query_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("hit.vec_ids").alias("vec_id"),
        F.round("hit.distances", 6).alias("distance"),
    )


GROUP_QUERIES_SQL = f"q.label = x.label AND {QUERIES_SQL}"


@query(_knn_sql("q.label = x.label"))
def knn_grouped(spark, sf):
    return _rounded(retrieve.search_all(vectors(spark, sf), 64, group="label"))


@query(_knn_sql("q.label = x.label"))
def knn_grouped_cells(spark, sf):
    found = retrieve.search_all(vectors(spark, sf), 64, group="label", broadcast_queries=0, block_rows=50)
    return _rounded(found)


@query(_knn_sql("q.label = x.label"))
def knn_stored(spark, sf):
    path = scratch_path(spark, "grouped")
    unit = retrieve.normalized(vectors(spark, sf))
    vector_tables.write_grouped(unit, path, "label", 4)
    queries = unit.withColumnRenamed("vec_id", "query_id")
    return _rounded(retrieve.search_store(path, queries, "label"))


@query(f"""WITH {_store_sql()},
           entries AS (SELECT row_number() OVER (ORDER BY conv_id, turn, pos) - 1 AS vec_id, value_token_id, group_token_id AS g, s FROM store),
           keys AS (SELECT vec_id, g, s % 97 AS a, s * 2 % 97 AS b, s * 3 % 97 AS c, s * 4 % 97 AS d FROM entries),
           -- Of equal keys in a group only the three with the lowest ids can be among the nearest.
           lowest AS (SELECT * FROM keys QUALIFY row_number() OVER (PARTITION BY g, a, b, c, d ORDER BY vec_id) <= 3),
           asked AS (SELECT DISTINCT g, a, b, c, d FROM keys),
           hits AS (SELECT q.*, x.vec_id,
                           CAST((q.a-x.a)*(q.a-x.a) + (q.b-x.b)*(q.b-x.b) + (q.c-x.c)*(q.c-x.c) + (q.d-x.d)*(q.d-x.d) AS DOUBLE) AS distance
                    FROM asked q JOIN lowest x ON q.g = x.g),
           best AS (SELECT *, CAST(row_number() OVER (PARTITION BY g, a, b, c, d ORDER BY distance, vec_id) AS INTEGER) AS rank FROM hits)
           SELECT keys.vec_id AS query_id, rank, best.vec_id, value_token_id, distance
           FROM keys JOIN best USING (g, a, b, c, d) JOIN entries ON entries.vec_id = best.vec_id WHERE rank <= 3""")
def datastore_lookup(spark, sf):
    """Each stored key searched in the group of its source token, and the tokens found."""
    store = embed.build_datastore(encoded_pairs(spark, sf), PAIR_KEY, stand_ins.make_pair_model)
    numbered = write_scratch(datastore.number_entries(store, *PAIR_KEY), "entries")
    keys = numbered.select("vec_id", F.col("key_vector").alias("vector"), "group_token_id")
    found = neighbours.search(keys, keys.withColumnRenamed("vec_id", "query_id"), group="group_token_id")
    return found.join(numbered.select("vec_id", "value_token_id"), "vec_id")


TEMPERATURE = 50.0


@query(f"""WITH {_store_sql()},
           entries AS (SELECT row_number() OVER (ORDER BY conv_id, turn, pos) - 1 AS vec_id, value_token_id, group_token_id AS g, s FROM store),
           keys AS (SELECT vec_id, value_token_id, g, s % 97 AS a, s * 2 % 97 AS b, s * 3 % 97 AS c, s * 4 % 97 AS d FROM entries),
           hits AS (SELECT q.vec_id AS query_id, x.vec_id, x.value_token_id,
                           CAST((q.a-x.a)*(q.a-x.a) + (q.b-x.b)*(q.b-x.b) + (q.c-x.c)*(q.c-x.c) + (q.d-x.d)*(q.d-x.d) AS DOUBLE) AS distance
                    FROM keys q JOIN keys x ON q.g = x.g WHERE q.vec_id % 100 = 0),
           near AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 8),
           tops AS (SELECT *, exp((min(distance) OVER (PARTITION BY query_id) - distance) / {TEMPERATURE}) AS w FROM near),
           sums AS (SELECT query_id, value_token_id, sum(w ORDER BY w DESC) AS w FROM tops GROUP BY ALL),
           weights AS (SELECT query_id, value_token_id, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS weight FROM sums)
           SELECT query_id, value_token_id, weight FROM weights""")
def datastore_choice(spark, sf):
    """Every hundredth stored key searched among its source token's entries, and how its neighbours vote for a token."""
    store = embed.build_datastore(encoded_pairs(spark, sf), PAIR_KEY, stand_ins.make_pair_model)
    numbered = write_scratch(datastore.number_entries(store, *PAIR_KEY), "entries")
    keys = numbered.select("vec_id", F.col("key_vector").alias("vector"), "group_token_id")
    found = neighbours.search(keys, keys.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), k=8, group="group_token_id")
    chosen = datastore.choose_tokens(found, numbered, TEMPERATURE, best=8)
    return chosen.select("query_id", "value_token_id", F.round("weight", 6).alias("weight"))


@query(_knn_sql(GROUP_QUERIES_SQL))
def knn_growing(spark, sf):
    """A store that grew by two appends, with one in between that failed before its commit, and was compacted."""
    path = scratch_path(spark, "growing")
    unit = retrieve.normalized(vectors(spark, sf)).select(F.col("vec_id").alias("old_id"), "vector", "label")
    schema = unit.withColumn("vec_id", F.lit(0).cast("long")).schema
    store = growing_store.create_growing(spark, path, schema, "label", 4)
    store = store.append(unit.filter("label % 2 = 0"), "old_id", unique=True)
    store.write_generation(unit.withColumn("vec_id", F.col("old_id")))
    store = growing_store.open_growing(spark, path).append(unit.filter("label % 2 <> 0"), "old_id", unique=True)
    store = store.compact(1 << 40)
    asked = unit.filter("old_id % 100 = 0").withColumnRenamed("old_id", "query_id")
    found = retrieve.search_growing(store, asked)
    named = found.join(store.table().select("vec_id", "old_id"), "vec_id").drop("vec_id").withColumnRenamed("old_id", "vec_id")
    return _rounded(named)


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def store_directory(spark, sf):
    """Rows of each group by the directory of a growing store, over all its files."""
    path = scratch_path(spark, "growing")
    rows = vectors(spark, sf)
    store = growing_store.create_growing(spark, path, rows.schema, "label", 4)
    store = store.append(rows.filter("label < 5"), "vector", "label").append(rows.filter("label >= 5"), "vector", "label")
    return store.directory().groupBy("label").agg(F.sum("rows").alias("n"))
