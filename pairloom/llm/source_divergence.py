"""How far the sources of a language are from each other, and which terms make a source stand out.

Every source of a language is a smoothed distribution over the language's kept terms. Two sources are
compared over all kept terms, also those that neither has much of, without looking at most of them:

1. Kept terms of a language are numbered by falling frequency, so that rare terms, which a source
   mostly lacks, stand next to each other.
2. The numbers are cut into blocks. In a block each source's counts are the leaves of a segment tree.
   Trees are *hash-consed*: a node is known by its two children alone, whatever its place or source,
   so equal runs of counts are one node. All levels are numbered at once with arrays.
3. Two sources' trees are walked together from the roots. A pair of nodes that comes again, anywhere
   in the block, is opened once (level by level, the distinct pairs are kept), priced once at the
   leaves, and its price is remembered for every place on the way up. Sources whose trees and totals are
   equal share whole walks.
4. Prices are added up over blocks. All of it is in whole numbers.

A task gets one block of up to ``BLOCK`` terms and two chunks of up to ``CHUNK`` sources, so neither a
long vocabulary nor many sources make a task grow. Counts are combined in each task before they are
shuffled, so a hot source sends no more than its terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import texts
from pairloom.operators.row_index import index_rows
from pairloom.scratch import write_scratch
from pairloom.session import ship_package

LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
BLOCK = 1 << 12  # terms of a tree; a power of two
CHUNK = 48  # sources of one side of a cell, about
KEPT_BYTES = 32 << 20  # kept terms are sent to the workers up to this size, as measured; beyond it, all terms are counted and joined
HELD = 200_000  # distinct terms that a task combines before it sends them on
SLICE = 1 << 22  # bytes of a long text that are cut into terms at a time
BROADCAST_GROUPS = 100_000  # languages or groups of a list that is broadcast

# Term bytes stay, A-Z in lower case; all other ASCII characters become blanks.
_FOLD = bytes(
    x + 32 if 0x41 <= x <= 0x5A else x if x >= 0x80 or 0x61 <= x <= 0x7A else 0x20 for x in range(256)
)


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text's UTF-8 form, in lists: runs of ASCII letters and all characters beyond ASCII."""
    begin = 0
    while len(data) - begin > SLICE:
        folded = data[begin : begin + SLICE].translate(_FOLD)
        end = folded.rfind(b" ") + 1
        if not end:  # one term longer than a slice
            end = len(data) - begin
            folded = data[begin:].translate(_FOLD)
        yield folded[:end].split()
        begin += end
    yield data[begin:].translate(_FOLD).split()


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    made = [pa.array(c, pa.binary()).cast(pa.string()) if name == "term" else pa.array(c, kind) for c, (name, kind) in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(made, [name for name, _ in schema])


def _count_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term in each language, combined over a task's share."""
    held: dict[str, Counter] = {}
    schema = [("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64())]

    def emit() -> pa.RecordBatch:
        rows = [(lang, term, n) for lang, docs in held.items() for term, n in docs.items()]
        held.clear()
        return _rows(schema, rows)

    for batch in batches:
        for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data")):
            own: set[bytes] = set()
            for words in terms_of(data.as_py()):
                own.update(words)
            held.setdefault(lang, Counter()).update(own)
        if sum(map(len, held.values())) > HELD:
            yield emit()
    yield emit()


def _count_terms(kept: Broadcast | None):
    """Occurrences of each kept term (without a list, of each term) in each group, combined over a task's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Counter] = {}
        schema = [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64())]

        def emit() -> pa.RecordBatch:
            rows = [(lang, source, term, n) for (lang, source), seen in held.items() for term, n in seen.items()]
            held.clear()
            return _rows(schema, rows)

        for batch in batches:
            for lang, source, data in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("data")):
                seen = held.setdefault((lang, source), Counter())
                wanted = None if kept is None else kept.value.get(lang, frozenset())
                for words in terms_of(data.as_py()):
                    seen.update(words if wanted is None else filter(wanted.__contains__, words))
            if sum(map(len, held.values())) > HELD:
                yield emit()
        yield emit()

    return run


def _listed(kept: DataFrame) -> Broadcast | None:
    """The kept terms by language for the workers, if they are as few as measured here; else nothing."""
    size = kept.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    if size > KEPT_BYTES:
        return None
    held: dict[str, set[bytes]] = {}
    for row in kept.select("lang", "term").toLocalIterator():
        held.setdefault(row["lang"], set()).add(row["term"].encode())
    return kept.sparkSession.sparkContext.broadcast({lang: frozenset(terms) for lang, terms in held.items()})


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcasting if it is as short as a list of groups usually is."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


# ---------------------------------------------------------------- trees


class Trees:
    """Hash-consed segment trees over the rows of a matrix of counts; its width is a power of two."""

    def __init__(self, counts: np.ndarray):
        self.leaves, nodes = np.unique(counts, return_inverse=True)
        nodes = nodes.reshape(counts.shape)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        size = len(self.leaves)
        while nodes.shape[1] > 1:
            keys, nodes_up = np.unique(nodes[:, ::2] * size + nodes[:, 1::2], return_inverse=True)
            self.left.append(keys // size)
            self.right.append(keys % size)
            nodes, size = nodes_up.reshape(len(counts), -1), len(keys)
        self.roots = nodes[:, 0]

    def price(self, a: int, b: int, of_a: np.ndarray, of_b: np.ndarray) -> int:
        """Sum over all places of ``abs(of_a - of_b)``, given the value of every leaf for either tree."""
        x, y, back = self.roots[[a]], self.roots[[b]], []
        for left, right in zip(reversed(self.left), reversed(self.right)):
            x, y = np.concatenate((left[x], right[x])), np.concatenate((left[y], right[y]))
            size = int(y.max()) + 1
            pairs, places = np.unique(x * size + y, return_inverse=True)
            x, y = pairs // size, pairs % size
            back.append(places)
        prices = np.abs(of_a[x] - of_b[y])
        for places in reversed(back):
            half = len(places) // 2
            prices = prices[places[:half]] + prices[places[half:]]
        return int(prices[0])


def _values(leaves: np.ndarray, total: int, terms: int, smoothing: int, scale: int) -> np.ndarray:
    """Value of each count in a group of this total, exactly; places without a term (-1) have value 0."""
    whole = total + smoothing * terms
    return np.array([0 if n < 0 else 1 + scale * (n + smoothing) // whole for n in leaves.tolist()], np.int64)


def _price_cells(smoothing: int, scale: int):
    """Prices of all pairs of groups of a cell. Rows with a total tell the groups, the others their counts."""

    def run(cell: pa.Table) -> pa.Table:
        names = cell.column("source").to_pylist()
        total, sides = cell.column("total").to_pylist(), cell.column("chunk").to_pylist()
        heads = sorted((sides[i], names[i], total[i]) for i in range(len(names)) if total[i] is not None)
        lang, low, high = (cell.column(c)[0].as_py() for c in ("lang", "low", "high"))
        size, terms = (cell.column(c).combine_chunks().drop_null()[0].as_py() for c in ("size", "terms"))
        at = {name: i for i, (_, name, _) in enumerate(heads)}
        width = 1 << max(0, size - 1).bit_length()
        counts = np.full((len(heads), width), -1, np.int64)
        counts[:, :size] = 0
        own = cell.filter(pa.compute.is_null(cell.column("total")))
        rows = np.array([at[s] for s in own.column("source").to_pylist()], np.int64)
        counts[rows, own.column("place").to_numpy()] = own.column("n").to_numpy()
        trees = Trees(counts)
        value = [_values(trees.leaves, t, terms, smoothing, scale) for _, _, t in heads]
        known: dict[tuple, int] = {}
        out: list[tuple] = []
        for i, (side, a, total_a) in enumerate(heads):
            for j in range(i + 1, len(heads)):
                other, b, total_b = heads[j]
                if low != high and side == other:
                    continue  # met in a cell of their own chunk
                key = (int(trees.roots[i]), total_a, int(trees.roots[j]), total_b)
                if key not in known:
                    known[key] = 0 if key[:2] == key[2:] else trees.price(i, j, value[i], value[j])
                out.append((lang, a, b, known[key]))
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 3 + (pa.int64(),))], ["lang", "a", "b", "value"])

    return run


# ---------------------------------------------------------------- on Spark


def _share(n: Column, total: Column, terms: Column, smoothing: int, scale: int) -> Column:
    """The value of a count, exact for counts up to 10**28."""
    whole = (total.cast("decimal(38,0)") + terms * smoothing).cast("decimal(38,0)")
    part = ((n.cast("decimal(28,0)") + smoothing).cast("decimal(28,0)") * F.lit(scale).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", part, whole) + 1


def audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    least_docs: int = LEAST_DOCS,
    smoothing: int = SMOOTHING,
    scale: int = SCALE,
    top: int = TOP,
) -> DataFrame:
    """Rows ``(lang, source, part, item, value, rank)`` for every group of language and source that occurs.

    Kept are terms in at least ``least_docs`` documents (rows) of a language. A term that comes ``n``
    times in a group of ``N`` kept occurrences has the value
    ``1 + scale * (n + smoothing) // (N + smoothing * V)``, ``V`` being the language's kept terms.
    Part ``pair``: for each other source of the language the sum over kept terms of the absolute
    differences. Part ``term``: the terms of the group whose value is above the whole language's, by
    how much, the ``top`` first. Ties go by the item's UTF-8 bytes.

    Null texts, languages and sources are empty ones. A group without a term is there with its pairs; a
    language without a kept term has pairs of value 0. Every row is a document, repeated ones too. No
    documents give no rows. Columns other than the three are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    name = lambda column: F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"), name(text).cast("binary").alias("data"))
    given = texts(rows, "lang", "source", "data")
    docs_of = given.select("lang", "data").mapInArrow(_count_docs, "lang string, term string, docs long")
    kept = docs_of.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = write_scratch(kept.select("lang", "term"), "kept")
    # Texts are read twice, so that rare terms, which are most, are counted by language only.
    listed = _listed(kept)
    counted = given.mapInArrow(_count_terms(listed), "lang string, source string, term string, n long")
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    counts = write_scratch(counts if listed is not None else counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "counts")
    totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"))
    # Languages come one after the other, so a term's number in its language is its row less the language's first.
    numbered = index_rows(totals, "lang", F.col("total").desc(), "term", unique=["lang", "term"]).table()
    langs = write_scratch(
        numbered.groupBy("lang").agg(F.count("*").alias("terms"), F.min("row_idx").alias("begin"), F.sum("total").alias("lang_total")), "langs"
    )
    here = counts.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]).join(_small(langs.select("lang", "begin")), "lang")
    here = write_scratch(here.select("lang", "source", "term", "n", "total", (F.col("row_idx") - F.col("begin")).alias("id")), "kept-counts")
    group_totals = here.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = rows.select("lang", "source").distinct().join(group_totals, ["lang", "source"], "left").fillna(0, ["group_total"])
    groups = write_scratch(groups.join(_small(langs), "lang", "left").fillna(0, ["terms", "lang_total"]).drop("begin"), "groups")
    pairs = _pairs(here, groups, smoothing, scale)
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    pair_rows = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    known = here.join(_small(groups), ["lang", "source"])
    excess = _share(F.col("n"), F.col("group_total"), F.col("terms"), smoothing, scale) - _share(
        F.col("total"), F.col("lang_total"), F.col("terms"), smoothing, scale
    )
    above = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).filter("value > 0")
    term_rows = above.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pair_rows.union(term_rows)


def _pairs(here: DataFrame, groups: DataFrame, smoothing: int, scale: int) -> DataFrame:
    """``(lang, a, b, value)`` once for each two sources of a language."""
    # Sources are dealt over as many chunks as their language needs; two chunks meet in a cell per block.
    dealt = groups.groupBy("lang").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = _small(write_scratch(dealt, "chunks"))
    chunk = F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))

    def placed(df: DataFrame) -> DataFrame:
        met = df.join(dealt, "lang").withColumn("chunk", chunk).withColumn("other", other)
        return met.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})

    columns = ["lang", "block", "low", "high", "source", "chunk"]
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("terms") - 1) / BLOCK)))
    heads = placed(groups.filter("terms > 0").withColumn("block", blocks)).select(
        *columns, F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("n"), F.col("group_total").alias("total"),
        F.least(F.lit(BLOCK), F.col("terms") - F.col("block") * BLOCK).cast("int").alias("size"), "terms",
    )
    leaves = placed(here.withColumn("block", F.floor(F.col("id") / BLOCK))).select(
        *columns, (F.col("id") % BLOCK).cast("int").alias("place"), "n", F.lit(None).cast("long").alias("total"),
        F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("terms"),
    )
    cells = heads.union(leaves).groupBy("lang", "block", "low", "high")
    priced = cells.applyInArrow(_price_cells(smoothing, scale), "lang string, a string, b string, value long")
    # Sources of a language without a kept term differ by nothing.
    bare = groups.filter("terms = 0").select("lang", "source")
    apart = bare.select("lang", F.col("source").alias("a")).join(bare.select("lang", F.col("source").alias("b")), "lang").filter("a < b")
    priced = priced.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    summed = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return summed.union(apart.withColumn("value", F.lit(0).cast("long")))


def oracle_sql() -> str:
    """DuckDB SQL for ``audit`` over ``documents`` with its default numbers."""
    share = lambda n, total: f"1 + ({SCALE}::HUGEINT * ({n} + {SMOOTHING})) // ({total} + {SMOOTHING} * v)"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
counts AS (SELECT lang, source, t, count(*) AS n, count(DISTINCT r) AS docs
           FROM (SELECT r, lang, source, unnest(w) AS t FROM docs) GROUP BY ALL),
kept AS (SELECT lang, t, sum(n) AS total FROM counts GROUP BY lang, t HAVING sum(docs) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
sums AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
         FROM groups g LEFT JOIN (SELECT counts.* FROM counts JOIN kept USING (lang, t)) c USING (lang, source) GROUP BY ALL),
shares AS (SELECT s.lang, s.source, k.t, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 's.total')} AS p, {share('k.total', 'lang_total')} AS q
           FROM sums s JOIN kept k USING (lang) JOIN langs USING (lang)
           LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.t = k.t),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
                     FROM shares x JOIN shares y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL) d
          ON d.lang = a.lang AND d.source = a.source AND d.other = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', t, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= {TOP}"""
