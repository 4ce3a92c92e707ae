"""Benchmark decontamination: short test items found inside long documents, natively.

1. Items are partitioned by their number of shingles into classes of powers of two. An item is
   contained if a share of at least ``containment`` of its shingles occurs in the document, so at
   most ``n - ceil(containment * n)`` may be missing. The item's MinHash sketch is that many of its
   shingles, those of smallest hash, counted for the largest size of its class, and ``need`` more: a
   containing document holds at least ``need`` of them. Classes of longer items need more, so that one
   common shingle makes no candidate. No item is lost, however long the document.
2. Shingle hashes of every document meet the sketches by an equality join; a document and an item with
   as many hits as the item's class needs are a candidate.
3. Candidates are verified on the whole document: shingles as text, counted exactly.

An item of fewer words than a shingle is one shingle of its own width, and is looked for in the
documents at that width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import texts
from pairloom.scratch import write_scratch

BROADCAST_BYTES = 32 << 20  # what the items' shingles may measure for their side of joins to be broadcast; else shuffled
LEAKY = 1_000_000  # documents with an item that are broadcast to the texts, at some 70 bytes each
_ROW_BYTES = 64  # of a row besides its shingle's text


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; punctuation and white space only separate."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, make) -> Column:
    """``make(value)`` with the value worked out once, however often ``make`` uses it.

    A named column is no such promise: the optimizer may write its expression into every use,
    and inside a lambda that is once per element.
    """
    return F.transform(F.array(value), make)[0]


def _windows(items: Column, width: int | Column, make) -> Column:
    """``make(array, start)`` of each window; none if there are fewer elements than ``width``, or none."""
    wide = F.lit(width) if isinstance(width, int) else width

    def windows(array: Column) -> Column:
        last = F.size(array) - wide
        return F.when((wide > 0) & (last >= 0), F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make(array, i))).otherwise(F.array())

    return let(items, windows)


def shingle_hashes(text_words: Column, width: int) -> Column:
    """Hash of each window of words, by way of word hashes."""
    hashed = F.transform(text_words, lambda w: F.xxhash64(w))
    return _windows(hashed, width, lambda a, i: F.xxhash64(*(F.get(a, i + j) for j in range(width))))


def shingles(text_words: Column, width: int | Column) -> Column:
    """Text of each window of words, without repeats."""
    return F.array_distinct(_windows(text_words, width, lambda a, i: F.array_join(F.slice(a, i + 1, F.lit(width) if isinstance(width, int) else width), " ")))


def own_width(text_words: Column, width: int) -> Column:
    """The width of an item's shingles: all of its words, if they are fewer."""
    return F.least(F.size(text_words), F.lit(width))


def sketches(items: DataFrame, width: int, containment: float, widths: list[int]) -> DataFrame:
    """``(item_key, size_class, need, hash)``: the sketch of each item; items without a word have none."""
    own = words(F.col("item_text"))
    hashes = F.lit(None).cast("array<bigint>")
    for w in widths:
        hashes = F.when(own_width(F.col("words"), width) == w, shingle_hashes(F.col("words"), w)).otherwise(hashes)
    sized = items.select("item_key", own.alias("words")).select("item_key", F.array_sort(F.array_distinct(hashes)).alias("hashes"))
    size_class = F.ceil(F.log2(F.size("hashes"))).cast("int")
    largest = F.pow(F.lit(2), F.col("size_class"))
    # No more than any item of the class has if it is contained.
    held = F.ceil(F.lit(containment) * (F.floor(largest / 2) + 1) - 1e-9)
    need = F.least(1 + F.floor(F.col("size_class") / 2), F.greatest(held, F.lit(1))).cast("int")
    length = (largest - F.ceil(F.lit(containment) * largest - 1e-9)).cast("int") + F.col("need")
    return (
        sized.filter(F.size("hashes") > 0)
        .withColumn("size_class", size_class)
        .withColumn("need", need)
        .select("item_key", "size_class", "need", F.explode(F.slice("hashes", 1, length)).alias("hash"))
    )


def _fits(shingle_rows: DataFrame) -> bool:
    """Whether the items' shingles, of which sketches are a part, are small enough to broadcast."""
    size = shingle_rows.agg(F.sum(F.octet_length("shingle") + _ROW_BYTES)).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    containment: float = 0.8,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``(key, item_key, n_shingles, n_found)`` of all documents that contain an item.

    ``n_shingles`` counts an item's different ``width``-word shingles, ``n_found`` those in the
    document; a pair is listed from ``n_found >= containment * n_shingles``. An item of fewer words
    is one shingle of all of them. Null and wordless texts contain nothing and are in nothing. Rows that
    share a key count as one document (or item); its texts are looked at together. Rows with a
    null key are left out: a finding needs a name.
    """
    docs = texts(docs, F.col(key).alias("doc_key"), F.col(text).alias("doc_text")).filter(F.col("doc_key").isNotNull())
    items = items.select(F.col(item_key).alias("item_key"), F.col(item_text).alias("item_text")).filter(F.col("item_key").isNotNull())
    item_words = items.select("item_key", "item_text", words(F.col("item_text")).alias("words"))
    wanted = item_words.select("item_key", F.explode(shingles(F.col("words"), own_width(F.col("words"), width))).alias("shingle")).distinct()
    wanted = write_scratch(wanted, "shingles")
    small = _fits(wanted)
    # The widths that occur, at most ``width`` numbers.
    widths = sorted(r[0] for r in item_words.select(own_width(F.col("words"), width)).distinct().collect() if r[0])
    index = write_scratch(sketches(items, width, containment, widths).select("item_key", "size_class", "need", "hash").distinct(), "sketches")
    heads = index.select("hash").distinct()
    hashed = F.concat(F.array().cast("array<bigint>"), *(shingle_hashes(F.col("doc_words"), w) for w in widths))
    seen = docs.select("doc_key", words(F.col("doc_text")).alias("doc_words")).select("doc_key", F.explode(hashed).alias("hash"))
    # Only hits go on, once per document and hash; then they meet the items of that hash.
    hits = seen.join(F.broadcast(heads) if small else heads, "hash").distinct()
    met = hits.join(F.broadcast(index) if small else index, "hash").groupBy("doc_key", "item_key", "need").agg(F.count_distinct("hash").alias("n"))
    pairs = write_scratch(met.filter("n >= need").select("doc_key", "item_key").distinct(), "candidates")
    # Verification: the shingles of the items that are candidates of a document, as text.
    sizes = wanted.groupBy("item_key").agg(F.count("*").alias("n_shingles"))
    suspects = docs.join(pairs.select("doc_key").distinct(), "doc_key")
    every = F.concat(F.array().cast("array<string>"), *(shingles(F.col("doc_words"), w) for w in widths))
    present = suspects.select("doc_key", words(F.col("doc_text")).alias("doc_words")).select("doc_key", F.explode(every).alias("shingle"))
    relevant = wanted.select("shingle").distinct()
    present = present.join(F.broadcast(relevant) if small else relevant, "shingle").distinct()
    found = (
        present.join(F.broadcast(wanted) if small else wanted, "shingle")
        .join(pairs, ["doc_key", "item_key"], "left_semi")
        .groupBy("doc_key", "item_key")
        .agg(F.count("*").alias("n_found"))
    )
    return (
        found.join(F.broadcast(sizes) if small else sizes, "item_key")
        .filter(F.col("n_found") >= F.lit(containment) * F.col("n_shingles") - 1e-9)
        .select(F.col("doc_key").alias(key), F.col("item_key").alias(item_key), "n_shingles", "n_found")
    )


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is contained; all columns stay. Rows without a key are looked at by
    their text."""
    key, text = options.pop("key", "doc_id"), options.pop("text", "text")
    name = F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.concat(F.lit("t"), F.sha2(F.col(f"`{text}`"), 256)))
    keyed = docs.select(name.alias("_name"), F.col(f"`{text}`").alias("_text"))
    item_key = options.get("item_key", "item_id")
    leaky = contained_items(keyed, items, key="_name", text="_text", **options).select(F.col("_name").alias("_leaky")).distinct()
    leaky = write_scratch(leaky, f"leaky-{item_key}")
    leaky = F.broadcast(leaky) if leaky.count() <= LEAKY else leaky  # so that texts are not shuffled for them
    return docs.join(leaky, name.eqNullSafe(F.col("_leaky")), "left_anti")


def oracle_sql(width: int = 5, containment: float = 0.8) -> str:
    """The same pairs by plain counting, for DuckDB."""
    side = """
    {s}_words AS (SELECT {k} AS k, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]+') AS w FROM {t} WHERE {k} IS NOT NULL)"""
    cut = "unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS shingle"
    return f"""
    WITH {side.format(s='d', k='doc_id', t='documents')},
    {side.format(s='i', k='item_id', t='benchmark')},
    i_sized AS (SELECT k, w, least(len(w), {width}) AS n FROM i_words WHERE len(w) > 0),
    widths AS (SELECT DISTINCT n FROM i_sized),
    i_shingles AS (SELECT DISTINCT k, {cut} FROM i_sized),
    d_shingles AS (SELECT DISTINCT k, {cut} FROM d_words, widths WHERE len(w) >= n),
    sizes AS (SELECT k, count(*) AS n_shingles FROM i_shingles GROUP BY k)
    SELECT d.k AS doc_id, i.k AS item_id, any_value(n_shingles) AS n_shingles, count(*) AS n_found
    FROM d_shingles d JOIN i_shingles i USING (shingle) JOIN sizes s ON s.k = i.k
    GROUP BY d.k, i.k HAVING count(*) >= {containment} * any_value(n_shingles) - 1e-9"""
