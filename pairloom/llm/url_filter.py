"""URL filters with a temporal list join, natively.

List entries are dated: from its date on, an entry blocks or allows a pattern, until the next entry
of the same pattern. So each entry has a validity interval, and a capture is judged by the entries
that were active when it was fetched, whatever the list says today. A pattern's intervals are one
row, in order of time, and cut into spans of ``SPAN`` intervals; a capture meets a pattern as of its
fetch time, that is the one span, and in it the one interval, so entries of other times do not multiply it.

A pattern is a host, which also stands for all hosts below it, or a host and a path prefix of whole
segments. A capture has a key for each host above its own and for each of its path prefixes (as deep
as the list goes); keys meet patterns by equality, with the fetch time inside the interval. Of the
active entries the most specific decides: a path prefix before hosts, the longer before the shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.scratch import write_scratch

BROADCAST_BYTES = 16 << 20  # patterns and their intervals are broadcast up to here, as measured; else shuffled
SPAN = 256  # intervals of a pattern that are looked through for one capture, at most
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY + r"([^/?#:]*)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)


def _normal(pattern: Column) -> Column:
    """Host part in lower case, without closing slashes."""
    host = F.lower(F.substring_index(pattern, "/", 1))
    path = F.substring(pattern, F.length(host) + 1, 1 << 30)
    return F.regexp_replace(F.concat(host, path), r"/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, blocks, begins, ends)`` from dated entries ``(pattern, action, dated)``.

    ``ends`` is null for the last entry of a pattern. Of entries of one pattern and date, ``block``
    wins. Entries with a null are left out; other actions than ``block`` allow.
    """
    clean = (
        entries.select(_normal(F.col("pattern")).alias("pattern"), (F.col("action") == "block").alias("blocks"), F.col("dated").alias("begins"))
        .filter("pattern IS NOT NULL AND pattern != '' AND blocks IS NOT NULL AND begins IS NOT NULL")
        .groupBy("pattern", "begins")
        .agg(F.max("blocks").alias("blocks"))
    )
    return clean.select("pattern", "blocks", "begins", F.lead("begins").over(Window.partitionBy("pattern").orderBy("begins")).alias("ends"))


def keys(url: Column, deepest: int) -> Column:
    """Every pattern that would match a URL: hosts upwards, then path prefixes down to ``deepest`` segments."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.slice(F.split(path_of(url), "/"), 2, max(1, deepest))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))
    )
    own = F.when((F.size(segments) > 0) & F.lit(deepest > 0), F.array_remove(prefixes, F.concat(host, F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(hosts, own))).otherwise(F.array().cast("array<string>"))


def histories(entries: DataFrame) -> DataFrame:
    """``(pattern, begins, history, periods)`` for each span of a pattern's intervals: where the span begins, its
    intervals as ``(begins, blocks)`` in order of time, and when all spans of the pattern begin."""
    valid = intervals(entries).withColumn("n", F.row_number().over(Window.partitionBy("pattern").orderBy("begins")) - 1)
    spans = valid.groupBy("pattern", F.floor(F.col("n") / SPAN).alias("span")).agg(
        F.min("begins").alias("begins"), F.array_sort(F.collect_list(F.struct("begins", "blocks"))).alias("history")
    )
    return spans.select("pattern", "begins", "history", F.array_sort(F.collect_set("begins").over(Window.partitionBy("pattern"))).alias("periods"))


def _as_of(values: Column, at: Column, begins) -> Column:
    """The last of ``values``, which are in order of time, that begins no later than ``at``; null if none does."""
    return F.try_element_at(F.filter(values, lambda x: begins(x) <= at), F.lit(-1))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """``captures`` with ``blocked`` and ``decided_by``, the pattern that decided (null if none was active).

    A null URL, a URL without a host and a null fetch time are decided by nothing and not blocked.
    Columns of these two names are replaced; all others stay, and repeated rows stay repeated.
    Equal captures are looked up once, so a URL that fills the table is one row in the join.
    """
    held = write_scratch(histories(entries), "histories")
    size = F.octet_length("pattern") + 24 * F.size("history") + 16 * F.size("periods")
    told = held.agg(F.sum(size).alias("bytes"), F.max(F.size(F.split("pattern", "/")) - 1).alias("deepest")).first()
    small = (told["bytes"] or 0) <= BROADCAST_BYTES
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    captures = captures.drop("blocked", "decided_by")
    asked = captures.select(F.col(url).alias("asked"), F.col(at).alias("time")).filter("asked IS NOT NULL AND time IS NOT NULL").distinct()
    met = asked.select("asked", "time", F.explode(keys(F.col("asked"), told["deepest"] or 0)).alias("pattern"))
    # As of the fetch time: the span of the pattern, by equality, then the interval in it.
    periods = held.select("pattern", "periods").distinct()
    met = met.join(near(periods), "pattern").withColumn("begins", _as_of(F.col("periods"), F.col("time"), lambda x: x)).drop("periods")
    met = met.join(near(held.select("pattern", "begins", "history")), ["pattern", "begins"])
    active = met.withColumn("entry", _as_of(F.col("history"), F.col("time"), lambda x: x["begins"])).filter("entry IS NOT NULL")
    rank = F.struct(F.contains("pattern", F.lit("/")).alias("deep"), F.length("pattern").alias("long"), "pattern", F.col("entry.blocks").alias("blocks"))
    decided = active.groupBy("asked", "time").agg(F.max(rank).alias("won"))
    names = [_free(name, captures.columns) for name in ("asked", "time", "won")]
    decided = decided.select(*[F.col(c).alias(n) for c, n in zip(("asked", "time", "won"), names)])
    judged = captures.join(decided, (F.col(f"`{url}`") == F.col(names[0])) & (F.col(f"`{at}`") == F.col(names[1])), "left")
    won = F.col(names[2])
    verdict = judged.withColumns({"blocked": F.coalesce(won["blocks"], F.lit(False)), "decided_by": won["pattern"]})
    return verdict.select(*[f"`{c}`" for c in captures.columns], "blocked", "decided_by")


def _free(name: str, taken: list[str]) -> str:
    """A name that no column has, whatever the case of its letters."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


# ---------------------------------------------------------------- a list and fetch dates worked out from the pages

START = "DATE '2024-01-01'"


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date within a year, from their number."""
    return pages.select("page_id", "url", F.expr(f"date_add({START}, CAST(pmod(page_id * 7919, 365) AS INT))").alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages: listings, delistings, relistings and path exceptions."""
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).filter("host != ''").distinct()
    marked = hosts.select(
        "host",
        F.regexp_replace("host", r"^(www|m|blog)\.", "").alias("domain"),
        F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int").alias("h"),
        F.conv(F.substring(F.md5(F.regexp_replace("host", r"^(www|m|blog)\.", "")), 1, 4), 16, 10).cast("int").alias("d"),
    )
    day = lambda n: F.expr(f"date_add({START}, CAST({n} AS INT))")
    entry = lambda pattern, action, n: F.struct(F.expr(pattern).alias("pattern"), F.lit(action).alias("action"), day(n).alias("dated"))
    parts = [
        ("d % 4 < 2", entry("domain", "block", "d % 120")),
        ("d % 4 = 1", entry("domain", "allow", "d % 120 + 30 + d % 45")),
        ("d % 8 = 1", entry("domain", "block", "d % 120 + 100 + d % 50")),
        ("h % 3 = 0", entry("concat(host, '/en')", "block", "h % 200")),
        ("h % 3 = 1", entry("concat(host, '/de/')", "allow", "h % 50")),
    ]
    chosen = F.filter(F.array(*(F.when(F.expr(test), made) for test, made in parts)), lambda x: x.isNotNull())
    return marked.select(F.explode(chosen).alias("entry")).select("entry.*").distinct()


def oracle_sql() -> str:
    """The same judgement from pattern matching and the latest entry before each fetch, for DuckDB."""
    return f"""
    WITH hosts AS (SELECT DISTINCT regexp_extract(lower(url), '//([^/?#:]*)', 1) AS host FROM pages),
    m AS (SELECT host, regexp_replace(host, '^(www|m|blog)\\.', '') AS domain, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS h,
                 CAST('0x' || substr(md5(regexp_replace(host, '^(www|m|blog)\\.', '')), 1, 4) AS INTEGER) AS d FROM hosts WHERE host <> ''),
    e AS (SELECT domain AS pattern, 1 AS b, {START} + d % 120 AS dated FROM m WHERE d % 4 < 2
          UNION SELECT domain, 0, {START} + (d % 120 + 30 + d % 45) FROM m WHERE d % 4 = 1
          UNION SELECT domain, 1, {START} + (d % 120 + 100 + d % 50) FROM m WHERE d % 8 = 1
          UNION SELECT host || '/en', 1, {START} + h % 200 FROM m WHERE h % 3 = 0
          UNION SELECT host || '/de', 0, {START} + h % 50 FROM m WHERE h % 3 = 1),
    c AS (SELECT page_id, url, {START} + CAST((page_id * 7919) % 365 AS INTEGER) AS fetched, regexp_extract(lower(url), '//([^/?#:]*)', 1) AS host,
                 regexp_extract(url, '//[^/?#]*([^?#]*)', 1) || '/' AS path FROM pages),
    a AS (SELECT page_id, pattern, arg_max(b, dated * 2 + b) AS b
          FROM (SELECT c.page_id, e.pattern, e.b, date_diff('day', {START}, e.dated) AS dated FROM c JOIN e ON e.dated <= c.fetched AND
                CASE WHEN contains(e.pattern, '/') THEN starts_with(c.host || c.path, e.pattern || '/') ELSE ends_with('.' || c.host, '.' || e.pattern) END)
          GROUP BY ALL),
    w AS (SELECT page_id, arg_max(pattern, k) AS decided_by, arg_max(b, k) AS b
          FROM (SELECT *, CASE WHEN contains(pattern, '/') THEN 100000 ELSE 0 END + length(pattern) AS k FROM a) GROUP BY page_id)
    SELECT c.page_id, c.url, CAST(CAST(c.fetched AS DATE) AS VARCHAR) AS fetched, coalesce(w.b = 1, false) AS blocked, w.decided_by FROM c LEFT JOIN w USING (page_id)"""
