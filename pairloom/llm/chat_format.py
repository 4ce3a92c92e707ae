"""Chat formatting with typed content parts, reversible escapes and a loss mask, natively.

A conversation becomes one string. Each turn is ``<|turn|>role<|content|>body<|end|>``; the body is
its parts flattened in order: text as it is (escaped), any other part as a placeholder
``<|image:0|>`` whose number is the part's place in the conversation's ``attachments``.

Control strings inside roles and texts are broken up by a backslash: every backslash gets one in
front, and every ``<`` or ``[`` that begins a control string of this or another common template
gets one behind. Dropping one backslash before each character that has one gives the text back. Text
parts that follow each other are one text, so a control string that is dealt over several is broken up too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, CONTENT, END = "<|turn|>", "<|content|>", "<|end|>"
PART_KINDS = ("text", "image", "audio", "document")
_CONTROL = r"(\\|(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\]))"
PARTS = "array<struct<type: string, text: string, ref: string, tokens: int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _visit(part: Column, i: Column) -> Column:
    """One part's piece of the body: the text of a run of text parts at its first, nothing at the others, and a
    placeholder with its number for any other part. ``kinds`` has a letter per part, T for text."""
    run = F.length(F.regexp_extract(F.substring(F.col("kinds"), i + 1, F.size("parts")), "^T*", 0))
    told = F.array_join(F.transform(F.slice("parts", i + 1, run), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    begins = (i == 0) | (F.substring(F.col("kinds"), i, F.lit(1)) != "T")
    number = F.col("base") + F.length(F.replace(F.substring(F.col("kinds"), F.lit(1), i), F.lit("T"), F.lit("")))
    placeholder = F.concat(F.lit("<|"), escape(part["type"]), F.lit(":"), number.cast("string"), F.lit("|>"))
    return F.when(_is_text(part), F.when(begins, escape(told)).otherwise("")).otherwise(placeholder)


def format_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation from rows ``(key, turn, role, parts)``; ``parts`` has the type ``PARTS``.

    Returns key, ``formatted``; ``loss_spans``, begin and length in code points of each assistant
    turn's body; ``attachments``, in order, with turn, type, ref and ``tokens``; and
    ``expanded_tokens``, the token counts that the placeholders stand for.

    Rows go by turn, null turns first, ties by role and then content; repeated rows are repeated
    turns. Null roles, texts and parts are empty; an unknown type is a placeholder as well. A row
    with a null key belongs to no conversation and comes out on its own. Columns beyond these are ignored.
    """
    rows = turns.select(
        F.col(key).alias("key"), F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("alone"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("parts", F.array().cast(PARTS)).alias("parts"),
    )
    attached = F.filter("parts", lambda p: ~_is_text(p))
    kinds = F.array_join(F.transform("parts", lambda p: F.when(_is_text(p), "T").otherwise("A")), "")
    pieces = rows.withColumns({"attached": attached, "kinds": kinds, "shape": F.to_json("parts")})
    order = Window.partitionBy("key", "alone").orderBy("turn", "role", "shape")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = pieces.withColumns(
        {"n": F.row_number().over(order), "base": F.sum(F.size("attached")).over(so_far) - F.size("attached")}
    )
    body = F.array_join(F.transform("parts", _visit), "")
    framed = numbered.withColumn("body", body).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(CONTENT)))
    framed = framed.withColumn("width", F.length("head") + F.length("body") + len(END))
    framed = framed.withColumn("begin", F.sum("width").over(so_far) - F.length("body") - len(END))
    turn_rows = F.array_sort(
        F.collect_list(
            F.struct(
                "n",
                F.concat("head", "body", F.lit(END)).alias("line"),
                (F.col("role") == "assistant").alias("learned"),
                F.col("begin").alias("begin"),
                F.length("body").cast("long").alias("length"),
                F.transform("attached", lambda p: F.struct(F.col("turn"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attached"),
            )
        )
    )
    return (
        framed.groupBy("key", "alone")
        .agg(turn_rows.alias("lines"))
        .select(
            F.col("key").alias(key),
            F.array_join(F.col("lines.line"), "").alias("formatted"),
            F.transform(F.filter("lines", lambda x: x["learned"]), lambda x: F.struct(x["begin"].alias("begin"), x["length"].alias("length"))).alias("loss_spans"),
            F.flatten(F.col("lines.attached")).alias("attachments"),
        )
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + F.coalesce(a["tokens"], F.lit(0))))
    )


def read_turns(formatted: Column) -> Column:
    """Roles and bodies read back from a formatted conversation, unescaped."""
    lines = F.split(formatted, r"<\|turn\|>")
    return F.transform(
        F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda line: F.struct(
            unescape(F.substring_index(line, CONTENT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(line, CONTENT, -1), END, 1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["begin"] + 1, s["length"]))), "")


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its turn."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("tokens")))


CONTROL_ROWS = "(-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"


def typed_parts(text: Column, role: Column, turn: Column, key: Column) -> Column:
    """A turn's text in two halves, with an attachment between words and end: images of users, audio of assistants,
    documents of others. Halves may part a control string."""
    half = (F.length(text) / 2).cast("int")
    none = F.lit(None).cast("string")
    part = lambda kind, told, ref, tokens: F.struct(kind.alias("type"), told.alias("text"), ref.alias("ref"), tokens.cast("int").alias("tokens"))
    kind = F.when(role == "user", "image").when(role == "assistant", "audio").otherwise("document")
    ref = F.concat(key.cast("string"), F.lit("/"), F.coalesce(turn.cast("string"), F.lit("")))
    halves = (F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))
    texts = [part(F.lit("text"), h, none, F.lit(None)) for h in halves]
    return F.array(*texts, part(kind, none, ref, F.coalesce(turn, F.lit(0)) % 7 + 100))


def format_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted string: turns, loss text and length; then the same with typed
    parts: turns with their placeholders, number, references and expanded tokens of the attachments."""
    text = F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", "role", text_parts(text).alias("parts"))
    done = format_turns(turns).select("conv_id", "formatted", "loss_spans").withColumns(
        {"read": read_turns(F.col("formatted")), "loss": masked_text(F.col("formatted"), F.col("loss_spans"))}
    )
    told = lambda read: F.array_join(F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    plain = done.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(told("read"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    parts = typed_parts(text, F.coalesce("role", F.lit("")), F.col("turn"), F.col("conv_id"))
    typed = format_turns(conversations.select("conv_id", "turn", "role", parts.alias("parts"))).select(
        F.col("conv_id").alias("typed_id"),
        F.sha2(told(read_turns(F.col("formatted"))), 256).alias("typed_sha256"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.sha2(F.array_join(F.transform("attachments", lambda a: F.concat(a["type"], F.lit(" "), a["ref"])), "\n"), 256).alias("refs_sha256"),
        "expanded_tokens",
    )
    return plain.join(typed, plain["conv_id"] == typed["typed_id"], "left").drop("typed_id")


def oracle_sql() -> str:
    """The digests worked out without a formatted string, and its length from the rules, for DuckDB."""
    control = r"(\\|<\||<s>|</s>|\[INST\]|\[/INST\])"
    widened = f"length({{0}}) + len(regexp_extract_all({{0}}, '{control}'))"
    frame = len(TURN) + len(CONTENT) + len(END)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    n AS (SELECT *, CASE role WHEN 'user' THEN 'image' WHEN 'assistant' THEN 'audio' ELSE 'document' END AS kind,
                 row_number() OVER (PARTITION BY conv_id {order}) - 1 AS i FROM t),
    g AS (SELECT conv_id, count(*) AS n_turns,
                 sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
                 coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS loss,
                 CAST(sum({frame} + {widened.format('role')} + {widened.format('text')}) AS BIGINT) AS formatted_chars,
                 sha256(string_agg(role || chr(10) || text || '<|' || kind || ':' || i || '|>' || chr(10), '' {order})) AS typed_sha256,
                 count(*) AS n_attachments,
                 sha256(string_agg(kind || ' ' || conv_id || '/' || coalesce(CAST(turn AS VARCHAR), ''), chr(10) {order})) AS refs_sha256,
                 CAST(sum(coalesce(turn, 0) % 7 + 100) AS BIGINT) AS expanded_tokens
          FROM n GROUP BY conv_id)
    SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
           typed_sha256, n_attachments, refs_sha256, expanded_tokens FROM g"""
