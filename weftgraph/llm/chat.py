r"""Chat formatting by event sourcing: logs are folded into final messages, and these rendered with a loss mask.

An event is (conv_id, message_no, seq, kind, role, text). Within a message events apply in the order of seq:
`message` and `edit` set the text, `delta` appends to it, `regenerate` empties it. Everything stays in DataFrame
operations; what is gathered in one row is one conversation, which is the unit of the result, and so must fit in a task.

The template writes each turn as `### <role>:\n<text></turn>\n`. Within a text every backslash is doubled, `###` is
broken up as `#\##` and `</turn>` as `<\/turn>`; dropping the backslash before any character reverses it. Roles are
percent-encoded.

Defined cases: a null text is empty, a null role is an empty role, a null kind is `message`; null conv_ids form one
conversation; ties in seq are taken in the order of kind and text; repeated rows are repeated turns; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, ROLE_END, CLOSE = "### ", ":\n", "</turn>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    broken = F.regexp_replace(doubled, "#(?=##)", "#\\\\")
    return F.replace(broken, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_events(rows: DataFrame) -> DataFrame:
    """An event log that folds into the rows (conv_id, turn, role, text), as a chat service would have kept it.

    By turns a message is streamed in two deltas, streamed and broken off to be generated again, or posted short and edited.
    Events are given last first; only their seq says in which order they happened.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    half = (F.length("text") / 2).cast("int")
    named = rows.select("conv_id", F.row_number().over(order).cast("long").alias("message_no"), "role", text.alias("text"))
    left, right = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text"))

    def log(*events: tuple[str, Column]) -> Column:
        made = [F.struct(F.lit(n).cast("long").alias("seq"), F.lit(kind).alias("kind"), said.alias("said")) for n, (kind, said) in enumerate(events)]
        return F.array(*reversed(made))

    none, way = F.lit(""), F.col("message_no") % 3
    streamed = log(("message", none), ("delta", left), ("delta", right))
    again = log(("message", none), ("delta", right), ("delta", left), ("regenerate", none), ("delta", left), ("delta", right))
    edited = log(("message", left), ("edit", F.col("text")))
    events = named.select("conv_id", "message_no", "role", F.explode(F.when(way == 0, streamed).when(way == 1, again).otherwise(edited)).alias("e"))
    return events.select("conv_id", "message_no", "e.seq", "e.kind", "role", F.col("e.said").alias("text"))


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, message_no, role, text): the text that each message ends up with."""
    event = F.struct(
        "seq",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("role", F.lit("")).alias("role"),
    )
    folded = events.groupBy("conv_id", "message_no").agg(F.array_sort(F.collect_list(event)).alias("log"))
    apply = lambda text, e: (
        F.when(e["kind"] == "delta", F.concat(text, e["text"])).when(e["kind"] == "regenerate", "").otherwise(e["text"])
    )
    return folded.select(
        "conv_id",
        "message_no",
        F.element_at("log", 1)["role"].alias("role"),
        F.aggregate("log", F.lit(""), apply).alias("text"),
    )


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): spans are (start, size) in code points, from 0, in order."""
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(ROLE_END))
    parts = messages.select(
        "conv_id", "message_no", F.col("role") == learn_role, head.alias("head"), escape(F.col("text")).alias("body")
    ).toDF("conv_id", "message_no", "learn", "head", "body")
    order = Window.partitionBy("conv_id").orderBy("message_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(CLOSE)
    placed = parts.withColumn("start", F.coalesce(F.sum(size).over(order), F.lit(0)) + F.length("head"))
    piece = F.struct("message_no", "learn", "start", F.length("body").cast("long").alias("size"), "head", "body")
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    span = lambda t: F.struct(t["start"].alias("start"), t["size"].alias("size"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias(
            "formatted"
        ),
        F.transform(F.filter("turns", lambda t: t["learn"]), span).alias("loss_spans"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold_messages(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_texts, formatted), parsed from the rendered text alone."""
    cut = F.split("formatted", CLOSE, -1)
    turn = lambda t: F.struct(
        F.url_decode(F.substring_index(t, ROLE_END, 1).substr(F.lit(len(OPEN) + 1), F.length(t))).alias("role"),
        unescape(t.substr(F.instr(t, ROLE_END) + len(ROLE_END), F.length(t))).alias("text"),
    )
    cuts = formatted.select("conv_id", "formatted", "loss_spans", cut.alias("cuts"))
    return cuts.select(
        "conv_id",
        F.transform(F.slice("cuts", 1, F.size("cuts") - 1), turn).alias("turns"),
        F.transform(
            "loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["size"].cast("int")))
        ).alias("loss_texts"),
        "formatted",
    )


ORACLE = r"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(url_encode(role)) + length('### ' || ':' || chr(10) || '</turn>' || chr(10))
    + length(replace(regexp_replace(replace(text, '\', '\\'), '(?:#{3,})', '#', 'g'), '</turn>', '<\/turn>')) AS short
    , list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: 2 * length(x) - 3)) AS hashes
  FROM all_rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(short + coalesce(hashes, 0))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
