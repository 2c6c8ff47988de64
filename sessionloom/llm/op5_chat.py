r"""Chat formatting from an event log: fold events into messages, then render conversations with a loss mask.

Events are ``(conv_id, message, turn, seq, kind, role, text)``. Kinds: ``message`` and ``edit`` set a message's text, ``delta``
appends to it, ``regenerate`` starts it anew and takes back all messages of later turns written before it. Events fold in
order of ``seq``, message by message, so a conversation of any length is sorted only as finished messages.

The template writes ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end for each message. Control strings
inside texts (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) get one backslash after their first
character; those that have backslashes there already get one more, so taking one away restores every text. Spans of the
assistant's texts, in code points of the rendered string, are the loss mask.

Defined cases: null texts are empty; a null role is an empty one; rows that repeat a turn are messages of their own, ordered by
role and text; null turns come first; rows of a null ``conv_id`` are one conversation. Other columns are ignored. Empty tables
give the added conversation alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

# The template's marks and the control strings that texts must not hold as they are.
START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = r"([<\[])(\\*)" + _CONTROL
_UNESCAPE = r"([<\[])(\\*)\\" + _CONTROL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _role(role: Column) -> Column:
    """A role on one line, reversibly."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_back(role: Column) -> Column:
    """What ``_role`` was made from: a backslash and n is a line end unless the backslash is one of a pair."""
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def events_of(rows: DataFrame) -> DataFrame:
    """The log of a table of finished rows ``(conv_id, turn, role, text)``: a message opens and its text streams in two deltas."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("message").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.substring(text, F.lit(1), half).alias("text")),
        F.struct(F.lit(2).alias("step"), F.lit("delta").alias("kind"), F.substring(text, half + 1, F.length(text)).alias("text")))
    named = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text",
        F.monotonically_increasing_id().alias("message"))
    return named.select("conv_id", "message", "turn", "role", F.explode(parts).alias("e")).select(
        "conv_id", "message", "turn", (F.coalesce("turn", F.lit(-1).cast("long")) * 4 + F.col("e.step")).alias("seq"), "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` of the messages that stand at the end of the log."""
    steps = F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    messages = events.groupBy("conv_id", "message").agg(
        F.min("turn").alias("turn"), F.min("role").alias("role"), F.max("seq").alias("last"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("anew"), steps.alias("steps"))
    # the last event that sets the text, and everything appended after it
    from_ = F.aggregate("steps", F.lit(-1).cast("long"), lambda at, s: F.when(s["kind"] != "delta", s["seq"].cast("long")).otherwise(at))
    messages = messages.withColumn("from", from_)
    text = F.array_join(F.transform(F.filter("steps", lambda s: (s["seq"] >= F.col("from")) & (s["kind"] != "regenerate")), lambda s: s["text"]), "")
    messages = messages.select("conv_id", "turn", "role", "last", "anew", text.alias("text"))
    # a message falls if an earlier turn was generated anew after the message's last event
    back = messages.where("anew is not null").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "anew")).alias("back"))
    fallen = F.exists(F.coalesce("back", F.array().cast("array<struct<turn: bigint, anew: bigint>>")),
                      lambda b: (b["turn"] < F.col("turn")) & (b["anew"] > F.col("last")))
    joined = messages.join(back.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.where(~fallen).select("conv_id", "turn", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)``: the rendered string and the spans of assistant texts in it, start and length in code points."""
    whole = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    parts = messages.select(
        "conv_id", "turn", "role", "text", whole.alias("part"), (F.length(_role(F.col("role"))) + len(START) + 1).alias("before"),
        F.length(escape(F.col("text"))).alias("size"), (F.col("role") == "assistant").alias("learn"))
    rows = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "part", "before", "size", "learn"))).alias("m"))
    formatted = F.array_join(F.transform("m", lambda x: x["part"]), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, size: int, learn: boolean>>").alias("spans"))
    spans = F.aggregate("m", start, lambda acc, x: F.struct(
        (acc["at"] + F.length(x["part"])).alias("at"),
        F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["before"]).alias("start"), x["size"].alias("size"), x["learn"].alias("learn")))).alias("spans")),
        lambda acc: F.transform(F.filter(acc["spans"], lambda s: s["learn"]), lambda s: F.struct(s["start"], s["size"])))
    return rows.select("conv_id", formatted.alias("formatted"), spans.alias("loss"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and one added, read back from the rendered strings and masks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = render(fold(events_of(rows.unionByName(added))))
    turn = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
    roles, texts = (F.regexp_extract_all("formatted", F.lit(turn), F.lit(i)) for i in (1, 2))
    back = F.zip_with(roles, texts, lambda r, t: F.concat(
        _role_back(r), F.lit("\n"), unescape(t), F.lit("\n")))
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["size"]))), "")
    return done.select("conv_id", "formatted", roles.alias("roles"), back.alias("turns"), learned.alias("learned")).select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_PAT = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
QUERIES = {"op5_chat_format": op5_chat_format}
SQL = {"op5_chat_format": rf"""
WITH rows AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length('<|im_start|><|im_end|>') + 2 + length(regexp_replace(role, '{_PAT}', '\1\2\\\3', 'g'))
  + length(regexp_replace(text, '{_PAT}', '\1\2\\\3', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""}
