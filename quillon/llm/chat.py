"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds events (conv_id, seq, turn, op, role, text):

* ``message`` adds a whole message to the turn;
* ``delta`` appends text to the turn's latest message (or begins one);
* ``edit`` replaces the turn by its text, ``regenerate`` empties the turn for new deltas; both also discard all later
  turns as they stood, since these answered what is gone.

An event counts if no later edit or regeneration concerns its turn or an earlier one. That is a least turn over the
events that follow, computed in two levels (blocks of BLOCK events, then blocks), so that a conversation with a great
part of all events is no single task's work. Deltas are folded by turn, turns rendered in blocks, and only rendered
blocks are joined into a conversation.

The template opens a message with ``<|im_start|>`` and the role on a line, and closes it with ``<|im_end|>`` and a line
break. Control strings of this and other templates inside texts get a backslash within, and backslashes are doubled, so
that texts are read back exactly. The loss mask covers assistant texts.

Null text is the empty text, a null role the empty role, a null op a message. A null conversation is one of its own.
Events of one seq are ordered by turn, op, role and text; repeated rows are repeated events. Conversations without
messages give no row. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

BLOCK = 512
#: Messages rendered together before a conversation is joined.
RENDER = 64
LOSS_ROLE = "assistant"

# The template, and control strings of common templates, which are escaped inside texts.
OPEN, CLOSE, END = "<|im_start|>", "<|im_end|>", "\n"
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]


def escape(text: Column, line: bool = False) -> Column:
    """Backslashes doubled, and one put after the first character of each control string (line: before line breaks)."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROLS, out)
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if line else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, True), F.lit("\n"), escape(text), F.lit(CLOSE + END))


def parse(formatted: Column) -> Column:
    """The array of (role, text) of a rendered conversation, unescaped."""
    split = F.split(formatted, r"\Q" + OPEN + r"\E")
    bodies = F.slice(split, F.lit(2), F.size(split) - 1)
    stop = len(CLOSE + END)

    def message(x: Column) -> Column:
        body = F.substring(x, F.lit(1), F.length(x) - stop)
        role = F.regexp_extract(body, r"^((?:\\[\s\S]|[^\\\n])*+)\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(bodies, message)


def live(events: DataFrame) -> DataFrame:
    """The events that no later edit or regeneration discards."""
    resets = F.when(F.col("op").isin("edit", "regenerate"), F.col("turn"))
    per_seq = events.groupBy("conv_id", "seq").agg(F.min(resets).alias("reset")).withColumn("_block", F.floor(F.col("seq") / BLOCK))
    # events of one seq take effect together, and don't discard each other
    within = Window.partitionBy("conv_id", "_block").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    blocks = per_seq.groupBy("conv_id", "_block").agg(F.min("reset").alias("reset"))
    beyond = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    later = blocks.select("conv_id", "_block", F.min("reset").over(beyond).alias("_beyond"))
    cuts = per_seq.select("conv_id", "seq", "_block", F.min("reset").over(within).alias("_within")).join(later, ["conv_id", "_block"])
    cuts = cuts.select("conv_id", "seq", F.least("_within", "_beyond").alias("_cut")).where("_cut is not null")
    kept = events.join(cuts, ["conv_id", "seq"], "left").where("_cut is null or turn < _cut").drop("_cut")
    return kept.select(*events.columns)


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text): the messages that the log leaves. conv_id may be anything but null."""
    own = Window.partitionBy("conv_id", "turn").orderBy("seq", "op", "role", "text")
    begins = (F.col("op") != "delta") | (F.row_number().over(own) == 1)
    cut = live(events).withColumn("_begins", begins.cast("int"))
    cut = cut.withColumn("part", F.sum("_begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("_begins") == 1, 0).otherwise(1).alias("after"), "text", "role")))
    folded = cut.groupBy("conv_id", "turn", "part").agg(pieces.alias("p"))
    return folded.select("conv_id", "turn", "part", F.col("p")[0]["role"].alias("role"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def format_events(log: DataFrame) -> DataFrame:
    """(conv_id, formatted, formatted_chars) of each conversation of an event log."""
    events = log.select(
        F.struct(F.col("conv_id")).alias("conv_id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**63))).alias("turn"),
        F.coalesce("op", F.lit("message")).alias("op"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("seq", F.coalesce("seq", F.lit(-(2**63))))
    messages = fold(events)
    rendered = messages.select("conv_id", "turn", "part", F.floor(F.col("turn") / RENDER).alias("block"), render(F.col("role"), F.col("text")).alias("r"))
    blocks = rendered.groupBy("conv_id", "block").agg(_joined("turn", "part").alias("r"))
    whole = blocks.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "r"))), lambda x: x["r"]), "").alias("formatted"))
    return whole.select(F.col("conv_id.conv_id").alias("conv_id"), "formatted", F.length("formatted").cast("bigint").alias("formatted_chars"))


def _joined(*order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "r"))), lambda x: x["r"]), "")


def as_events(conversations: DataFrame) -> DataFrame:
    """Stored messages as a log: rows by turn, each a whole message."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("op"), "role", "text")


def digests(formatted: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """What is read back from formatted conversations."""
    said = formatted.select("conv_id", "formatted_chars", parse(F.col("formatted")).alias("m"))
    turns = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("m", lambda x: x["role"] == loss_role), lambda x: x["text"]), "")
    return said.select("conv_id", F.size("m").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), "formatted_chars").select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


EXTRA = "</s>[INST] ok [/INST]"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7."""
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    stored = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return stored.unionByName(extra)


def op6_chat_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, formatted and read back."""
    return digests(format_events(as_events(_stored(spark, sf_dir))))


#: Characters of a delta, and room for the events of one turn, in the log that is made of stored conversations.
DELTA, ROOM = 40, 1_000_000


def as_stream(conversations: DataFrame) -> DataFrame:
    """Stored messages (distinct turns) as the log of a chat that ended with them: texts arrive in deltas; every third turn
    was drafted, then regenerated; another third was answered, with a message after it, before it was edited."""
    own = lambda op, text: F.struct(F.lit(op).alias("op"), F.col("turn").alias("turn"), F.col("role").alias("role"), text.alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / DELTA).cast("int")), lambda i: own("delta", F.substring(text, i * DELTA + 1, F.lit(DELTA))))
    stale = F.struct(F.lit("message").alias("op"), (F.col("turn") + 1).alias("turn"), F.lit("user").alias("role"), F.lit("an answer to what is gone").alias("text"))
    drafted = F.concat(F.array(own("delta", F.lit("a dr")), own("delta", F.lit("aft")), own("regenerate", F.lit(""))), pieces)
    edited = F.array(own("message", F.lit("not yet right")), stale, own("edit", text))
    events = F.when(F.col("turn") % 3 == 1, drafted).when(F.col("turn") % 3 == 2, edited).otherwise(pieces)
    each = conversations.select("conv_id", F.col("turn").alias("_at"), F.posexplode(events).alias("_k", "e"))
    return each.select("conv_id", (F.col("_at") * ROOM + F.col("_k")).alias("seq"), "e.turn", "e.op", "e.role", "e.text")


def chat_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 gives, from a log of deltas, edits and regenerations that ends with the same conversations."""
    return digests(format_events(as_stream(_stored(spark, sf_dir))))


def _duck_escaped(text: str, line: bool = False) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
    return f"replace({out}, chr(10), '\\' || chr(10))" if line else out


ORACLE = f"""WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{EXTRA}'), (-7, 1, 'assistant', '{EXTRA}'))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum({len(OPEN) + 1 + len(CLOSE + END)} + length({_duck_escaped("role", True)}) + length({_duck_escaped("text")}))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id"""
