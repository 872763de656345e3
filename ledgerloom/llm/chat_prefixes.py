"""Chat formatting: every assistant turn becomes an example with all turns before it as context.

A conversation's text is the sequence of its turns, each written as

    ### <role, percent-encoded>
    <text, control strings escaped>
    </turn>

Within texts a backslash is put before every backslash, ``###`` and ``</turn>``; so a
line ``</turn>`` only ever ends a turn, and ``unescape`` gives the text back. Only the
reply's own characters are trainable (the loss mask); its header and end line are not.

``format_conversations`` gives each conversation's text and the place of each turn in it.
``prefix_examples`` explodes that: a row per assistant turn with the text of all turns up
to its end and the loss mask. The digests of the loss are read back from these examples.
The examples of a conversation are together as long as the square of its turns, which is
what the method asks for; they are cut out row by row, so a task holds the conversation and
one example at a time. A conversation has to fit a row, as it is one training text.

Edge cases: null texts and roles are empty; turns are ordered by turn (nulls first), role
and text, so ties are equal rows; a conversation without assistant turns has no examples,
and an empty loss. Each row with a null conv_id is a conversation of its own. Columns other
than conv_id, turn, role and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import inputs

TRAINABLE = "assistant"
END = "\n</turn>\n"
KEY = ["conv_id", "lone"]
_CONTROL = r"(\\|###|</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|###|</turn>)", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, lone, n, chunk, start, loss_start, loss_end): each turn's text and its characters' places.

    ``n`` counts the turns from 1; ``start`` is the number of characters before the turn,
    the reply's characters are those from ``loss_start`` up to ``loss_end`` (null unless
    the turn is trainable). ``lone`` numbers the rows without a conv_id and is null for others.
    """
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = conversations.select("conv_id", lone.alias("lone"), "turn", inputs.whole_text("role").alias("role"), inputs.whole_text("text").alias("text"))
    order = Window.partitionBy(*KEY).orderBy("turn", "role", "text")
    head = F.concat(F.lit("### "), F.url_encode("role"), F.lit("\n"))
    written = turns.select(*KEY, "role", F.row_number().over(order).alias("n"), head.alias("head"), escape(F.col("text")).alias("body"))
    placed = written.withColumn("chunk", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy(*KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum(F.length("chunk").cast("long")).over(before), F.lit(0)))
    begin = F.when(F.col("role") == TRAINABLE, F.col("start") + F.length("head"))
    return placed.select(*KEY, "n", "chunk", "start", begin.alias("loss_start"), (begin + F.length("body")).alias("loss_end"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, lone, formatted, turns): each conversation's text, and its turns' places without their texts."""
    whole = format_turns(conversations).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("n", "chunk", "start", "loss_start", "loss_end"))).alias("turns")
    )
    place = lambda t: F.struct(t["n"].alias("n"), t["start"].alias("start"), (t["start"] + F.length(t["chunk"])).alias("end"), t["loss_start"].alias("loss_start"), t["loss_end"].alias("loss_end"))
    return whole.select(*KEY, F.array_join(F.transform("turns", lambda t: t["chunk"]), "").alias("formatted"), F.transform("turns", place).alias("turns"))


def prefix_examples(formatted: DataFrame, keep: Sequence[str] = (), outer: bool = False) -> DataFrame:
    """A row per trainable turn of ``format_conversations``: conv_id, lone, target, text, loss_start, loss_end, and ``keep``.

    ``text`` is that of all turns up to the target's end. With ``outer`` a conversation
    without trainable turns gives a row with a null target and text.
    """
    targets = F.filter("turns", lambda t: t["loss_start"].isNotNull())
    rows = formatted.select(*KEY, *keep, "formatted", (F.explode_outer if outer else F.explode)(targets).alias("t"))
    return rows.select(
        *KEY, *keep, F.col("t.n").alias("target"), F.substring("formatted", F.lit(1), F.col("t.end").cast("int")).alias("text"), "t.loss_start", "t.loss_end"
    )


def read_turns(text: Column) -> Column:
    """The (role, text) of every turn of a formatted conversation."""
    ended = F.split(text, END, -1)
    parts = F.slice(ended, F.lit(1), F.size(ended) - 1)  # after the last end there is nothing
    role = lambda p: F.url_decode(F.substring(F.substring_index(p, "\n", 1), F.lit(5), F.length(p)))
    body = lambda p: F.substring(p, F.instr(p, "\n") + 1, F.length(p))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), unescape(body(p)).alias("text")))


def masked_text(text: Column, loss_start: Column, loss_end: Column) -> Column:
    """The text under an example's loss mask, escapes undone."""
    return unescape(F.substring(text, (loss_start + 1).cast("int"), (loss_end - loss_start).cast("int")))


def count_turns(text: Column) -> Column:
    """How many turns a formatted text has."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(END), F.lit("")))) / len(END)).cast("long")


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation the digest of its turns, read back from its text, and of its trainable text, read back from its examples."""
    whole = format_conversations(conversations)
    flat = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    facts = {
        "n_turns": count_turns(F.col("formatted")), "turns_sha256": F.sha2(flat, 256), "formatted_chars": F.length("formatted").cast("long"),
    }
    read = whole.select("*", *(c.alias(n) for n, c in facts.items()))
    examples = prefix_examples(read, list(facts), outer=True)
    reply = masked_text(F.col("text"), F.col("loss_start"), F.col("loss_end"))
    rows = examples.select(
        *KEY, *facts, "target", F.coalesce(reply, F.lit("")).alias("reply"), F.length("text").cast("long").alias("chars"), (count_turns(F.col("text")) - 1).alias("context")
    )
    one = rows.groupBy(*KEY).agg(
        *(F.first(n).alias(n) for n in facts), F.array_sort(F.collect_list(F.struct("target", "reply"))).alias("replies"), F.count("target").alias("n_examples"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("example_chars"), F.coalesce(F.sum("context"), F.lit(0)).alias("context_turns"),
    )
    loss = one.withColumn("loss", F.array_join(F.transform("replies", lambda r: r["reply"]), ""))
    return loss.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
        "n_examples", "example_chars", "context_turns",
    )


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one that holds the template's own control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise(TRAINABLE)
    hostile = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digests(inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile))


OP4_SQL = r"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
e AS (SELECT *, length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) AS body,
  length(url_encode(role)) + 5 AS head FROM c),
p AS (SELECT *, row_number() OVER w - 1 AS before, sum(head + body + 9) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends
  FROM e WINDOW w AS (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(head + body + 9) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples,
  CAST(coalesce(sum(ends) FILTER (role = 'assistant'), 0) AS BIGINT) AS example_chars,
  CAST(coalesce(sum(before) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_turns
FROM p GROUP BY conv_id, lone
"""
