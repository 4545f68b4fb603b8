"""Chat formatting by event sourcing: conversation logs are folded into final messages, which are then rendered.

An event is (conv_id, seq, kind, message, role, text). Kinds:
  message     starts the message with the whole text;
  delta       appends a streamed piece (and starts the message, if nothing did);
  edit        replaces the message's text;
  regenerate  replaces it too, usually by a first piece or by nothing, with deltas to follow.
An edit or a regeneration also discards every later message that existed by then: the conversation goes on from there.
``message`` is a message's place in its conversation. In a table of plain turns each row is a ``message`` event.

Events are sorted by seq; of those with the same seq the text decides, so the order of the rows doesn't matter. The fold
is written as windows over a conversation's log: an event counts if no earlier message was edited or regenerated after
it, and a message's text is what follows its last replacement.

Cases: events with a null conversation, message or seq are left out; a null kind is a message; a null text is empty; a
null role is rendered as "user"; repeated equal events count once; a message without text is left out of the rendering;
an empty log gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

REPLACING = ("message", "edit", "regenerate")


def turns_as_events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    return turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("seq"), F.lit("message").alias("kind"),
        F.col(turn_col).cast("long").alias("message"), F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    )


def messages(events: DataFrame) -> DataFrame:
    """The final messages: (conv_id, message, role, text)."""
    e = (
        events.select("conv_id", F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.col("message").cast("long").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.col("conv_id").isNotNull() & F.col("seq").isNotNull() & F.col("message").isNotNull())
        # One shuffle, by conversation: all that follows groups by conv_id and more.
        .repartition("conv_id").dropDuplicates()
    )
    replaces = F.col("kind").isin(*REPLACING)
    branches = F.col("kind").isin("edit", "regenerate")
    earlier = W.partitionBy("conv_id").orderBy("message").rangeBetween(W.unboundedPreceding, -1)
    e = e.withColumn("cut", F.max(F.when(branches, F.col("seq"))).over(earlier)).where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    order = F.struct("seq", F.when(replaces, 0).otherwise(1).alias("late"), "text")
    own = W.partitionBy("conv_id", "message")
    e = e.withColumn("at", order).withColumn("last", F.max(F.when(replaces, F.col("at"))).over(own))
    return e.groupBy("conv_id", "message").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))), F.lit("user")).alias("role"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(F.col("last").isNull() | (F.col("at") >= F.col("last")), F.col("at")))), lambda p: p["text"])).alias("text"),
    )


def render(finals: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One row per conversation: its messages in order between role markers. Markers inside a text are broken up by a
    zero-width space, so no text can open a message."""
    safe = F.col("text")
    for mark in (start, end):
        safe = F.replace(safe, F.lit(mark), F.lit(mark[:1] + "​" + mark[1:]))
    line = F.concat(F.lit(start), F.col("role"), F.lit("\n"), safe, F.lit(end + "\n"))
    return (
        finals.where(F.col("text") != "")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("message", line.alias("line")))).alias("parts"))
        .select("conv_id", F.size("parts").cast("long").alias("n_messages"), F.concat_ws("", F.transform("parts", lambda p: p["line"])).alias("rendered"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(messages(turns_as_events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = """
SELECT conv_id, count(*) AS n_messages,
  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10)
    || replace(replace(text, '<|im_start|>', '<' || chr(8203) || '|im_start|>'), '<|im_end|>', '<' || chr(8203) || '|im_end|>')
    || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text <> ''
GROUP BY conv_id
"""
