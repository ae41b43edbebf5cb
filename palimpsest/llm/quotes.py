"""Quotation linking of messages, in Spark SQL functions only.

A line's quote level is the number of `>` at its head. Runs of quoted lines of one level are passages. Every
quoted line, normalised, is hashed and joined to the first message of the conversation that wrote it itself; a passage belongs
to the message that wrote most of its lines. The passages of the lowest level say what a message answers. Quotes go, and
messages come in reply order: an answer after what it answers, answers of one message by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.store import written

MARK = r"^[ \t]*((?:>[ \t]*)+)"


def _lines(text: Column) -> Column:
    """(level, body, key) of every line; key is the hash of the body in lower case with single spaces, null where blank."""

    def one(line: Column) -> Column:
        body = F.regexp_replace(line, MARK, "")
        plain = F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))
        level = F.length(F.regexp_replace(F.regexp_extract(line, MARK, 1), "[^>]", ""))
        return F.struct(level.alias("level"), body.alias("body"), F.when(plain != "", F.xxhash64(plain)).alias("key"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), one)


def link_quotes(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, quote_level, n_quotes, n_linked, reply_to, reply_path).

    text: the lines outside quotes, outer blank lines gone. quote_level: the deepest level, 0 without quotes. n_quotes, n_linked:
    passages, and those whose message was found at an earlier turn. reply_to: the turn answered, null if none. reply_path: the
    turns from the first message of the thread down to this one; sorting a conversation by it puts messages in reply order.
    Null texts are empty messages; a null turn is never answered and answers nothing; messages without conversation id form one.
    Rows that agree in conversation and turn are linked alike and each returned. Messages without linked quotes begin a thread
    of their own, so a conversation without quotes keeps its order.
    """
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"),
                           _lines(F.col(text)).alias("lines"))
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    own = F.array_distinct(F.transform(F.filter("lines", lambda x: (x["level"] == 0) & x["key"].isNotNull()), lambda x: x["key"]))
    sources = rows.where("turn is not null").select("conv_id", "turn", F.explode(own).alias("key")).groupBy("conv_id", "key").agg(
        F.min("turn").alias("source"))
    # a passage begins where the level differs from the line before
    indexed = F.transform("lines", lambda x, i: F.struct(
        x["level"].alias("level"), x["key"].alias("key"),
        ((i == 0) | (x["level"] != F.get("lines", i - 1)["level"])).cast("int").alias("head")))
    asks = rows.where(quoted & F.col("turn").isNotNull()).select("conv_id", "turn", indexed.alias("lines")).distinct()
    asks = asks.withColumn("message", F.xxhash64("lines")).select("conv_id", "turn", "message", F.posexplode("lines").alias("at", "line"))
    order = Window.partitionBy("conv_id", "turn", "message").orderBy("at")  # the lines of one message
    asks = asks.withColumn("passage", F.sum("line.head").over(order)).where("line.level > 0").select(
        "conv_id", "turn", F.xxhash64("message", "passage").alias("passage"), "line.level", "line.key")
    passages = asks.select("conv_id", "turn", "passage", "level").distinct()
    votes = asks.alias("a").join(sources.alias("s"), F.col("a.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("a.key") == F.col("s.key"))
                                 & (F.col("s.source") < F.col("a.turn"))).select("a.conv_id", "a.turn", "passage", "level", "source")
    votes = votes.groupBy("conv_id", "turn", "passage", "level", "source").count()
    linked = votes.groupBy("conv_id", "turn", "passage", "level").agg(F.max_by("source", F.struct("count", "source")).alias("source"))
    counts = passages.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    answers = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"),
                                                   F.min_by("source", F.struct("level", -F.col("source"))).alias("reply_to"))
    links = written(counts.alias("c").join(answers.alias("a"), F.col("c.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("c.turn") == F.col("a.turn")), "left")
                    .select("c.conv_id", "c.turn", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to"), "links")
    paths = reply_paths(links.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("up")))
    joined = rows.alias("r").join(links.alias("l"), F.col("r.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("r.turn") == F.col("l.turn")), "left")
    joined = joined.select("r.*", "n_quotes", "n_linked", "reply_to")
    joined = joined.alias("r").join(paths.alias("p"), F.col("r.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("r.turn") == F.col("p.turn")), "left")
    kept = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return joined.select(
        "r.conv_id", "r.turn", "role", F.regexp_replace(kept, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+\z", "").alias("text"),
        F.array_max(F.transform("lines", lambda x: x["level"])).alias("quote_level"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to",
        F.coalesce("path", F.array("r.turn")).alias("reply_path"))


def reply_paths(links: DataFrame) -> DataFrame:
    """(conv_id, turn, path) for every link (conv_id, turn, up), by pointer doubling: the path from the first turn down.

    `up` is an earlier turn, so there are no circles; the rounds grow with the logarithm of the longest chain.
    """
    now = written(links.groupBy("conv_id", "turn").agg(F.min("up").alias("up")).withColumn("path", F.array("turn")), "paths")
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("next"), F.col("path").alias("head"))
        rule = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("t"))
        now = written(now.join(above, rule, "left").select(
            "conv_id", "turn", F.col("next").alias("up"),
            F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat(F.coalesce("head", F.array("up")), "path")).alias("path")), "paths")
    return now.select("conv_id", "turn", "path")
