"""Conversations in reply order without quotations, in DataFrame functions only.

A line that starts with one or more ">" is quoted, as deep as there are of them.
Consecutive lines of one depth are a passage.  Passages and their lines are normalised
(white space, case) and hashed, and looked up among the bodies of the conversation's
messages and their lines; the original is the first message that says it, before the
quoting one.  A message replies to the original with most hits of its shallowest linked
depth, the later one of equals.  Every message is placed behind the message it replies to:
its path is the path of that message and its own turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.plans import runtime

_MARK = r"^((?:[ \t]*>)+)"


def _depth(line: Column) -> Column:
    mark = F.regexp_extract(line, _MARK, 1)
    return F.length(mark) - F.length(F.translate(mark, ">", ""))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, _MARK, ""), r"[ \t\x0B\f\r]+", " ")))


def parsed(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, body, n_quoted, own, passages``: the text without quotes, its normalised lines, and passages (depth, lines)."""
    m = messages.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"),
                        F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n").alias("lines"))
    m = m.withColumn("l", F.transform("lines", lambda x: F.struct(_depth(x).alias("d"), _normal(x).alias("t"), x.alias("raw")))).drop("lines")
    own = F.filter("l", lambda x: x["d"] == 0)
    # A quoted line begins a passage where the line before it has another depth.
    begins = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: (F.get("l", i - 1)["d"] > 0) & (F.coalesce(F.get("l", i - 2)["d"], F.lit(0)) != F.get("l", i - 1)["d"]))
    m = m.withColumn("begins", begins)

    def passage(b: Column) -> Column:
        rest = F.slice("l", b, F.size("l"))
        depth = F.get("l", b - 1)["d"]
        # Up to the first line of another depth.
        length = F.array_position(F.transform(rest, lambda x: x["d"] != depth), True)
        lines = F.when(length > 0, F.slice(rest, F.lit(1), length.cast("int") - 1)).otherwise(rest)
        return F.struct(depth.alias("depth"), F.filter(F.transform(lines, lambda x: x["t"]), lambda t: t != "").alias("lines"))

    return m.select("conv_id", "turn", "role", F.array_join(F.transform(own, lambda x: x["raw"]), "\n").alias("raw"), F.size(F.filter("l", lambda x: x["d"] > 0)).cast("bigint").alias("n_quoted"),
                    F.filter(F.transform(own, lambda x: x["t"]), lambda t: t != "").alias("own"), F.transform("begins", passage).alias("passages")).withColumn(
        # Empty lines at the ends are what quotes leave behind.
        "body", F.regexp_replace("raw", r"^\n+|\n+$", "")).drop("raw")


def _keys(lines: Column) -> Column:
    """Hashes of the passage as a whole, where it has several lines, and of its lines."""
    whole = F.when(F.size(lines) > 1, F.array(F.md5(F.array_join(lines, "\n").cast("binary")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(whole, F.transform(lines, lambda t: F.md5(t.cast("binary")))))


def replies(parts: DataFrame) -> DataFrame:
    """``conv_id, turn, parent`` of the messages that quote an earlier one of their conversation."""
    quoted = parts.filter("n_quoted > 0").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", F.col("p.depth").alias("depth"), F.explode(_keys(F.col("p.lines"))).alias("key")).distinct()
    original = parts.select("conv_id", "turn", F.explode(_keys(F.col("own"))).alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("first"))
    hits = quoted.join(original, ["conv_id", "key"]).filter("first < turn").groupBy("conv_id", "turn", "depth", "first").agg(F.count("*").alias("n"))
    return hits.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("depth")).alias("d"), "n", "first"))["first"].alias("parent"))


def paths(links: DataFrame) -> DataFrame:
    """``conv_id, turn, path`` of every message with a parent, by doubling: each round a path takes up the path of the message it has reached."""
    now = runtime.checkpoint(links.select("conv_id", "turn", F.array("turn").alias("path"), F.col("parent").alias("up")))
    while not now.filter("up is not null").isEmpty():
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("path").alias("head"), F.col("up").alias("next"))
        # A parent without a parent of its own is not among the links: it is the head.
        now = runtime.checkpoint(now.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat(F.coalesce("head", F.array("up")), "path")).alias("path"), F.col("next").alias("up")))
    return now.select("conv_id", "turn", "path")


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, body, n_quoted, parent_turn, reply_path, formatted`` of every row, sorted by conversation and reply path.

    ``reply_path`` is the turns from the first message of the thread to this one.  Null
    texts are empty, null roles format as "unknown".  Messages of a null conversation or
    turn are not linked.  Rows with the same conversation and turn are one message for
    linking and all returned.  Other columns are ignored.  The sort is by ranges, so one
    long conversation is spread over tasks.
    """
    parts = parsed(messages, conv_col, turn_col, role_col, text_col)
    links = runtime.checkpoint(replies(parts))
    place = paths(links).join(links, ["conv_id", "turn"])
    out = (parts.select("conv_id", "turn", "role", "body", "n_quoted").join(place, ["conv_id", "turn"], "left")
           .withColumn("path", F.coalesce("path", F.array("turn"))))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>"))
    return out.orderBy("conv_id", "path", "turn").select("conv_id", "turn", "role", "body", "n_quoted", F.col("parent").alias("parent_turn"),
                                                         F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("reply_path"), formatted.alias("formatted"))
