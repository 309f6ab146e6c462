"""Mixing a corpus to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted by source, language and topic into cells.  The cells' tokens are
raked: scaled to the target share of each value of one margin after the other, again and
again, until the margins are met.  A document is kept with a probability proportional to its cell's raked over its
observed tokens, scaled so that the expected sample has a given share of all tokens and
capped at 1; the same id always gets the same decision.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsflow.llm.quality import SPACE
from obsflow.plans import runtime

MARGINS = ["source", "lang", "topic"]
# Largest error of a margin, relative to its target.
TOLERANCE = 1e-9
# Rounds between two looks at the margins, and two checkpoints.
STRIDE = 4
# What a text contains says its topic; the first that fits.
TOPICS = [("legal", "License"), ("table", " | "), ("markup", "***"), ("markup", "$$$"), ("contact", "@"), ("secret", "token = ")]
SHARE = 0.5
TEMPER = 0.7


def topic(text: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(s)), F.lit(t)) for t, s in TOPICS], F.lit("prose"))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), lambda x: x != "")).cast("bigint")


def _topic(text_col: str, topic_of: Column | None) -> Column:
    return topic(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) if topic_of is None else topic_of.cast("string")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_of: Column | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
                       _topic(text_col, topic_of).alias("topic"), n_words(text).alias("n_tokens"))


def tempered(cells: DataFrame, margins: list[str], power: float = TEMPER) -> DataFrame:
    """``margin, value, share``: targets that flatten the observed shares by a power below 1."""
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value"), "tokens") for m in margins])).alias("x")).select("x.*")
    per = runtime.checkpoint(long.groupBy("margin", "value").agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("s")))
    return per.join(per.groupBy("margin").agg(F.sum("s").alias("all")), "margin").select("margin", "value", (F.col("s") / F.col("all")).alias("share"))


def raked(cells: DataFrame, targets: DataFrame, margins: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (margins, tokens) with ``raked`` tokens whose margins have the target shares, and ``margin_error``.

    A value without a target keeps its observed share; shares are scaled to one.  Cells
    without tokens stay at zero.  Rounds go on until no margin is off its target by more
    than ``tolerance`` of it, or, where targets conflict, until ``STRIDE`` rounds bring the
    largest error down by less than a hundredth; ``margin_error`` is that error, the same
    on all cells, and ``margin_report`` says where it is.  There are as many cells as
    combinations of values that occur, not as documents; the cells of one value meet in a
    task, sums over all of them are totals that the driver holds as numbers.
    """
    total = float(cells.agg(F.sum(F.col("tokens").cast("double"))).first()[0] or 0)
    out = cells.withColumns({"raked": F.col("tokens").cast("double"), "total": F.lit(total)})
    for m in margins:
        t = targets.filter(F.col("margin") == m).select(F.col("value").alias("_value"), F.col("share").alias("_share"))
        seen = cells.groupBy(F.col(m).alias("_seen")).agg(F.sum("tokens").alias("_tokens"))
        each = seen.join(t, F.col("_seen").eqNullSafe(F.col("_value")), "left").select("_seen", F.coalesce("_share", F.col("_tokens") / total if total else F.lit(0.0)).alias("_share"))
        each = runtime.checkpoint(each)
        every = each.agg(F.sum("_share")).first()[0] or 1.0
        out = out.join(each, out[m].eqNullSafe(F.col("_seen")), "left").drop("_seen").withColumn(f"to_{m}", F.col("_share") / every).drop("_share")
    out, error = runtime.checkpoint(out), None
    while True:
        for _ in range(STRIDE):
            for m in margins:
                now = F.sum("raked").over(Window.partitionBy(m))
                out = out.withColumn("raked", F.when(now > 0, F.col("raked") * F.col(f"to_{m}") * total / now).otherwise(0.0))
        out = runtime.checkpoint(out)
        last, error = error, float(_errors(out, margins).agg(F.max("error")).first()[0] or 0.0)
        if error <= tolerance or last is not None and error > 0.99 * last:
            return out.withColumn("margin_error", F.lit(error))


def _errors(out: DataFrame, margins: list[str]) -> DataFrame:
    """``margin, value, share, reached, error`` of every value; the error is relative to the share, or absolute without one."""
    long = out.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value"), F.col(f"to_{m}").alias("share")) for m in margins])).alias("x"), "raked", "tokens", "total").select("x.*", "raked", "tokens", "total")
    per = long.groupBy("margin", "value", "share").agg(F.sum("raked").alias("r"), F.sum("tokens").alias("n"), F.first("total").alias("total")).filter("total > 0 and n > 0")
    reached = F.col("r") / F.col("total")
    return per.select("margin", "value", "share", reached.alias("reached"), (F.abs(reached - F.col("share")) / F.when(F.col("share") > 0, F.col("share")).otherwise(1.0)).alias("error"))


def margin_report(cells: DataFrame, margins: list[str]) -> DataFrame:
    """``margin, value, share, reached, error`` of raked cells: which targets were met, and how far off the others are.

    Values without tokens are left out; only their target tells them from others.
    """
    return _errors(cells, margins)


def calibrated(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """``cells`` (tokens, raked, total) with ``weight``, raked over observed, and ``probability``.

    The scale is the one at which expected tokens are ``share`` of all.  It starts as if no
    cell were capped; cells that pass 1 then count in full and the scale is taken from
    the others, until no more pass.  Each step is two sums.
    """
    c = cells.withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(1.0))
    scale = 0.0
    while True:
        full = F.col("weight") * scale > 1
        capped, rest, total = c.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0).cast("double")), F.sum(F.when(full, 0.0).otherwise(F.col("raked"))), F.max("total")).first()
        new = (share * total - capped) / rest if rest else None
        if new is None or new <= scale:
            break
        scale = new
    # Where all cells with tokens are capped, everything is kept.
    return c.withColumn("probability", F.lit(1.0) if new is None else F.least(F.lit(1.0), F.lit(scale) * F.col("weight")))


def drawn(id_: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _calibrated_cells(rows: DataFrame, targets: DataFrame | None, share: float, prefix: str) -> tuple[DataFrame, Callable[[list[Column]], Column]]:
    """Weight and probability of each cell under prefixed names, and how rows with margins find theirs."""
    cells = runtime.checkpoint(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    done = calibrated(raked(cells, targets if targets is not None else tempered(cells, MARGINS), MARGINS), share)
    done = runtime.checkpoint(done.select(*[F.col(c).alias(f"{prefix}{c}") for c in [*MARGINS, "weight", "probability"]]))
    return runtime.small(done), lambda columns: reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"{prefix}{m}")) for m, c in zip(MARGINS, columns, strict=True)])


def _unused(columns: list[str]) -> str:
    prefix = "_cell_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def mixed(docs: DataFrame, targets: DataFrame | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
          topic_of: Column | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, kept`` of every row.

    Without ``targets`` (margin, value, share) observed shares are tempered.  Topics come
    from ``topic_of``, a column of the table or an expression; without it from what a text
    contains.  A null source, language or topic is a value.  Null texts have no tokens.  Rows
    with the same id get the same draw.  Other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col, source_col, lang_col, topic_of)
    cells, same = _calibrated_cells(rows, targets, share, "_cell_")
    out = rows.join(cells, same([F.col(m) for m in MARGINS]), "left")
    return out.select("doc_id", *MARGINS, "n_tokens", F.round("_cell_weight", 6).alias("weight"), F.round("_cell_probability", 6).alias("probability"),
                      (drawn(F.col("doc_id")) < F.col("_cell_probability")).alias("kept"))


def sampled(docs: DataFrame, targets: DataFrame | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
            topic_of: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` keeps, with all their columns."""
    prefix = _unused(docs.columns)
    cells, same = _calibrated_cells(_rows(docs, id_col, text_col, source_col, lang_col, topic_of), targets, share, prefix)
    margins = [F.col(source_col).cast("string"), F.col(lang_col).cast("string"), _topic(text_col, topic_of)]
    return docs.join(cells, same(margins), "left").filter(drawn(F.col(id_col).cast("bigint")) < F.col(f"{prefix}probability")).select(*[docs[c] for c in docs.columns])
