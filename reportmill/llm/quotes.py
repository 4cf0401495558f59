"""Chat formatting by quotation linking: who answers whom, in reply order, without the quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .common import text_of

_MARKS = r"^(?:[ \t]*>)+"
_INTRODUCES = r"(?i)(wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t\r]*$"
_BLOCK = 1024


def parsed_lines(text: Column) -> Column:
    """(level, content) per line; level counts leading quote marks, nested or spaced."""
    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, _MARKS, 0)
        return F.struct(
            (F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"),
            F.when(marks == "", raw).otherwise(F.trim(F.substring(raw, F.length(marks) + 1, F.length(raw)))).alias("content"),
        )

    return F.transform(F.split(text, "\n"), line)


def _passage(content: Column) -> Column:
    """A passage as it is compared: lower case, letters and numbers only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}]+", " "))


def _unquoted(lines: Column) -> Column:
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(
        x["content"].rlike(_INTRODUCES) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
    ))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["content"]), "\n"), r"^\n+|\n+$", "")


def parents(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, parent): the earlier message that a message quotes most.

    Each quoted passage is looked up by the hash of its normal form among what earlier
    messages of the conversation say themselves; the first that says it is its original.
    Of the lowest quote level with any original, the message quoted with most characters is
    the parent, the later of two equal ones. Quoting oneself or a later message is no link.
    """
    said = messages.filter(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.explode(parsed_lines(text_of(text))).alias("l"),
    ).select("conv", "turn", "l.level", _passage(F.col("l.content")).alias("passage")).filter("passage <> ''")
    said = said.select("conv", "turn", "level", F.xxhash64("passage").alias("hash"), F.length("passage").cast("long").alias("chars"))
    originals = said.filter("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    quoted = said.filter("level > 0").groupBy("conv", "turn", "level", "hash").agg(F.sum("chars").alias("chars"))
    linked = quoted.join(originals, ["conv", "hash"]).filter("original < turn")
    weight = linked.groupBy("conv", "turn", "level", "original").agg(F.sum("chars").alias("chars"))
    best = F.max_by("original", F.struct(-F.col("level"), "chars", "original"))
    return weight.groupBy("conv", "turn").agg(best.alias("parent"))


def roots(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, root) for every link, by doubling: each round halves the way to the root."""
    now = materialise(links.select("conv", "turn", "parent", F.col("parent").alias("root")), "quotes-roots")
    while True:
        far = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        moved = materialise(now.join(far, ["conv", "root"], "left").select(
            "conv", "turn", "parent", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"),
        ), "quotes-roots")
        now = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return now


def _positions(ordered: DataFrame) -> DataFrame:
    """Adds position: the place of (root, turn) in its conversation, from 1.

    No window holds a whole conversation: places are counted in blocks of turns, blocks in
    groups of roots, and groups in the conversation.
    """
    keyed = ordered.withColumn("block", F.floor(F.col("turn") / _BLOCK)).withColumn("group", F.floor(F.col("root") / _BLOCK))
    blocks = keyed.groupBy("conv", "group", "root", "block").agg(F.count(F.lit(1)).alias("n"))
    groups = blocks.groupBy("conv", "group").agg(F.sum("n").alias("n"))
    in_conv = W.partitionBy("conv").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("conv", "group", F.coalesce(F.sum("n").over(in_conv), F.lit(0)).alias("g"))
    in_group = W.partitionBy("conv", "group").orderBy("root", "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("conv", "group", "root", "block", F.coalesce(F.sum("n").over(in_group), F.lit(0)).alias("b"))
    offsets = blocks.join(groups, ["conv", "group"]).select("conv", "root", "block", (F.col("g") + F.col("b")).alias("offset"))
    place = F.row_number().over(W.partitionBy("conv", "root", "block").orderBy("turn"))
    return keyed.withColumn("place", place).join(offsets, ["conv", "root", "block"]).withColumn("position", F.col("offset") + F.col("place")).drop("block", "group", "place", "offset")


def thread(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, quote_depth, parent, root, position, formatted) per message.

    `text` has no quoted lines and no line that introduces a quote; `position` orders a
    conversation by thread (the message that began it) and then by turn, so an answer comes
    after what it answers. `formatted` is the message in chat markup.

    A null text counts as empty; a null conversation or turn has no parent, root or
    position; rows that repeat a (conversation, turn) share these; an empty table gives no
    rows. Quotes and originals meet on (conversation, passage) with one row per original,
    so neither a long conversation nor a common passage becomes one group.
    """
    lines = parsed_lines(text_of(text))
    links = roots(parents(messages, conv, turn, text))
    known = messages.filter(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn")).distinct()
    ordered = known.join(links, ["conv", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), lines.alias("lines")).select(
        "conv", "turn", "role", _unquoted(F.col("lines")).alias("text"), F.array_max(F.col("lines")["level"]).alias("quote_depth"),
    )
    return rows.join(_positions(ordered), ["conv", "turn"], "left").withColumn(
        "formatted", F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("user")), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    )
