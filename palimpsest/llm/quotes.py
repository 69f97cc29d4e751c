"""Quotation linking: conversations in order of reply, without their quotations.

Lines are read as mail quotes them: as many ``>`` as the level of quotation.  Lines of one level in a row are a passage.
Passages, their paragraphs, lines and sentences, normalised and hashed, are joined to the message of the same conversation
that first wrote them itself; the outermost, longest such link makes a message the reply to another.  Paragraphs and
sentences find what a mail program has wrapped anew.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import drop, written

#: The mark of a quoted line.
MARK = r"^[ \t]*(>[> \t]*)"
#: A line such as "On Monday Ann wrote:" before a quotation.
ATTRIBUTION = r"(?i)^[ \t]*(on .* wrote|le .* a écrit|am .* schrieb|el .* escribió)[ \t]*:[ \t]*$"
#: Everything but ASCII letters and digits and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates paragraphs, and the sentences of one.
PARAGRAPH, SENTENCE = r"\n[ \t]*\n", r"[.!?]+[ \t\n]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """Lower-case words one space apart."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN, " "))


def lines_of(text: Column) -> Column:
    """array<struct<level, line>> of a text."""

    def parsed(line):
        mark = F.regexp_extract(line, MARK, 1)
        return F.struct((F.length(mark) - F.length(F.regexp_replace(mark, ">", ""))).alias("level"), F.when(mark == "", line).otherwise(F.regexp_replace(line, MARK, "")).alias("line"))

    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "\n"), parsed)


def own_lines(lines: Column) -> Column:
    """The lines that are not quoted, without those that only introduce a quotation."""
    quoted = F.exists(lines, lambda x: x["level"] > 0)
    return F.transform(F.filter(lines, lambda x: (x["level"] == 0) & ~(quoted & x["line"].rlike(ATTRIBUTION))), lambda x: x["line"])


def passages_of(lines: Column) -> Column:
    """array<struct<level, lines>>: the runs of quoted lines of one level."""
    numbers = F.sequence(F.lit(1), F.size(lines))
    level = lambda k: F.element_at(lines, k)["level"]
    starts = F.filter(numbers, lambda k: (level(k) > 0) & F.when(k == 1, True).otherwise(F.get(lines, k - 2)["level"] != level(k)))
    ends = F.filter(numbers, lambda k: (level(k) > 0) & F.when(k == F.size(lines), True).otherwise(F.get(lines, k)["level"] != level(k)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(level(a).alias("level"), F.transform(F.slice(lines, a, b - a + 1), lambda x: x["line"]).alias("lines")))


def units(level: Column, lines: Column, least: int) -> Column:
    """array<struct<level, hash, size>>: the lines together, their paragraphs and sentences, and each line, normalised.  Of
    fewer than ``least`` characters only the lines together count, and only against others so short."""
    whole = normal(F.concat_ws(" ", lines))
    paragraphs = F.split(F.concat_ws("\n", lines), PARAGRAPH)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE)))
    texts = F.filter(F.transform(F.concat(paragraphs, sentences, lines), normal), lambda t: F.length(t) >= least)
    short = (F.length(whole) < least) & (whole != "")
    texts = F.array_distinct(F.concat(F.array(F.when(short, F.concat(F.lit("="), whole)).otherwise(whole)), texts))
    return F.transform(F.filter(texts, lambda t: t != ""), lambda t: F.struct(level.alias("level"), F.sha2(t, 256).alias("hash"), F.length(t).alias("size")))


def link(messages: DataFrame, least: int = 8) -> DataFrame:
    """One row for each row of ``messages(conv_id, turn, role, text)``: conv_id, turn, role, body (the text without
    quotations), n_passages, max_level, parent_turn, root_turn, depth.

    Sorted by conv_id, root_turn, turn, every message follows the one that it answers.  A message answers the message
    that first wrote what it quotes, of the same conversation and an earlier turn: of its links the least level counts,
    then the longest text, then the latest turn.  A passage of fewer than ``least`` normalised characters links to a message
    that says nothing else; parts of a text that are so short don't link.
    Without a link parent_turn is null, root_turn the message's own turn and depth 0.  Null texts are empty; rows of null
    conv_id or turn don't link; rows of one conv_id and turn are one message with the links of all; texts of any length are read whole; other columns are ignored; an empty table gives
    no rows.
    """
    base = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    parsed = base.withColumn("lines", lines_of(F.col("text")))
    quoting = parsed.filter(F.col("text").contains(">")).withColumn("passages", passages_of(F.col("lines"))).filter(F.size("passages") > 0)
    quoted = quoting.select("conv_id", "turn", F.explode(F.flatten(F.transform("passages", lambda p: units(p["level"], p["lines"], least)))).alias("u")).select("conv_id", "turn", "u.*")
    quoted = written(quoted.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn", "hash").agg(F.min("level").alias("level"), F.max("size").alias("size")), "quoted")
    wanted = quoted.select("conv_id", "hash").distinct()
    own = parsed.select("conv_id", "turn", F.explode(units(F.lit(0), own_lines(F.col("lines")), least)).alias("u")).select("conv_id", "turn", "u.hash")
    first = own.join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("parent_turn"))
    links = quoted.join(first, ["conv_id", "hash"]).filter(F.col("parent_turn") < F.col("turn"))
    best = links.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "size", "parent_turn"))["parent_turn"].alias("parent_turn"))
    parents = rooted(written(best, "replies"))
    shape = parsed.withColumn("passages", F.when(F.col("text").contains(">"), passages_of(F.col("lines"))))
    body = F.when(F.col("text").contains(">"), F.trim(F.concat_ws("\n", own_lines(F.col("lines"))))).otherwise(F.coalesce(F.regexp_replace("text", "\r", ""), F.lit("")))
    out = shape.select("conv_id", "turn", "role", body.alias("body"), F.coalesce(F.size("passages"), F.lit(0)).alias("n"), F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("max_level"))
    return out.join(parents, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", F.greatest("n", F.lit(0)).cast("bigint").alias("n_passages"), F.col("max_level").cast("bigint").alias("max_level"),
        "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce(F.col("depth").cast("bigint"), F.lit(0)).alias("depth"),
    )


def rooted(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn, depth) of ``replies(conv_id, turn, parent_turn)``, by pointer jumping: as
    many rounds as the depth has binary digits, each a written table."""
    now = written(replies.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "replies")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        after = written(now.join(up, ["conv_id", "root_turn"], "left").select("conv_id", "turn", "parent_turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "replies")
        drop(now)
        now = after.drop("moved")
        now._scratch = after._scratch
        if after.filter("moved").isEmpty():
            return now
