"""Quotation linking: replies are found by the passages they quote, and quotes go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import discard, read, scratch

_MARKS = r"^((?:[ \t]*>)+)"


def normal(text: Column) -> Column:
    """Letters and digits in lower case with one space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    line = lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("t")
    )
    return F.transform(F.split(text, "\r?\n"), line)


def _parsed(rows: DataFrame) -> DataFrame:
    """The rows with `_lines` and `_passages`: runs of lines of one quote level, joined by line ends; level 0 is own text.

    Each array is made once, behind an explode of one row, so that the lambdas below look it up and the work is
    linear in the lines of a message.
    """
    once = lambda df, x, name: df.select("*", F.explode(F.array(x)).alias(name))
    rows = once(rows, _lines(F.col("text")), "_lines")
    level = lambda i: F.get("_lines", i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    rows = once(rows, starts, "_starts")

    def passage(i, n):
        stop = F.coalesce(F.get("_starts", n + 1), F.size("_lines"))
        t = F.transform(F.slice("_lines", i + 1, stop - i), lambda x: x["t"])
        return F.struct(level(i).alias("level"), F.array_join(t, "\n").alias("t"))

    return once(rows, F.transform("_starts", passage), "_passages").drop("_starts")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_linked: the quoting messages whose quotes are found.

    A quoted passage, and each line of it, is looked up by the hash of its normal form among the own lines, own
    passages and whole own texts of the conversation; its original is the message that said it first, before the
    quoting one. A message replies to the original of its shallowest quote; among these, to the one with the most
    finds, then to the latest.
    """
    whole = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    has = F.col("text").rlike(r"(?m)^[ \t]*>")
    parsed = scratch(_parsed(whole.filter(has).select("conv_id", "turn", "text")).select("conv_id", "turn", "_lines", "_passages"), "parsed")
    passage = parsed.select("conv_id", "turn", F.explode("_passages").alias("p")).filter("p.level > 0")
    unit = lambda t: F.array_distinct(F.concat(F.array(normal(t)), F.transform(F.split(t, "\n"), normal)))
    quoted = passage.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(unit(F.col("p.t"))).alias("t")).filter("t <> ''")
    quoted = scratch(quoted.select("conv_id", "turn", "level", F.md5("t").alias("h")).distinct(), "quoted")
    own = lambda of: F.transform(F.filter(of, lambda x: x["level"] == 0), lambda x: x["t"])
    lines = own("_lines")
    of_quoting = parsed.select("conv_id", "turn", F.concat(F.array(F.array_join(lines, "\n")), lines, own("_passages")).alias("_t"))
    plain = whole.filter(~has).select("conv_id", "turn", F.concat(F.array("text"), F.split("text", "\r?\n")).alias("_t"))
    said = of_quoting.unionAll(plain).join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    said = said.select("conv_id", "turn", F.explode(F.transform("_t", normal)).alias("t")).filter("t <> ''")
    first = said.groupBy("conv_id", F.md5("t").alias("h")).agg(F.min("turn").alias("origin"))
    found = quoted.join(first, ["conv_id", "h"]).filter("origin < turn")
    per = found.groupBy("conv_id", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("origin", F.struct(-F.col("level"), "n", "origin"))
    return per.groupBy("conv_id", "turn").agg(best.alias("reply_to"), F.sum("n").alias("n_linked"))


def _roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread, depth of linked messages: pointers are doubled until they all end at a message without a link."""
    at = scratch(links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open")), "threads")
    while not at.filter("open").isEmpty():
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("t2"), F.col("depth").alias("d2"))
        new = at.join(up, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("t2", "thread").alias("thread"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("t2").isNotNull().alias("open")
        )
        new = scratch(new, "threads")
        discard(at)
        at = new
    return at.drop("open")


def threads(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, depth, n_quote_levels, n_linked, text: one row for each message.

    text is without quoted lines and the space around. thread is the turn of the message that the chain of
    replies starts from, depth the replies up to it; a message without a found quote starts a thread of its own
    with reply_to null. In the order (conv_id, thread, turn), in which the rows are sorted, every reply comes after
    what it replies to. A null text is empty; a null conv_id or turn links with nothing and has the thread `turn`.
    Rows of one conv_id and turn are one message with their quotes together, but keep a row each. Very long texts are
    read whole, in time linear in their lines. Extra columns are not read.
    """
    small = messages.select("conv_id", "turn", "role", "text")
    quoting = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
    links = scratch(link(small), "links")
    known = links.join(_roots(links), ["conv_id", "turn"])
    kept = F.transform(F.filter(_lines(F.col("text")), lambda x: x["level"] == 0), lambda x: x["t"])
    own = F.when(quoting, F.concat_ws("\n", kept)).otherwise(F.coalesce("text", F.lit("")))
    levels = F.when(quoting, F.array_max(F.transform(_lines(F.col("text")), lambda x: x["level"]))).otherwise(0)
    out = small.join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        levels.cast("long").alias("n_quote_levels"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.regexp_replace(own, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "").alias("text"),
    )
    return out.orderBy("conv_id", "thread", "turn")


def op6_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(read(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations
), l AS (
  SELECT id, conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS no FROM m
), q AS (
  SELECT id, conv_id, turn, no, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^((?:[ \t]*>)+)', '') AS t FROM l
), g AS (
  SELECT *, no - row_number() OVER (PARTITION BY id, level ORDER BY no) AS run FROM q
), passage AS (
  SELECT id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, level, string_agg(t, chr(10) ORDER BY no) AS t FROM g GROUP BY id, level, run
), unit AS (
  SELECT conv_id, turn, level, t FROM passage UNION ALL SELECT conv_id, turn, level, t FROM q
  UNION ALL SELECT any_value(conv_id), any_value(turn), 0, string_agg(t, chr(10) ORDER BY no) FROM q WHERE level = 0 GROUP BY id
), n AS (
  SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM unit WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), first AS (SELECT conv_id, t, min(turn) AS origin FROM n WHERE level = 0 AND t <> '' GROUP BY ALL
), per AS (
  SELECT n.conv_id, n.turn, n.level, f.origin, count(*) AS n FROM n JOIN first f ON f.conv_id = n.conv_id AND f.t = n.t AND f.origin < n.turn WHERE n.level > 0 GROUP BY ALL
), link AS (
  SELECT conv_id, turn, arg_max(origin, (-level, n, origin)) AS reply_to, sum(n) AS n_linked FROM per GROUP BY ALL
), up AS (
  SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM link
  UNION ALL SELECT u.conv_id, u.turn, k.reply_to, u.depth + 1 FROM up u JOIN link k ON k.conv_id = u.conv_id AND k.turn = u.thread
), root AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM up GROUP BY ALL
), own AS (SELECT id, max(level) AS levels, string_agg(t, chr(10) ORDER BY no) FILTER (level = 0) AS t FROM q GROUP BY id)
SELECT m.conv_id, m.turn, m.role, link.reply_to, coalesce(root.thread, m.turn) AS thread, coalesce(root.depth, 0)::BIGINT AS depth,
  coalesce(own.levels, 0)::BIGINT AS n_quote_levels, coalesce(link.n_linked, 0)::BIGINT AS n_linked,
  regexp_replace(CASE WHEN own.levels > 0 THEN coalesce(own.t, '') ELSE coalesce(m.text, '') END, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text
FROM m LEFT JOIN own ON own.id = m.id LEFT JOIN link ON link.conv_id = m.conv_id AND link.turn = m.turn LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn
"""
