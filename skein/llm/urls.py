"""URL verdicts: path rules first, then trust and distrust that personalised PageRank spreads over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import discard, read, scratch

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts so; the longest wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
#: Rounds go on until less than this part of the mass is still under way: at most log(TOLERANCE) / log(DAMPING), 85.
TOLERANCE = 1e-6
#: Decimal places to which trust and distrust are compared.
PLACES = 12
#: A host is blocked if its distrust is over so many times its trust.
MARGIN = 1.0

_HOST = r"^(?s:.*?)://([^/?#]*)"
_PATH = r"^(?s:.*?)://[^/?#]*([^?#]*)"
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def _longest_first(rules):
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def rule_of(host: Column, path: Column, rules=RULES, verdict: bool = False) -> Column:
    """The longest rule that fits, like `net/`, or its verdict; else null."""
    out = F.lit(None).cast("string")
    for kind, h, p in reversed(_longest_first(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, kind if verdict else h + p).otherwise(out)
    return out


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, trust, distrust: personalised PageRank for both at once, to within TOLERANCE of the seeds' mass.

    edges: (src, dst) of distinct hosts. seeds: (host, trust, distrust), each column summing to at most 1. Trust
    goes along the links of a host in equal shares, distrust against them to those that link to it. The mass of
    hosts without such links is not passed on. A round moves only what the last one brought, which is its change too.
    """
    out_n = edges.groupBy(F.col("src").alias("host")).agg(F.count(F.lit(1)).alias("n"))
    in_n = edges.groupBy(F.col("dst").alias("host")).agg(F.count(F.lit(1)).alias("n"))
    forward = edges.join(out_n.withColumnRenamed("host", "src"), "src").select(F.lit(True).alias("good"), F.col("src").alias("frm"), F.col("dst").alias("host"), (1.0 / F.col("n")).alias("share"))
    back = edges.join(in_n.withColumnRenamed("host", "dst"), "dst").select(F.lit(False).alias("good"), F.col("dst").alias("frm"), F.col("src").alias("host"), (1.0 / F.col("n")).alias("share"))
    way = scratch(forward.unionAll(back), "ways")
    start = seeds.select(F.explode(F.array(F.struct(F.lit(True).alias("good"), F.col("trust").alias("x")), F.struct(F.lit(False).alias("good"), F.col("distrust").alias("x")))).alias("s"), "host")
    x = (F.col("s.x") * (1 - DAMPING)).alias("x")
    rank = scratch(start.filter("s.x > 0").select("host", "s.good", x, x.alias("new")), "rank")
    linked = not way.isEmpty()
    while linked and (rank.agg(F.sum("new")).first()[0] or 0.0) >= TOLERANCE * (1 - DAMPING):
        moved = way.join(rank.filter("new > 0").select(F.col("host").alias("frm"), "good", "new"), ["frm", "good"]).select("host", "good", F.lit(0.0).alias("x"), (F.col("new") * F.col("share") * DAMPING).alias("new"))
        both = rank.select("host", "good", "x", F.lit(0.0).alias("new")).unionAll(moved).groupBy("host", "good")
        after = scratch(both.agg((F.sum("x") + F.sum("new")).alias("x"), F.sum("new").alias("new")), "rank")
        discard(rank)
        rank = after
    discard(way)
    pick = lambda good: F.coalesce(F.sum(F.when(F.col("good") == good, F.col("x"))), F.lit(0.0))
    return rank.groupBy("host").agg(pick(True).alias("trust"), pick(False).alias("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for rows (page_id, url, html), one for each.

    A host most of whose pages an allow (block) rule fits is a trusted (blocked) seed with an equal part of the
    mass; one with half of them allowed and half blocked is neither. Links between different hosts are the distinct absolute or scheme-relative href targets. A page that no
    rule fits is blocked if its host has distrust over MARGIN times its trust. A null url, or one without ://, has
    an empty host and path, which are no seed and link nowhere: it is allowed. A null html has no links; a very long one
    is searched whole. Repeated
    rows are judged alike and count for their host; extra columns are not read.
    """
    at = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_rule = rule_of(F.col("host"), F.col("path"), rules, verdict=True)
    links = at.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).filter("src <> dst").distinct()
    hosts = at.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(by_rule == "allow", 1)).alias("good"), F.count(F.when(by_rule == "block", 1)).alias("bad")
    )
    seeds = hosts.select("host", F.col("good") * 2 > F.col("n"), F.col("bad") * 2 > F.col("n")).toDF("host", "good", "bad")
    total = seeds.agg(F.count(F.when(F.col("good"), 1)).alias("goods"), F.count(F.when(F.col("bad"), 1)).alias("bads"))
    part = lambda mark, all_: F.when(F.col(mark), 1.0 / F.col(all_)).otherwise(0.0)
    seeds = seeds.filter("good OR bad").join(F.broadcast(total)).select("host", part("good", "goods").alias("trust"), part("bad", "bads").alias("distrust"))
    bad = spread(scratch(links, "links"), seeds).filter(F.round("distrust", PLACES) > F.round(MARGIN * F.col("trust"), PLACES)).select("host", F.lit(True).alias("bad"))
    rows = at.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), by_rule.alias("said"))
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return rows.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"))


def op4_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def _sql() -> str:
    case = lambda f: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{f(k, h, p)}'" for k, h, p in _longest_first(RULES)) + " END"
    return f"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), j AS (SELECT *, {case(lambda k, h, p: h + p)} AS rule, {case(lambda k, h, p: k)} AS said FROM p
), hosts AS (
  SELECT host, count(*) FILTER (said = 'allow') * 2 > count(*) AS g, count(*) FILTER (said = 'block') * 2 > count(*) AS b FROM j WHERE host <> '' GROUP BY host
), seed AS (
  SELECT host, true AS good, 1.0::DOUBLE / (SELECT count(*) FROM hosts WHERE g) AS x FROM hosts WHERE g
  UNION ALL SELECT host, false, 1.0::DOUBLE / (SELECT count(*) FROM hosts WHERE b) FROM hosts WHERE b
), link AS (
  SELECT DISTINCT src, dst FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM p WHERE host <> '')
  WHERE src <> dst
), way AS (
  SELECT true AS good, src AS frm, dst AS host, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM link
  UNION ALL SELECT false, dst, src, 1.0::DOUBLE / count(*) OVER (PARTITION BY dst) FROM link
), moved(host, good, x) AS (
  SELECT host, good, x * {1 - DAMPING} FROM seed
  UNION ALL SELECT w.host, w.good, sum(m.x * w.share * {DAMPING}) FROM moved m JOIN way w ON w.frm = m.host AND w.good = m.good
    WHERE (SELECT sum(x) FROM moved) >= {TOLERANCE * (1 - DAMPING)} GROUP BY w.host, w.good
), bad AS (
  SELECT host FROM moved GROUP BY host HAVING round(coalesce(sum(x) FILTER (NOT good), 0), {PLACES}) > round({MARGIN} * coalesce(sum(x) FILTER (good), 0), {PLACES})
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""


OP4_SQL = _sql()
