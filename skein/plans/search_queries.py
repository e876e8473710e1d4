"""Scan, term, ranking and position queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import names, text
from skein.operators import context, lexical, positional, ranking, scan
from skein.plans.registry import query
from skein.sources import tables as T

FILES = "WITH " + T.FILES_SQL
NODES = "WITH " + T.NODES_SQL
#: Regular expressions of the tokenizers for an engine without lookaround.
SPLIT_SQL = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({x}, '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
WHOLE_SQL = r"list_filter(regexp_split_to_array(lower({x}), '[\s\p{{Z}}\x{{85}}!-/:-@\[-^`{{-~]+'), lambda w: w <> '')"
BODY_QUERY = "thing with ststh oron"
BODY_TERMS = text.query_terms(BODY_QUERY)
TERMS_SQL = "(VALUES " + ", ".join(f"('{t}')" for t in BODY_TERMS) + ") q(term)"


def split_sql(x: str) -> str:
    return SPLIT_SQL.format(x=x)


def whole_sql(x: str) -> str:
    return WHOLE_SQL.format(x=x)


def _files_sql(where: str, limit: int = 100) -> str:
    return f"{FILES}, hit AS (SELECT path, language, bytes FROM files WHERE {where}) SELECT *, (SELECT count(*) FROM hit) > {limit} AS truncated FROM hit ORDER BY path LIMIT {limit}"


@query("files_glob", _files_sql("regexp_full_match(path, 'src1[^/]*/[^/]*\\.de')"))
def files_glob(spark, d):
    return scan.find_files(T.files(spark, d), "src1*/*.de")


@query("files_language", _files_sql("language = 'de' AND starts_with(path, 'src3/')", 5))
def files_language(spark, d):
    return scan.find_files(T.files(spark, d), language="de", root="./src3", limit=5)


def _text_sql(cond: str, files: str = "true", limit: int = 250) -> str:
    return f"""{FILES}, line AS (
  SELECT path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM files WHERE {files}
), hit AS (SELECT path, line, CASE WHEN line < n THEN regexp_replace(content, '\\r$', '') ELSE content END AS content FROM line WHERE (line < n OR content <> '') AND {cond})
SELECT path, line, CASE WHEN strlen(content) <= 400 THEN content ELSE 'long' END AS content, (SELECT count(*) FROM hit) > {limit} AS truncated FROM hit ORDER BY path, line LIMIT {limit}"""


def _long(df):
    """Cut lines compare as one mark; the cut itself is tested on its own."""
    return df.withColumn("content", F.when(F.col("content").endswith("…"), "long").otherwise(F.col("content")))


@query("text_literal", _text_sql("contains(content, 'the th')"))
def text_literal(spark, d):
    return _long(scan.find_text(T.files(spark, d), "the th"))


@query("text_ignore_case", _text_sql("contains(lower(content), lower('ÉAU'))"))
def text_ignore_case(spark, d):
    return _long(scan.find_text(T.files(spark, d), "ÉAU", ignore_case=True))


@query("text_include", _text_sql("contains(content, 'und der')", "regexp_full_match(path, '.*2.*\\.de') OR regexp_full_match(regexp_extract(path, '[^/]*$'), '.*2.*\\.de')", 40))
def text_include(spark, d):
    return _long(scan.find_text(T.files(spark, d), "und der", include="*2*.de", limit=40))


@query("text_lines", FILES + ", l AS (SELECT path, string_split(text, chr(10)) AS s FROM files) SELECT path, len(s) - CASE WHEN s[-1] = '' THEN 1 ELSE 0 END AS lines FROM l")
def text_lines(spark, d):
    """Lines of each file, a file without lines included."""
    f = T.files(spark, d)
    n = scan.lines(f).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return f.select("path").join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("lines"))


@query("tokens_split", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {split_sql('text')} AS t FROM documents)")
def tokens_split(spark, d):
    t = T.table(spark, d, "documents").select("doc_id", text.split_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("tokens_whole", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {whole_sql('text')} AS t FROM documents)")
def tokens_whole(spark, d):
    t = T.table(spark, d, "documents").select("doc_id", text.whole_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("term_df", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({split_sql('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, d):
    p = lexical.body_postings(T.table(spark, d, "documents"), "doc_id")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def _body_sql(least: int, k: int = 10, terms: str = TERMS_SQL) -> str:
    return f"""WITH t AS (SELECT doc_id, {split_sql('text')} AS t FROM documents), u AS (SELECT doc_id, t, len(t) AS length FROM t WHERE len(t) > 0),
s AS (SELECT count(*) AS n, greatest(avg(length), 1.0) AS average FROM u),
p AS (SELECT doc_id, any_value(length) AS length, term, count(*) AS tf FROM (SELECT doc_id, length, unnest(t) AS term FROM u) JOIN {terms} USING (term) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, count(*)::INTEGER AS matched, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) AS score
FROM p JOIN df USING (term), s GROUP BY doc_id HAVING count(*) >= {least} ORDER BY score DESC, doc_id LIMIT {k}"""


def _body(least):
    return lambda spark, d: lexical.body_search(T.table(spark, d, "documents"), "doc_id", BODY_QUERY, least)


query("body_bm25_any", _body_sql(1))(_body("any"))
ALL_QUERY = "that was this from"
_ALL_SQL = "(VALUES " + ", ".join(f"('{t}')" for t in text.query_terms(ALL_QUERY)) + ") q(term)"


@query("body_bm25_all", _body_sql(4, terms=_ALL_SQL))
def body_bm25_all(spark, d):
    return lexical.body_search(T.table(spark, d, "documents"), "doc_id", ALL_QUERY, "all")


query("body_bm25_at_least", _body_sql(2))(_body(2))

META_QUERY = "Customer#000000007 sales"


def _meta_sql(query_: str, bm25f: bool, least: int = 1, k: int = 20) -> str:
    terms = text.query_terms(query_)
    stop = ", ".join(f"'{s}'" for s in text.STOPWORDS)
    tok = lambda x: f"list_filter({split_sql(x)}, lambda w: w NOT IN ({stop}))"
    names_ = ["name", "path", "signature", "qualified"]
    w = dict(zip(names_, (8, 2, 1, 4)))
    combined = "idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))"
    fielded = "idf * x * 2.2 / (x + 1.2)"
    x = " + ".join(f"{w[f]} * tf_{f} / (0.25 + 0.75 * len_{f} / avg_{f})" for f in names_)
    return f"""{NODES}, f AS (
  SELECT id, name, qualified_name, {tok('name')} AS t_name, {tok('path')} AS t_path, []::VARCHAR[] AS t_signature,
    {tok("CASE WHEN qualified_name = name THEN '' ELSE qualified_name END")} AS t_qualified FROM nodes
), l AS (SELECT *, {", ".join(f"len(t_{f}) AS len_{f}" for f in names_)} FROM f),
s AS (SELECT count(*) AS n, greatest(avg({" + ".join(f"len_{f}" for f in names_)}), 1.0) AS avg_len, {", ".join(f"greatest(avg(len_{f}), 1.0) AS avg_{f}" for f in names_)} FROM l),
p AS (SELECT id, q.term, {" + ".join(f"len_{f}" for f in names_)} AS len, {", ".join(f"len_{f}" for f in names_)}, {", ".join(f"len(list_filter(t_{f}, lambda z: z = q.term)) AS tf_{f}" for f in names_)}
  FROM l, (VALUES {", ".join(f"('{t}')" for t in terms)}) q(term)),
h AS (SELECT *, {" + ".join(f"{w[f]} * tf_{f}" for f in names_)} AS tf FROM p WHERE {" + ".join(f"tf_{f}" for f in names_)} > 0),
df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
c AS (SELECT id, {fielded if bm25f else combined} AS score FROM (SELECT *, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf, {x} AS x FROM h JOIN df USING (term), s)),
m AS (SELECT id, count(*) AS matched, sum(score) AS score FROM c GROUP BY id)
SELECT f.id, (lower(f.name) = '{query_.lower()}' OR lower(f.qualified_name) = '{query_.lower()}') AS exact, coalesce(matched, 0)::INTEGER AS matched,
  round(CASE WHEN lower(f.name) = '{query_.lower()}' OR lower(f.qualified_name) = '{query_.lower()}' THEN 2.0 ELSE score / (1 + score) END, 6) AS score
FROM f LEFT JOIN m USING (id) WHERE matched >= {least} OR lower(f.name) = '{query_.lower()}' OR lower(f.qualified_name) = '{query_.lower()}' ORDER BY score DESC, f.id LIMIT {k}"""


@query("meta_bm25_combined", _meta_sql(META_QUERY, False))
def meta_bm25_combined(spark, d):
    return lexical.meta_search(T.nodes(spark, d), META_QUERY, k=20)


@query("meta_bm25f", _meta_sql(META_QUERY, True))
def meta_bm25f(spark, d):
    return lexical.meta_search(T.nodes(spark, d), META_QUERY, k=20, bm25f=True)


@query("meta_exact", _meta_sql("Customer#000000007", False, 1))
def meta_exact(spark, d):
    return lexical.meta_search(T.nodes(spark, d), "Customer#000000007", k=20)


@query("exact_name", NODES + " SELECT id, kind, path FROM nodes WHERE lower(name) = 'supplier#000000003' OR lower(qualified_name) = 'supplier#000000003'")
def exact_name(spark, d):
    wanted = text.exact_query(" (Supplier#000000003) ")
    n = T.nodes(spark, d)
    return n.filter((text.exact_fold(F.col("name")) == wanted) | (text.exact_fold(F.col("qualified_name")) == wanted)).select("id", "kind", "path")


@query("name_prefix", NODES + " SELECT id, name, CASE WHEN starts_with(name, 'Customer#00000001') THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS score FROM nodes WHERE starts_with(name, 'Customer#00000001') OR starts_with(qualified_name, 'Customer#00000001') ORDER BY score DESC, id LIMIT 256")
def name_prefix(spark, d):
    n, p = T.nodes(spark, d), "Customer#00000001"
    hit = n.filter(F.col("name").startswith(p) | F.col("qualified_name").startswith(p))
    return hit.select("id", "name", F.when(F.col("name").startswith(p), 1.0).otherwise(0.9).alias("score")).orderBy(F.desc("score"), "id").limit(256)


@query("path_glob", NODES + " SELECT id, path FROM nodes WHERE regexp_full_match(path, 's[^/]*/[^/]*1') ORDER BY id LIMIT 100")
def path_glob(spark, d):
    from skein.functions.globs import anchored_glob

    return T.nodes(spark, d).filter(F.col("path").rlike(anchored_glob("s*/*1"))).select("id", "path").orderBy("id").limit(100)


@query("test_ownership", NODES + " SELECT kind, regexp_matches(path, '(^|/)(tests|test|spec|specs|__tests__)/') AS test, count(*) AS n FROM nodes GROUP BY ALL")
def test_ownership(spark, d):
    n = T.nodes(spark, d)
    return n.groupBy("kind", text.test_owned(F.col("path"), F.col("qualified_name")).alias("test")).agg(F.count(F.lit(1)).alias("n"))


def _positions_sql(terms):
    return f"WITH tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {whole_sql('text')} AS t FROM documents))" + "".join(
        f", p{i} AS (SELECT doc_id, pos FROM tok WHERE term = '{t}')" for i, t in enumerate(terms)
    )


@query("phrase", f"""WITH tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {whole_sql('text')} AS t FROM documents)),
n AS (SELECT doc_id, pos, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok) SELECT doc_id, pos AS start, pos + 1 AS stop FROM n WHERE term = 'of' AND nxt = 'the'""")
def phrase(spark, d):
    return positional.phrase(T.table(spark, d, "documents"), "doc_id", "of the")


@query("phrase_gap", _positions_sql(["the", "and", "of"]) + " SELECT doc_id, max(p0.pos) AS start, p2.pos AS stop FROM p0 JOIN p1 USING (doc_id) JOIN p2 USING (doc_id) WHERE p0.pos < p1.pos AND p1.pos < p2.pos AND p2.pos - p0.pos < 3 + 4 GROUP BY doc_id, p2.pos")
def phrase_gap(spark, d):
    return positional.phrase(T.table(spark, d, "documents"), "doc_id", "the and of", gap=4)


@query("near", _positions_sql(["the", "and", "of"]) + """, e AS (
  SELECT doc_id, pos FROM tok WHERE term IN ('the', 'and', 'of')
), w AS (
  SELECT e.doc_id, e.pos, (SELECT max(pos) FROM p1 WHERE p1.doc_id = e.doc_id AND p1.pos BETWEEN e.pos - 8 AND e.pos) AS a,
    (SELECT max(pos) FROM p2 WHERE p2.doc_id = e.doc_id AND p2.pos BETWEEN e.pos - 8 AND e.pos) AS o,
    (SELECT max(x.pos) FROM p0 x JOIN p0 y ON x.doc_id = y.doc_id AND y.pos > x.pos AND y.pos <= e.pos WHERE x.doc_id = e.doc_id AND x.pos >= e.pos - 8) AS t
  FROM e
) SELECT doc_id, least(a, o, t) AS start, pos AS stop FROM w WHERE a IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL AND pos - least(a, o, t) < 8""")
def near(spark, d):
    return positional.near(T.table(spark, d, "documents"), "doc_id", "the of the and", window=8)


TURN_TERMS = ("the", "thing", "oron", "anan")
_TURN_TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in TURN_TERMS) + "]"
_UNITS_SQL = f"WITH u AS (SELECT conv_id, turn, text, list_intersect(list_distinct({split_sql('text')}), {_TURN_TERMS_SQL}) AS m FROM conversations), h AS (SELECT conv_id, turn, len(m) AS score, " + " + ".join(
    f"CASE WHEN list_contains(m, '{t}') THEN {1 << i} ELSE 0 END" for i, t in enumerate(TURN_TERMS)
) + " AS mask FROM u WHERE len(m) > 0)"


def _units(spark, d):
    tokens = text.split_tokens(F.col("text"))
    bits = [F.when(F.array_contains("_t", t), F.lit(1 << i)).otherwise(0) for i, t in enumerate(TURN_TERMS)]
    u = T.table(spark, d, "conversations").select("conv_id", "turn", tokens.alias("_t")).select("conv_id", "turn", sum(bits).cast("long").alias("mask"))
    return u.withColumn("score", F.bit_count("mask").cast("long")).filter("score > 0")


@query("best_region_per_owner", _UNITS_SQL + " SELECT conv_id, turn, score FROM h QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) = 1")
def best_region_per_owner(spark, d):
    return lexical.best_per_owner(_units(spark, d), "conv_id", [F.desc("score"), "turn"]).select("conv_id", "turn", "score")


_ROUNDS = ""
for _i in range(4):
    _have = "0" if _i == 0 else f"coalesce((SELECT bit_or(mask) FROM ({' UNION ALL '.join(f'SELECT * FROM r{j}' for j in range(_i))}) c WHERE c.conv_id = h.conv_id), 0)"
    _ROUNDS += f", r{_i} AS MATERIALIZED (SELECT conv_id, turn, mask, {_i} AS rank FROM h WHERE (mask & ~({_have})) <> 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) = 1)"


@query("complementary_regions", _UNITS_SQL + _ROUNDS + " " + " UNION ALL ".join(f"SELECT conv_id, turn, rank FROM r{i}" for i in range(4)))
def complementary_regions(spark, d):
    return lexical.complementary(_units(spark, d), "conv_id", "turn")


@query("anchor_line", f"""{FILES}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
s AS (SELECT path, line, len(list_intersect(list_distinct({split_sql('content')}), ['the', 'thing', 'oron'])) AS n FROM l)
SELECT path, line, n AS n_terms FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, line) = 1""")
def anchor_line(spark, d):
    out = lexical.anchor_line(scan.lines(T.files(spark, d)), "path", ["the", "thing", "oron"])
    return out.select("path", "line", F.col("n_terms").cast("long").alias("n_terms"))


def _lane_sql(term: str, name: str) -> str:
    return f"{name} AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) - 1 AS rank0 FROM (SELECT doc_id, len(list_filter({split_sql('text')}, lambda w: w = '{term}')) AS n FROM documents) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 64)"


def _lane(spark, d, term):
    n = F.size(F.filter(text.split_tokens(F.col("text")), lambda w: w == term))
    top = T.table(spark, d, "documents").select("doc_id", n.alias("n")).filter("n > 0").orderBy(F.desc("n"), "doc_id").limit(64)
    return ranking.ranked(top, [F.desc("n"), "doc_id"]).withColumn("exact", F.lit(False))


_FUSE_SQL = f"WITH {_lane_sql('thing', 'a')}, {_lane_sql('the', 'b')}, f AS (SELECT doc_id, round(sum(1.0::DOUBLE / (61 + rank0)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id)"


def _fused(spark, d):
    return ranking.fuse([_lane(spark, d, "thing"), _lane(spark, d, "the")], "doc_id")


@query("rrf_fusion", _FUSE_SQL + " SELECT doc_id, score FROM f")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("doc_id", "score")


_DEFER = "SELECT f.doc_id, source AS path, score, source IN ('src1', 'src2') AS deferred, row_number() OVER (ORDER BY source IN ('src1', 'src2'), score DESC, f.doc_id) AS place FROM f JOIN documents USING (doc_id)"


def _deferred(spark, d):
    hits = _fused(spark, d).join(T.table(spark, d, "documents").select("doc_id", F.col("source").alias("path")), "doc_id")
    return ranking.defer_tests(hits, "thing the", F.col("path").isin("src1", "src2"), order=[F.desc("score"), "doc_id"])


@query("defer_tests", f"{_FUSE_SQL} {_DEFER}")
def defer_tests(spark, d):
    return _deferred(spark, d).select("doc_id", "path", "score", "deferred", F.col("place").cast("long").alias("place"))


@query("per_file_diversity", f"""{_FUSE_SQL}, p AS ({_DEFER}), o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY place) > 2 AS put_off FROM p)
SELECT doc_id, path, row_number() OVER (ORDER BY put_off, place) AS slot FROM o ORDER BY slot LIMIT 12""")
def per_file_diversity(spark, d):
    out = ranking.diverse(_deferred(spark, d), 12, 2)
    return out.select("doc_id", "path", F.col("slot").cast("long").alias("slot"))


@query("posting_intersection", f"SELECT doc_id FROM (SELECT doc_id, {split_sql('text')} AS t FROM documents) WHERE list_contains(t, 'thing') AND list_contains(t, 'oron') AND list_contains(t, 'the')")
def posting_intersection(spark, d):
    docs = T.table(spark, d, "documents")
    return lexical.having_all(lexical.body_postings(docs, "doc_id"), "doc_id", ["thing", "oron", "the"])


@query("snippet", f"""{FILES}, l AS (SELECT path, string_split(text, chr(10)) AS s FROM files), n AS (SELECT path, s, len(s) - CASE WHEN s[-1] = '' THEN 1 ELSE 0 END AS n, 5 AS anchor FROM l),
b AS (SELECT *, greatest(1, least(anchor - 5, n - 9)) AS start FROM n)
SELECT path, start::INTEGER AS start, least(n, start + 9)::INTEGER AS stop, md5(array_to_string(s[start:least(n, start + 9)], chr(10))) AS digest FROM b""")
def snippet(spark, d):
    s = context.snippet(F.col("text"), F.lit(5))
    return T.files(spark, d).select("path", s.alias("s")).select("path", "s.start", "s.stop", F.md5("s.content").alias("digest"))


@query("payload_prefix", """WITH r AS (SELECT doc_id, source, lang FROM documents), s AS (
  SELECT *, sum(strlen('{"doc_id":' || doc_id || ',"source":"' || source || '","lang":"' || lang || '"}') + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS bytes FROM r)
SELECT doc_id, source, lang, bytes::BIGINT AS bytes FROM s WHERE bytes <= 4096""")
def payload_prefix(spark, d):
    # the prefix holds at most limit / 2 rows whatever they are, so only so many of the first are sized in one task
    first = T.table(spark, d, "documents").select("doc_id", "source", "lang").orderBy("doc_id").limit(2048)
    return ranking.fitting(first, ["doc_id"], 4096)


@query("excerpt_merge", """WITH s AS (SELECT source AS path, lang AS role, doc_id % 100 * 10 AS start, doc_id % 100 * 10 + doc_id % 17 AS stop FROM documents),
d AS (SELECT DISTINCT * FROM s), b AS (SELECT *, max(stop) OVER (PARTITION BY path, role ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path, role ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM b),
w AS (SELECT path, role, min(start) AS lo, max(stop) AS hi FROM i GROUP BY path, role, i), c AS (SELECT path, role, hi, unnest(range(lo, hi + 1, 80)) AS start FROM w)
SELECT path, role, start, least(start + 79, hi) AS stop FROM c""")
def excerpt_merge(spark, d):
    at = F.col("doc_id") % 100 * 10
    spans = T.table(spark, d, "documents").select(F.col("source").alias("path"), F.lit("h").alias("hash"), F.col("lang").alias("role"), at.alias("start"), (at + F.col("doc_id") % 17).alias("stop")).distinct()
    return context.merged(spans).drop("hash")


@query("enclosing_owner", """WITH sp AS (SELECT user_id AS path, event_id AS id, event_id // 7 * 7 AS lo, event_id // 7 * 7 + event_id % 100 AS hi FROM events)
SELECT p.user_id AS path, p.event_id AS start, p.event_id + 3 AS stop, arg_min(sp.id, (hi - lo, sp.id)) AS owner FROM events p LEFT JOIN sp ON sp.path = p.user_id AND lo <= p.event_id AND p.event_id + 3 <= hi GROUP BY ALL""")
def enclosing_owner(spark, d):
    """All events as spans of their user and as points."""
    from skein.operators.graph import enclosing

    e = T.table(spark, d, "events").select(F.col("user_id").alias("path"), "event_id")
    lo = F.floor(F.col("event_id") / 7) * 7
    spans = e.select("path", F.col("event_id").alias("id"), lo.alias("lo"), (lo + F.col("event_id") % 100).alias("hi"))
    return enclosing(e.select("path", F.col("event_id").alias("start"), (F.col("event_id") + 3).alias("stop")), spans)


@query("name_identities", """SELECT doc_id, concat('file:', source, '/', doc_id) AS file_id, concat('sym:', source, '#function:', lang, '@', doc_id) AS symbol_id, sha256(text) AS content_hash FROM documents""")
def name_identities(spark, d):
    docs = T.table(spark, d, "documents")
    return docs.select(
        "doc_id", names.file_id(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("file_id"),
        names.symbol_id(F.col("source"), F.lit("function"), F.col("lang"), F.col("doc_id")).alias("symbol_id"), names.content_hash(F.col("text")).alias("content_hash"),
    )


@query("hit_at_k_mrr", f"""WITH {_lane_sql('thing', 'a')}, r AS (SELECT l.doc_id, rank0 + 1 AS rank FROM labels l LEFT JOIN a USING (doc_id) WHERE quality = 1)
SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3, round(avg(CASE WHEN rank <= 8 THEN 1.0 ELSE 0.0 END), 6) AS hit8,
  count(rank) AS found, round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 6) AS mrr FROM r""")
def hit_at_k_mrr(spark, d):
    from skein.evaluation.metrics import rank_metrics

    lane = _lane(spark, d, "thing").select("doc_id", (F.col("rank0") + 1).alias("rank"))
    return rank_metrics(T.table(spark, d, "labels").filter("quality = 1").join(lane, "doc_id", "left"))


@query("coverage_recall", """WITH w AS (SELECT DISTINCT source AS task, lang AS path, unnest(range(doc_id % 50, doc_id % 50 + 6)) AS line FROM documents),
s AS (SELECT DISTINCT source AS task, lang AS path, unnest(range(n_chars % 50, n_chars % 50 + 4)) AS line FROM documents),
p AS (SELECT task, path, count(*) AS n, count(s.line) AS k FROM w LEFT JOIN s USING (task, path, line) GROUP BY ALL)
SELECT task, count(*) AS files, count(*) FILTER (k > 0) AS files_found, sum(n)::BIGINT AS lines, sum(k)::BIGINT AS lines_found FROM p GROUP BY task""")
def coverage_recall(spark, d):
    from skein.evaluation.metrics import region_coverage

    docs = T.table(spark, d, "documents")
    span = lambda c, n: docs.select(F.col("source").alias("task"), F.col("lang").alias("path"), (F.col(c) % 50).alias("start"), (F.col(c) % 50 + n).alias("stop"))
    return region_coverage(span("doc_id", 5), span("n_chars", 3))


@query("body_bm25_identifiers", _body_sql(1, terms="(VALUES ('that'), ('thing')) q(term)").replace(split_sql("text"), whole_sql("text")))
def body_bm25_identifiers(spark, d):
    """The same over whole lexemes."""
    return lexical.body_search(T.table(spark, d, "documents"), "doc_id", "that thing", whole=True)


@query("extraction_precision_recall", """WITH t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), s AS (SELECT doc_id FROM documents WHERE contains(text, '%%%') OR contains(text, '!!')),
b AS (SELECT count(*) AS n FROM t SEMI JOIN s USING (doc_id)), l AS (SELECT count(*) AS n FROM s SEMI JOIN labels USING (doc_id))
SELECT (SELECT count(*) FROM t) AS truth, l.n AS said, b.n AS both, round(b.n / l.n, 6) AS precision, round(b.n / (SELECT count(*) FROM t), 6) AS recall FROM b, l""")
def extraction_precision_recall(spark, d):
    from skein.evaluation.metrics import precision_recall

    labels = T.table(spark, d, "labels")
    said = T.table(spark, d, "documents").filter("text LIKE '%\\\\%\\\\%\\\\%%' OR text LIKE '%!!%'").join(labels, "doc_id", "left_semi")
    return precision_recall(labels.filter("quality = 0"), said, ["doc_id"])


@query("ranking_windows", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rn FROM conversations")
def ranking_windows(spark, d):
    w = W.partitionBy("conv_id").orderBy(F.length("text").desc(), "turn")
    return T.table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("rn"))


@query("line_postings", f"""{FILES}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
t AS (SELECT path, line, unnest(list_distinct({split_sql('content')} || {whole_sql('content')})) AS term FROM l)
SELECT path, count(DISTINCT term) AS terms, count(*) AS postings FROM t GROUP BY path""")
def line_postings(spark, d):
    from skein.plans.budget import line_postings as postings

    p = postings(scan.lines(T.files(spark, d)))
    return p.groupBy("path").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.size("lines")).alias("postings"))


@query("walk_coverage", "SELECT count(*) AS files, count(*) FILTER (strlen(html) <= 20000) AS text, 0::BIGINT AS binary, 0::BIGINT AS invalid_utf8, count(*) FILTER (strlen(html) > 20000) AS oversize FROM pages")
def walk_coverage(spark, d):
    raw = T.table(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return scan.coverage(scan.classified(raw, 20_000))


@query("alias_dispatch", """SELECT c_custkey AS ref, u.no, CASE WHEN c_mktsegment = 'BUILDING' THEN CASE u.no WHEN 0 THEN 'build/' ELSE 'more/' END || c_custkey ELSE 'seg/' || c_mktsegment || '/' || c_custkey END AS candidate
FROM customer, (VALUES (0), (1)) u(no) WHERE u.no = 0 OR c_mktsegment = 'BUILDING'""")
def alias_dispatch(spark, d):
    from skein.operators.resolve import aliases

    refs = T.table(spark, d, "customer").select(F.col("c_custkey").alias("ref"), F.concat(F.lit("@"), "c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string")).alias("specifier"))
    patterns = spark.createDataFrame([("@*", 0, "seg/*"), ("@BUILDING/*", 0, "build/*"), ("@BUILDING/*", 1, "more/*")], "pattern string, no int, substitution string")
    return aliases(refs, patterns)


@query("definition_tiers", NODES + " SELECT kind, CASE WHEN kind = 'variable' THEN 1 ELSE 0 END AS tier, count(*) AS n FROM nodes GROUP BY ALL")
def definition_tiers(spark, d):
    n = T.nodes(spark, d)
    return n.groupBy("kind", text.definition_tier(F.col("kind")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("unit_windows", f"""{FILES}, n AS (SELECT path, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS n FROM files)
SELECT path, (1 + ceil(greatest(n - 80, 0) / 72))::BIGINT AS units, (n + 8 * ceil(greatest(n - 80, 0) / 72))::BIGINT AS lines FROM n WHERE n > 0""")
def unit_windows(spark, d):
    from skein.extractors.markdown import units
    from skein.plans.budget import analysis_coverage

    none = spark.createDataFrame([], "path string, id string, start_line int, end_line int")
    return analysis_coverage(units(T.files(spark, d), none)).select("path", "units", "lines")


@query("posting_fields", NODES + f" SELECT kind, sum(len({split_sql('name')}))::BIGINT AS name_terms, sum(len({split_sql('path')}))::BIGINT AS path_terms, count(*) AS n FROM nodes GROUP BY kind")
def posting_fields(spark, d):
    f = T.nodes(spark, d)
    size = lambda c: F.sum(F.size(text.split_tokens(F.col(c)))).alias(f"{c}_terms")
    return f.groupBy("kind").agg(size("name"), size("path"), F.count(F.lit(1)).alias("n"))
