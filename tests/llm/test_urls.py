import random
import re

import duckdb
import numpy as np
import pytest

from skein.llm.urls import DAMPING, OP4_SQL, TOLERANCE, judge, spread


def page(i, url, *hrefs):
    return (i, url, "".join(f'<a class=x HREF="{h}">t</a>' for h in hrefs))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules(spark):
    rows = [
        (0, "http://a.net/x", "block", "net/"), (1, "https://EXAMPLE.net/en/y?q", "allow", "example.net/en/"), (2, "x://b.example.net/en", "block", "net/"),
        (3, "http://example.com/de/#top", "block", "example.com/de/"), (4, "http://w.org/fr/", "allow", "org/fr/"), (5, "http://w.org/en/", "allow", None),
        (6, "http://notnet/x", "allow", None), (7, None, "allow", None), (8, "no scheme", "allow", None), (9, "http://net", "allow", None), (10, "http://net/", "block", "net/"), (11, "a://b://c.net/", "allow", None),
    ]
    out = {x.page_id: x for x in judge(pages(spark, [(i, u, None) for i, u, _, _ in rows])).collect()}
    for i, url, verdict, rule in rows:
        assert out[i].rule == rule, url
        if rule:
            assert out[i].verdict == verdict, url
        m = re.match(r"^(?s:.*?)://([^/?#]*)([^?#]*)", url or "")
        assert (out[i].host, out[i].path) == ((re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", ""))


def test_distrust_comes_from_those_that_link_to_blocked_hosts(spark):
    rows = [page(0, "http://bad.net/"), page(1, "http://farm.example/a", "http://bad.net/1", "//bad.net/2"), page(2, "http://good.org/fr/a", "https://Fine.example/x", "/local"), page(3, "http://fine.example/x"), page(4, "http://alone.example/")]
    out = {x.page_id: x.verdict for x in judge(pages(spark, rows)).collect()}
    assert out == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_spread_is_personalised_pagerank(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]
    got = {x.host: (x.trust, x.distrust) for x in spread(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, trust double, distrust double")).collect()}

    t, b = exact({"a": 1}, edges), exact({"c": 1}, [(d, s) for s, d in edges])
    for h in "abcd":
        g = got.get(h, (0, 0))
        assert abs(g[0] - t[h]) < TOLERANCE and abs(g[1] - b[h]) < TOLERANCE


def exact(seed, ways):
    """Personalised PageRank as the solution of its linear equations."""
    hosts = sorted({h for w in ways for h in w} | set(seed))
    m, s = np.zeros((len(hosts), len(hosts))), np.array([seed.get(h, 0.0) for h in hosts])
    for f, t in ways:
        m[hosts.index(t), hosts.index(f)] = 1 / sum(1 for w in ways if w[0] == f)
    x = np.linalg.solve(np.eye(len(hosts)) - DAMPING * m, (1 - DAMPING) * s)
    return dict(zip(hosts, x.tolist()))


def test_trust_and_distrust_reach_over_long_chains(spark):
    chain = [(f"h{i:02d}", f"h{i + 1:02d}") for i in range(30)] + [("h30", "h05")]
    seeds = spark.createDataFrame([("h00", 1.0, 0.0), ("h30", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {x.host: (x.trust, x.distrust) for x in spread(spark.createDataFrame(chain, "src string, dst string"), seeds).collect()}
    t, b = exact({"h00": 1}, chain), exact({"h30": 1}, [(d, s) for s, d in chain])
    assert len(got) == 31 and all(abs(got[h][0] - t[h]) < TOLERANCE and abs(got[h][1] - b[h]) < TOLERANCE and min(got[h]) > 0 for h in got)
    rows = [page(i, f"http://{a}.example/", f"http://{b}.example/") for i, (a, b) in enumerate(chain[:20])] + [page(99, "http://h20.example/", "http://x.net/"), page(100, "http://x.net/")]
    assert {x.verdict for x in judge(pages(spark, rows)).collect()} == {"block"}


@pytest.mark.parametrize("seed", range(1))
def test_sql_on_pages_full_of_links(spark, seed):
    r = random.Random(seed)
    hosts = [f"h{i}.{r.choice(['net', 'org', 'com', 'example', 'example.net', 'example.com'])}" for i in range(40)]
    rows = []
    for i in range(160):
        url = r.choice(["http://", "HTTPS://"]) + r.choice(hosts).upper() + r.choice(["/en/", "/fr/", "/de/", "/", ""]) + r.choice(["a", "?q", "#f", ""])
        rows.append(page(i, url, *[r.choice(["http://", "//", "https://"]) + r.choice(hosts) + "/x" for _ in range(r.randint(0, 6))], "/local"))
    rows += [(500, None, rows[0][2]), (501, "http://h0.org/fr/", None), (502, "http://long.example/", rows[1][2] + "x" * 2_000_000 + '<a href="http://h1.net/">')]
    df = pages(spark, rows)
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = sorted(map(str, con.sql(OP4_SQL).fetchall()))
    got = judge(df).collect()
    assert sorted(str(tuple(x)) for x in got) == want
    assert len({x.verdict for x in got if x.rule is None}) == 2


def test_empty_repeats_and_extra_columns(spark):
    assert judge(pages(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "http://a.net/", None, "x", 2)] * 2, "page_id long, url string, html string, host string, verdict int")
    assert [(x.page_id, x.verdict) for x in judge(df).collect()] == [(1, "block")] * 2
