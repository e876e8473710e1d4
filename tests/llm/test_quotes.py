import random
import time

import duckdb
import pytest

from skein.llm.quotes import OP6_SQL, threads


def conv(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_nested_quotes_link_and_go(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you today?"),
        (1, 1, "assistant", "> How ARE you, today?\nFine, thanks."),
        (1, 2, "user", ">> how are you today\n> Fine thanks\nGood to hear."),
        (1, 3, "user", "> Hello there.\n> How are you today?\r\nSecond answer"),
        (1, 4, "user", "> nobody said this\nLost"),
        (2, 0, "user", "> Hello there.\nother conversation"),
    ]
    out = {(x.conv_id, x.turn): x for x in threads(conv(spark, rows)).collect()}
    assert [(out[1, t].reply_to, out[1, t].thread, out[1, t].depth, out[1, t].n_quote_levels) for t in range(5)] == [(None, 0, 0, 0), (0, 0, 1, 1), (1, 0, 2, 2), (0, 0, 1, 1), (None, 4, 0, 1)]
    assert out[1, 2].text == "Good to hear." and out[1, 0].text == rows[0][3] and out[2, 0].reply_to is None


def test_first_to_say_it_is_the_original_and_order(spark):
    rows = [(1, t, "user", "same line") for t in range(3)] + [(1, 5, "user", "> same line\nre"), (1, 4, "user", "new thread"), (1, 6, "user", "> re\nre re")]
    out = threads(conv(spark, rows)).collect()
    assert [(x.turn, x.reply_to, x.thread, x.depth) for x in out] == [(0, None, 0, 0), (5, 0, 0, 1), (6, 5, 0, 2), (1, None, 1, 0), (2, None, 2, 0), (4, None, 4, 0)]


def test_nulls_repeats_empty(spark):
    assert threads(conv(spark, [])).count() == 0
    rows = [(1, 0, None, None), (None, 1, "user", "> a\nb"), (1, None, "user", "a"), (1, 2, "user", ""), (1, 3, "user", "> x"), (1, 3, "user", "> x")]
    out = threads(conv(spark, rows).selectExpr("*", "1 AS thread", "2 AS h")).collect()
    assert len(out) == 6 and sorted(x.text for x in out) == ["", "", "", "", "a", "b"]


def test_long_chain(spark):
    rows = [(1, 0, "u", "line 0")] + [(1, t, "u", f"> line {t - 1}\nline {t}") for t in range(1, 20)]
    assert [(x.thread, x.depth) for x in threads(conv(spark, rows)).collect()] == [(0, t) for t in range(20)]


@pytest.mark.parametrize("seed", range(2))
def test_sql_on_conversations_full_of_quotes(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in range(12):
        said = []
        for t in range(r.randint(1, 14)):
            lines = []
            for _ in range(r.randint(1, 5)):
                if said and r.random() < 0.6:
                    old = r.choice(said).split("\n")
                    at = r.randrange(len(old))
                    lines += [r.choice([">", "> ", " >", ">>", "> > "]) + x.replace("a", "A") for x in old[at : at + r.randint(1, 3)]]
                else:
                    lines.append(r.choice(["", "ok", "same line", "é à", "word %d, and more" % r.randint(0, 30), "  spaced  out  "]))
            said.append("\n".join(lines))
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["\n", "\r\n"]).join(lines)))
    rows += [rows[3], (None, 1, "user", "> a"), (2, None, "user", "> b\nc"), (3, 40, None, None), (3, 41, "user", "")]
    df = conv(spark, rows)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    want = sorted(map(str, con.sql(OP6_SQL).fetchall()))
    got = threads(df).collect()
    assert sorted(str(tuple(x)) for x in got) == want
    assert sum(x.reply_to is not None for x in got) > 20 and max(x.n_quote_levels for x in got) > 2


def test_time_is_linear_in_the_lines_of_a_message(spark):
    first = "\n".join(f"line {i}" for i in range(40_000))
    answer = "\n".join(f"> line {i}\nanswer {i}" for i in range(40_000))
    threads(conv(spark, [(1, 0, "user", "warm"), (1, 1, "user", "> warm\nup")])).collect()
    start = time.time()
    out = {x.turn: x for x in threads(conv(spark, [(1, 0, "user", first), (1, 1, "user", answer)])).collect()}
    assert time.time() - start < 40
    assert out[1].reply_to == 0 and out[1].n_linked == 40_000 and out[1].text.startswith("answer 0\nanswer 1")


def test_ties_go_to_more_finds_then_the_latest(spark):
    rows = [(1, 0, "u", "a b\nc d"), (1, 1, "u", "e f"), (1, 2, "u", "> a b\n> e f\n> c d\nx"), (1, 3, "u", "> a b\n> e f\ny")]
    out = {x.turn: x.reply_to for x in threads(conv(spark, rows)).collect()}
    assert out[2] == 0 and out[3] == 1
