import re

import pytest

pytest.importorskip("tideline.llm")


def brute(rows):
    """Parents by the rules in words: normalised passages of a level against what earlier messages say themselves."""
    from tideline.llm.quote_links import INTRODUCES

    def level(line):
        return re.match(r"^((?:[ \t]*>)*)", line)[1].count(">")

    def normal(p):
        return re.sub(r"[\W_]+", " ", p.lower()).strip()

    def passages(text, k):
        out, now = set(), []
        for line in [*text.split("\n"), ""]:
            body = re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line) if level(line) else line
            if level(line) == k and body.strip(" \t") and not re.match(INTRODUCES, line):
                now.append(body)
            else:
                out |= {normal("\n".join(now)), *map(normal, now)}
                now = []
        return {p for p in out if p}

    parent = {}
    for c, t, text in rows:
        best = None
        for k in range(1, 9):
            votes = {}
            for p in passages(text, k):
                source = max((u for d, u, x in rows if d == c and u < t and p in passages(x, 0)), default=None)
                if source is not None:
                    votes[source] = votes.get(source, 0) + len(p)
            if votes:
                best = max(votes, key=lambda u: (votes[u], u))
                break
        parent[c, t] = best
    return parent


MAIL = [
    (1, 0, "Hello everyone, shall we meet on Monday?\n\nI can bring the slides."),
    (1, 1, "> Hello everyone, shall we meet on Monday?\nMonday is fine."),
    (1, 2, "On Tue, A B wrote:\n> I can bring the slides.\n\nPlease do so."),
    (1, 3, "On Wed, C wrote:\n> > Hello everyone, shall\n> > we meet on Monday?\n> Monday is fine.\n\nSee you then."),
    (1, 4, ">> monday is FINE\n>nothing known here at all\nAgreed."),
    (1, 5, "> > > Hello everyone, shall we meet on Monday?\n> Please do so.\n\n\nThanks"),
    (1, 6, "A message that starts a thread of its own."),
    (2, 0, "> Monday is fine.\nBut this is another conversation."),
    (2, 1, "a > b is no quote"),
    (1, 3000, "> A message that starts a thread of its own.\nMuch later."),
    (1, 3001, "> Much later.\nAnd later still."),
]


def test_links(spark):
    from tideline.llm.quote_links import link_quotes

    df = spark.createDataFrame([(*r[:2], "user", r[2], 1) for r in MAIL] + [(None, 1, "user", "> x", 1), (3, None, None, "y", 1), (4, 0, "user", None, 1), (4, 1, "user", "", 1)], "conv_id long, turn long, role string, text string, h int")
    got = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    want = brute(MAIL)
    assert {k: got[k].parent_turn for k in want} == want
    assert [want[1, t] for t in (1, 2, 3, 4, 5, 3000, 3001)] == [0, 0, 1, 1, 2, 6, 3000]
    assert got[1, 3].text == "See you then." and got[1, 2].text == "Please do so." and got[2, 1].text == "a > b is no quote"
    assert got[1, 3001].root_turn == 6 and got[1, 4].root_turn == 0
    for (c, t), p in want.items():
        assert p is None or got[c, t].position > got[c, p].position
    assert sorted(r.position for r in got.values() if r.conv_id == 1) == list(range(9))
    assert got[None, 1].position is None and got[3, None].position is None and got[4, 0].text is None
    assert link_quotes(df.limit(0)).count() == 0


def test_without_quotes_the_order_is_that_of_turns(spark):
    from tideline.llm.quote_links import link_quotes

    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    text = {(r.conv_id, r.turn): r.text for r in df.collect()}
    got = link_quotes(df).collect()
    assert len(got) == len(text) and all(r.position == r.turn and r.text == text[r.conv_id, r.turn] for r in got)


def test_sql_gives_the_same(spark, tmp_path):
    import duckdb

    from tideline.llm.quote_links import ORACLES, op3_quote_links

    spark.createDataFrame([(c, t, "user", x) for c, t, x in MAIL], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = op3_quote_links(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op3_quote_links']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_short_passages_link(spark):
    from tideline.llm.quote_links import link_quotes

    rows = [(1, 0, "Shall we?"), (1, 1, "Yes, ok"), (1, 2, "> Yes, ok\nGood."), (1, 3, "我们走吧。"), (1, 4, "> 我们走吧。\n好"), (1, 5, "> --\n\nNothing quoted.")]
    got = {r.turn: r.parent_turn for r in link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 1, 3: None, 4: 3, 5: None}


def test_long_and_deeply_nested_texts(spark):
    from tideline.llm.quote_links import link_quotes

    long = "word " * 1_000_000
    rows = [
        (1, 0, "A message to quote."),
        (1, 1, ">" * 100_000 + "A message to quote."),
        (1, 2, "> A message to quote.\n" + "\n" * 100_000 + "Then this." + "\n \t" * 100_000),
        (1, 3, "\n".join(">" * k + f" level {k}" for k in range(1, 3_000))),
        (1, 4, long),
        (1, 5, "> " + long + "\nThat was long."),
        (1, 6, " \t" * 100_000 + "\n> A message to quote.\n" + "> \n" * 100_000),
        (1, 7, "On " + "x" * 200_000 + " wrote:\n> A message to quote.\nOn Tue, A B wrote:\n"),
    ]
    got = {r.turn: r for r in link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert [got[t].parent_turn for t in range(8)] == [None, 0, 0, None, None, 4, 0, 0]
    assert got[2].text == "Then this." and got[5].text == "That was long." and got[6].text == "" and got[4].text == long
    assert got[3].n_quoted == 2_999 and got[6].n_quoted == 100_001


def test_positions_of_a_long_thread_and_of_many(spark):
    from pyspark.sql import functions as F

    from tideline.llm.quote_links import with_positions

    n = 50_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("long").alias("root_turn"), F.lit("u").alias("role"), F.lit("x").alias("text"))
    got = {r.turn: r.position for r in with_positions(df.repartition(7)).collect()}
    order = sorted(range(n), key=lambda t: (0 if t % 3 == 0 else t, t))
    assert all(got[t] == k for k, t in enumerate(order))
