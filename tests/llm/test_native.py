import random

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import licenses, oracle, quotes
from palimpsest.llm.queries import oracle_sql, queries
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(name, spark, sf_dir):
    assert_same(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name])


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD")), plan


THREAD = [
    (1, 0, "ann", "Shall we meet on Monday?\nI can bring the slides."),
    (1, 1, "bob", "On Friday Ann wrote:\n> Shall we meet on Monday?\n> I can bring the slides.\nMonday is fine with me."),
    (1, 2, "cy", "Something else entirely, sorry."),
    (1, 3, "ann", "Bob schrieb gestern\r\n>> Shall we meet on Monday?\r\n> MONDAY  is fine, with me.\r\nThen at nine o'clock.\r\n"),
    (1, 4, "bob", ">>> Shall we meet on Monday?\n> > Monday is fine with me.\n> Then at nine o'clock.\nSee you there, all of you."),
    (1, 5, "dee", "> I can bring the slides.\nPlease do bring them."),
    (1, 6, "eve", "> nobody ever said this line\nWho said that, I wonder?"),
    (1, 7, "eve", "2 > 1 is no quotation at all"),
    (2, 0, "ann", "> Monday is fine with me.\nNot of this conversation."),
    (2, 1, None, None), (2, 2, "bob", ""), (None, 3, "x", "> Not of this conversation."), (2, None, "x", "> Not of this conversation."),
    (2, 4, "bob", "> Not of this conversation.\n> tiny"), (2, 4, "bob", "> Not of this conversation.\n> tiny"),
    (4, 0, "a", "A long paragraph that a mail program wraps.\nIt has two sentences. And a third one!\n\nAnother paragraph."),
    (4, 1, "b", "> A long paragraph that\n> a mail program wraps. It has two\n> sentences. And a third one!\n\nAgreed."),
    (4, 2, "c", "> ... And a third one!\nWhich?"), (4, 3, "a", "Yes."), (4, 4, "d", "> yes\nReally?"), (4, 5, "e", "Yes, but no."), (4, 6, "f", "> but\nBut what?"),
    (3, 0, "a", "the same opening line"), (3, 1, "b", "the same opening line"), (3, 2, "c", "> the same opening line\nyes, that one it is"),
]


@pytest.fixture(scope="module")
def threads(spark):
    return spark.createDataFrame(THREAD, "conv_id long, turn long, role string, text string")


def test_replies_are_linked_and_ordered(threads):
    got = {(r.conv_id, r.turn): r for r in quotes.link(threads).collect()}
    parent = {k: (r.parent_turn, r.root_turn, r.depth) for k, r in got.items()}
    assert parent[1, 1] == (0, 0, 1) and parent[1, 3] == (1, 0, 2) and parent[1, 4] == (3, 0, 3) and parent[1, 5] == (0, 0, 1)
    assert parent[1, 2] == (None, 2, 0) and parent[1, 6] == (None, 6, 0) and parent[1, 7] == (None, 7, 0) and parent[2, 0] == (None, 0, 0)
    assert parent[4, 1] == (0, 0, 1) and parent[4, 2] == (0, 0, 1) and parent[4, 4] == (3, 3, 1) and parent[4, 6] == (None, 6, 0)
    assert parent[2, 4] == (0, 0, 1) and parent[3, 2] == (0, 0, 1)
    assert got[1, 1].body == "Monday is fine with me." and got[1, 4].body == "See you there, all of you." and got[1, 7].body == "2 > 1 is no quotation at all"
    assert (got[1, 4].max_level, got[1, 4].n_passages) == (3, 3) and got[2, 1].body == ""
    assert len(quotes.link(threads).collect()) == len(THREAD)


def test_quotation_linking_against_sql(threads, tmp_path):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", THREAD)
    assert_same(quotes.link(threads), con, oracle.quotation_linking())


def quoting_threads(con, seed=9):
    """The conversations of a table with quotations added: most messages quote an earlier one with all that it quotes,
    whole, in part or wrapped anew; and one thread of 150 messages."""
    draw = random.Random(seed)
    rows = con.execute("select conv_id, turn, role, text from conversations order by conv_id, turn").fetchall()
    rows += [(10**6, t, "long", f"Message number {t}, in words of its own: {draw.random()}.") for t in range(150)]
    said: dict = {}
    out = []
    for conv, turn, role, text in rows:
        earlier = said.setdefault(conv, [])
        body = (text or "").replace(">", "")
        if earlier and (draw.random() < 0.8 or role == "long"):
            old = (earlier[-1].split("\n")[-5:] if role == "long" else draw.choice(earlier[-3:]).split("\n")[-12:])
            way = 1 if role == "long" else draw.random()
            if way < 0.3:
                old = old[: max(1, len(old) // 2)]
            elif way < 0.6 and not any(x.startswith(">") for x in old):
                w = " ".join(old).split()
                old = [" ".join(w[k : k + 7]) for k in range(0, len(w), 7)]
            mark = draw.choice([">", "> ", "> "])
            body = "\n".join([f"On day {turn} X wrote:"] * (draw.random() < 0.5) + [mark + x for x in old] + [body])
        earlier.append(body)
        out.append((conv, turn, role, body))
    return out


def test_thousands_of_quotations_against_sql(spark, tmp_path):
    con = connect("/root/testdata/sf0.1")
    rows = quoting_threads(con)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con.execute("drop view conversations")
    con.register("conversations", df.toPandas())
    got = quotes.link(df)
    assert_same(got, con, oracle.quotation_linking())
    linked = got.filter("parent_turn is not null")
    assert linked.count() > 2000 and linked.agg(F.max("depth")).first()[0] > 50
    no_python(quotes.link(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")))


def test_a_long_chain_of_replies(spark):
    rows = [(1, t, "r", f"message number {t} says its own words" + (f"\n> message number {t - 1} says its own words" if t else "")) for t in range(70)]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.turn, r.depth, r.root_turn) for r in got} == {(t, t, 0) for t in range(70)}


def test_empty_and_wide_conversations(spark, sf_dir, threads):
    base = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert quotes.link(base.filter("false")).count() == 0
    wide = threads.withColumns({n: F.lit("clash") for n in ("level", "hash", "u", "lines", "passages", "parent_turn", "depth", "n")})
    assert sorted(map(str, quotes.link(wide).collect())) == sorted(map(str, quotes.link(threads).collect()))
    no_python(quotes.link(base))


NOTICE = [
    (1, "Licensed under CC BY-NC 4.0.\nAll  Rights-Reserved. all rights reserved cc by cc by"),
    (2, "Prose first.\nReleased under the MIT Licence!\nProse again."),
    (3, "Permission is hereby granted,\nfree of charge, to any person obtaining a copy of this software\nand associated documentation files, to deal in the Software without restriction.\n\nAnother paragraph."),
    (4, "Permission is hereby granted,\n\nfree of charge, to any person obtaining a copy of this software"),
    (5, "released mit"), (6, None), (7, ""), (8, "GENERAL PUBLIC LICENSE"), (8, "GENERAL PUBLIC LICENSE"), (None, "all rights reserved"),
    (13, "This work is licensed under a Creative Commons\nAttribution 4.0 International License\nand more"),
    (14, "# Licensed under the\n# Apache License,\n# Version 2.0"), (15, "Licensed under the\n\nApache License, Version 2.0"), (16, "Released\nunder\nthe\nMIT\nLicense"),
    (9, "mit dem license under der\nthe released"), (10, "ÄCC BY cc by É"), (11, "x " * 50_000 + "general public license"), (12, "all rights all rights reserved reserved"),
]


def test_licenses_against_sql_and_by_hand(spark):
    df = spark.createDataFrame(NOTICE, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("norm", "key", "base", "present", "block", "label", "score", "unit")})
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", NOTICE)
    assert_same(licenses.scan(df), con, oracle.license_scan())
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (5, 2, 15, "cc-by,reserved")
    assert got[2].labels == got[3].labels == got[9].labels == "mit" and got[4].labels == got[5].labels == "" and got[2].score == 0.8
    assert got[13].labels == "cc" and got[14].labels == "apache-2.0" and got[15].labels == got[16].labels == ""
    assert (got[11].first_word, got[11].n_words) == (50_000, 50_003) and got[8].labels == "gpl"
    assert (got[6].n_words, got[6].first_word, got[6].labels, got[6].score) == (0, None, "", 0.0)
    assert licenses.scan(df.filter("false")).count() == 0


def test_license_scan_is_native(spark, sf_dir):
    no_python(queries()["op7_license_scan"](spark, sf_dir))
