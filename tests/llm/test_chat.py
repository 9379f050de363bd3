import random

import duckdb
import pytest

from recollect.llm import chat, queries

S = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    return chat.link_quotes(spark.createDataFrame(rows, S))


def as_sql(rows):
    db = duckdb.connect()
    db.execute("create table messages (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        db.executemany("insert into messages values (?, ?, ?, ?)", rows)
    cur = db.execute(chat.QUOTES_SQL.format(messages="messages"))
    return [c[0] for c in cur.description], cur.fetchall()


def same_as_sql(spark, rows):
    got = run(spark, rows)
    cols, want = as_sql(rows)
    assert got.columns == cols
    have = sorted((tuple(r) for r in got.collect()), key=repr)
    assert have == sorted(want, key=repr)
    return have


ROWS = [
    (1, 0, "a", "The budget is too small for this plan.\nWe need more people by the end of May. Nobody doubts it."),
    (1, 1, "b", "I think the schedule is fine."),
    (1, 2, "c", "On Monday, a wrote:\n> the BUDGET is too small  for this plan.\n\nI agree with that."),
    (1, 3, "a", "> > We need more people by\n> > the end of May. Nobody\n> I agree with that.\nAs my mother said:\nGood."),
    (1, 4, "b", "> nobody ever said this\nHm."),
    (2, 0, "d", "> We need more people by the end of\n> May.\nSo do we."),
    (2, 7, "e", "Later on."),
    (2, 9, "e", "ok"),
    (3, 0, "f", "> ok\nfine"),
    (3, 1, "f", "The budget is too small for this plan."),
    (4, 0, "g", "see:\n> The budget is too small for this plan.\nyes"),
]


def test_links(spark):
    same_as_sql(spark, ROWS)
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, ROWS).collect()}
    link = lambda *k: (got[k]["reply_conv"], got[k]["reply_turn"], got[k]["linked"])
    assert link(1, 0) == (None, None, False) and link(1, 1) == (1, 0, False)
    assert link(1, 2) == (1, 0, True) and got[1, 2]["text"] == "I agree with that."
    # an own line that looks like an introduction stays, as no quote follows it
    assert link(1, 3) == (1, 2, True) and got[1, 3]["quote_depth"] == 2 and got[1, 3]["text"] == "As my mother said:\nGood."
    assert link(1, 4) == (1, 3, False) and got[1, 4]["linked_passages"] == 0 < got[1, 4]["quoted_passages"] and got[1, 4]["text"] == ROWS[4][3]
    # wrapped anew, the sentence is found all the same; one short line is not enough for another conversation
    assert link(2, 0) == (1, 0, True) and link(2, 7) == (2, 0, False) and link(3, 0) == (None, None, False)
    assert link(4, 0) == (1, 0, True) and got[4, 0]["text"] == "see:\nyes"
    assert {k[0]: r["thread_id"] for k, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 1}
    # replies come after what they reply to, across conversations
    place = {k: (r["thread_id"], r["position"]) for k, r in got.items()}
    for k, r in got.items():
        if r["reply_turn"] is not None:
            a, b = place[r["reply_conv"], r["reply_turn"]], place[k]
            assert a[0] == b[0] and a[1] < b[1]
    assert sorted(p for t, p in place.values() if t == 1) == list(range(1, 10))


def test_only_linked_quotes_go(spark):
    """Prompts, code and quotes that nobody wrote stay; a block with one linked passage goes whole."""
    code = "```\n>>> print('x')\n> we need more people now\n```"
    rows = [
        (1, 0, "a", "we need more people now"), (1, 1, "b", f"try this:\n{code}\nor\n> npm test\n> b"), (1, 2, "c", ">>> print(7)\n7"), (1, 3, "d", "Someone wrote:\n> not in here\n\n\n\nright"),
        (1, 4, "e", "On May 1, a wrote:\n\n> we need more people now\n> - a\nyes\n> nothing of this was said\nno"), (1, 5, "f", "~~~\n> we need more people now"), (2, 0, "g", "> never said\n" + code),
    ]
    got = {(r[0], r[1]): r for r in same_as_sql(spark, rows)}
    for c, t, _, text in rows:
        if (c, t) != (1, 4):
            assert got[c, t][3] == text and not got[c, t][8]
    assert got[1, 4][3] == "yes\n> nothing of this was said\nno" and got[1, 4][6:9] == (1, 0, True)


def test_earliest_other_conversation(spark):
    text = "this passage has enough words to count"
    rows = [(1, 0, "a", "> " + text), (1, 1, "a", text), (2, 5, "b", text), (3, 0, "c", text)]
    got = {(r[0], r[1]): r for r in same_as_sql(spark, rows)}
    assert got[1, 0][6:9] == (2, 5, True)


def test_circle_of_links(spark):
    """Two conversations that quote each other, and a third that quotes into the circle."""
    one, two = "the first passage that the other one quotes", "the second passage that the first one quotes"
    rows = [(1, 0, "a", f"> {two}\n{one}"), (1, 1, "a", "more"), (2, 0, "b", f"> {one}\n{two}"), (2, 1, "b", "and more"), (0, 0, "c", f"> {two}\nwell")]
    got = {(r[0], r[1]): r for r in same_as_sql(spark, rows)}
    assert got[1, 0][6:9] == (2, 0, True) and got[2, 0][6:9] == (1, 0, True) and {r[4] for r in got.values()} == {0}
    assert sorted(r[5] for r in got.values()) == [1, 2, 3, 4, 5] and got[1, 0][5] < got[2, 0][5] < got[0, 0][5]


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rng, rows = random.Random(seed), []
    words = ["alpha", "beta", "gamma", "delta", "épée", "zeta"]
    for c in range(8):
        for t in range(rng.randrange(1, 9)):
            fence = ["```"] if rng.random() < 0.2 else []
            own = fence + [" ".join(rng.choices(words, k=rng.randrange(1, 9))) + rng.choice([".", "", "?"]) for _ in range(rng.randrange(0, 4))]
            quote = []
            if rows and rng.random() < 0.6:
                said = rng.choice(rows)[3].split()
                at = rng.randrange(len(said) + 1)
                mark = rng.choice(["> ", ">> ", "> > ", ">"])
                quote = [mark + " ".join(said[at : at + 4]), mark + " ".join(said[at + 4 :])] if rng.random() < 0.4 else [mark + x for x in rng.choice(rows)[3].split("\n")]
                quote = (["X wrote:"] if rng.random() < 0.5 else []) + ([""] if rng.random() < 0.2 else []) + quote + ([""] if rng.random() < 0.5 else [])
            rows.append((c, t * rng.choice([1, 1, 1000003]) + (t if rng.random() < 0.9 else 0), rng.choice(["u", "v", None]), "\n".join(quote + own if rng.random() < 0.8 else own + quote)))
    rows += rng.choices(rows, k=3)
    same_as_sql(spark, rows)


def test_query(spark, sf, oracle):
    got = sorted((r.asDict() for r in queries.op9_quote_links(spark, sf).collect()), key=repr)
    assert got == oracle(queries.oracle_sql()["op9_quote_links"]) and len(got) == spark.read.parquet(f"{sf}/conversations.parquet").count()


def test_long_conversation_and_odd_rows(spark):
    # turns like clock times, many to a conversation
    rows = [(1, i * 86400000, "u", f"line number {i} of it all") for i in range(3000)] + [(1, 3000 * 86400000, "u", "> line number 5 of it all\nthat one")]
    rows += [(None, 1, "u", "> x\ny"), (2, None, "u", "x"), (3, 0, "u", None), (3, 1, None, ""), (3, 1, None, ""), (3, 2, "u", ">\n> \n"), (3, 3, "u", "x " * 50000), (3, 3, "b", "x"), (None, None, None, None)]
    have = same_as_sql(spark, rows)
    got = {r[:2]: r for r in have}
    assert [got[1, i * 86400000][5] for i in range(3000)] == list(range(1, 3001))
    assert got[1, 3000 * 86400000][6:8] == (1, 5 * 86400000)
    assert len(have) == len(rows) and got[None, 1][3:9] == ("> x\ny", None, None, None, None, False)
    extra = spark.createDataFrame([(1, 0, "u", "hi", 7, "q")], S + ", position long, _p string")
    assert chat.link_quotes(extra).count() == 1
    assert run(spark, []).count() == 0
