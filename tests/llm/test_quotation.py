"""Quotation linking against a plain version, and its defined cases."""

import random

from dustline.llm import quotation

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id bigint, parent string"


def run(spark, rows):
    df = spark.createDataFrame([(c, t, "user", x, 1, "clash") for c, t, x in rows], SCHEMA)
    return {(r["conv_id"], r["turn"]): r for r in quotation.link(df.repartition(3)).collect()}


def test_levels_attributions_and_fences():
    own, quotes = quotation.parse("Yes.\n\nOn Monday Ann wrote:\n> I agree\n> fully.\n> Bob said:\n> > First   words\n>> go on.\n\nBye.")
    assert own == "Yes.\n\nBye."
    assert quotes == [(1, "I agree\nfully."), (2, "First   words\ngo on.")]
    assert quotation.parse("```\n> prompt\n```\ntext") == ("```\n> prompt\n```\ntext", [])
    assert quotation.parse("a > b") == ("a > b", [])
    assert quotation.parse(None) == ("", [])
    assert quotation.parse("> only") == ("", [(1, "only")])


def test_trees_equal_a_plain_version(spark):
    rng = random.Random(5)
    rows, parent, own = [], {}, {}
    for c in range(12):
        for t in range(rng.randrange(1, 25)):
            own[c, t] = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(5)) + "." for _ in range(rng.randrange(2, 5)))
            text = own[c, t]
            parent[c, t] = t - 1 if t else None
            if t and rng.random() < 0.7:
                p = rng.randrange(t)
                lines = own[c, p].split("\n")
                how = rng.random()
                if how < 0.3:
                    lines = lines[:1]
                elif how < 0.6:
                    lines = [w.upper() for w in " ".join(lines).split()]  # wrapped anew, other case
                quote = "\n".join("> " + x for x in lines)
                if parent[c, p] is not None and rng.random() < 0.5:
                    quote += "\n" + "\n".join(">> " + x for x in own[c, parent[c, p]].split("\n"))
                text = f"Ann wrote:\n{quote}\n\n{own[c, t]}"
                parent[c, t] = p
            rows.append((c, t, text))
    got = run(spark, rows)
    for c in range(12):
        turns = [t for cc, t in own if cc == c]
        order, level, stack = {}, {0: 0}, [0]
        while stack:
            at = stack.pop()
            order[at] = len(order)
            children = [t for t in turns if parent[c, t] == at]
            level |= {t: level[at] + 1 for t in children}
            stack += sorted(children, reverse=True)
        for t in turns:
            r = got[c, t]
            assert (r["own_text"], r["reply_to_turn"], r["level"], r["position"]) == (own[c, t], parent[c, t], level[t], order[t])


def test_nulls_repeats_long_texts_and_later_originals(spark):
    long = "word " * 200_000
    rows = [(1, 0, "> said later\n\nhello there"), (1, 1, "said later"), (1, 2, long), (1, 3, "> " + long), (2, None, None), (2, None, None), (None, 0, "a"), (None, 1, "> a\nb"), (3, 0, "")]
    df = spark.createDataFrame([(c, t, None, x, 1, "clash") for c, t, x in rows], SCHEMA)
    out = quotation.link(df).collect()
    assert len(out) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in out}
    assert by[1, 0]["n_quotes"] == 1 and by[1, 0]["n_linked"] == 0 and by[1, 0]["reply_to_turn"] is None
    assert by[1, 3]["reply_to_turn"] == 2 and by[1, 3]["own_text"] == "" and by[1, 3]["quoted"]
    assert by[None, 1]["reply_to_turn"] == 0 and by[None, 1]["own_text"] == "b"
    assert sorted(r["position"] for r in out if r["conv_id"] == 2) == [0, 1]
    assert quotation.conversations(quotation.link(df)).count() == 5
    assert quotation.link(df.limit(0)).count() == 0


def test_a_long_chain_over_many_cells(spark):
    rows = [(9, t, f"message number {t}") for t in range(3000)] + [(9, 3000, "> message number 10\nok"), (9, 3001, "> message number 10\nyes")]
    got = run(spark, rows)
    assert [got[9, t]["position"] for t in range(3002)] == list(range(11)) + list(range(11, 3000)) + [3000, 3001]
    assert got[9, 2999]["level"] == 2999 and got[9, 3001]["level"] == 11
