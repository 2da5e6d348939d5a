import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import lookalike as L
from textloom.llm.pairs import group_pairs

LATIN = L.rewriter(tuple(sorted(L.rewriting({" ": 1000, **{chr(c): 100 for c in range(33, 127)}}).items())))
CYRILLIC = L.rewriter(tuple(sorted(L.rewriting({" ": 1000, **{c: 100 for c in "аеосрхАВЕКМНОРСТХ"}, " ": 5}).items())))

SAME = [("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"), ("ﬁn ﬂat ﬀ", "fin flat ff"), ("Café", "Café"), ("no break thin", "no break thin"), ("a‑b‐c－d", "a-b-c-d"), ("ze​ro­﻿", "zero"), ("Москва сор", "Mocквa cop"), ("е‍́", "é"), ("Ⅲ ⅳ", "III iv"), ("K", "K"), ("օԁԛ", "odq"), ("ά", "ά"), ("a\r\nb", "a\nb"), ("ộ", "ộ"), ("㎏", "kg"), ("ǆ", "dž")]
APART = ["A a", "é e", "ß ss", "ø o", "ł l", "² 2", "⑩ 10", "— -", "a  b a b", "l I", "0 O", "1 l", "\n  "]


@pytest.mark.parametrize("rules", [LATIN, CYRILLIC])
def test_same_and_apart(rules):
    for a, b in SAME:
        assert L.consistent(a, rules) == L.consistent(b, rules), (a, b)
    for pair in APART[:8]:
        a, b = pair.split(" ")
        assert L.consistent(a, rules) != L.consistent(b, rules), pair
    for a, b in (("l", "I"), ("0", "O"), ("1", "l"), ("a  b", "a b"), ("a\nb", "a b")):
        assert L.consistent(a, rules) != L.consistent(b, rules)
    for a, _ in SAME:
        once = L.consistent(a, rules)
        assert L.consistent(once, rules) == once
    assert L.consistent(None, rules) is None and L.consistent("", rules) == ""


def test_frequency_chooses():
    assert L.consistent("а", LATIN) == "a" and L.consistent("a", CYRILLIC) == "а"
    assert L.consistent("plain text", LATIN) == "plain text"


def test_classes_are_transitive():
    of = {x: i for i, g in enumerate(L.classes()) for x in g}
    assert of["ο"] == of["о"] == of["o"] == of["ｏ"]
    assert of["I"] != of["l"] and len(of) == sum(map(len, L.classes()))


def test_tables(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        t = "".join(rng.choice("abc") for _ in range(2))
        t = "".join({"a": rng.choice("aаａ"), "c": rng.choice("cс"), "b": rng.choice(["b", "b​"])}[c] for c in t)
        rows.append((i, rng.choice([None, "", "--", t]), t, 1))
    rows += rows[:40] + [(None, "aa", "bb", 2), (900, "x" * 100_000, None, 3), (901, "x" * 99_999 + "х", None, 3)]
    df = spark.createDataFrame(rows, "page_id long, title string, text string, field int")
    rules = L.learn_rules(df, ["title", "text"])
    keys = L.form_keys(df, "page_id", ["title", "text"], rules).distinct()
    got = set()
    for f in ("title", "text"):
        part = keys.filter(F.col("field") == f).collect()
        got |= {(a.page_id, b.page_id, f) for a in part for b in part if a.page_id < b.page_id and a.form_key == b.form_key and a.string_key != b.string_key}
    want = set()
    held = {(r[0], f): r[i] for r in rows if r[0] is not None for f, i in (("title", 1), ("text", 2))}
    for (p, f), a in held.items():
        for (q, g), b in held.items():
            if p < q and f == g and a and b and a != b and any(map(str.isalnum, a)) and L.consistent(a, LATIN) == L.consistent(b, LATIN):
                want.add((p, q, f))
    assert got == want and any(f == "title" and q == 901 for _, q, f in got)
    forms = {r.page_id: r.title for r in L.with_forms(df, ["title"], rules, ["page_id", "field"]).collect()}
    assert forms[900] == forms[901]
    empty = df.limit(0)
    assert L.form_keys(empty, "page_id", ["title"], L.learn_rules(empty, ["title"])).count() == 0


@pytest.mark.parametrize("block", [1, 7, 2000])
def test_group_pairs(spark, block):
    rows = [("big", i) for i in range(60)] + [("one", 1), ("two", 5), ("two", 4), (None, 1), (None, 2), ("x", None)]
    df = spark.createDataFrame(rows, "g string, x long")
    got = sorted(tuple(r) for r in group_pairs(df, "g", "x", block).collect())
    assert got == sorted([("big", i, j) for i in range(60) for j in range(i + 1, 60)] + [("two", 4, 5)])


@pytest.mark.parametrize(("theirs", "ours"), [("ᎪᏞᎳᎠ", "ALWD"), ("ꓐꓳꓫ", "BOX"), ("ⲟⲣⲥ", "opc"), ("ᴄᴏᴡ", "cow"), ("ѡ", "w")])
def test_letters_of_other_alphabets(theirs, ours):
    rewrite = L.rewriter(tuple(sorted(L.rewriting({c: 9 for c in ours}).items())))
    assert L.consistent(theirs, rewrite) == L.consistent(ours, rewrite) == ours
