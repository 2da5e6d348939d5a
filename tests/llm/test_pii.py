import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import pii

NAMES = [("Anna", "given"), ("Bela", "given"), ("Clara", "given"), ("Moss", "family"), ("Stone", "family"), ("Åberg", "family"), (None, "given"), ("X", None)]
DOCS = {
    1: ("Contact: Anna Moss <anna.moss@mail.example.org> or +44 (0)7700 900123.", {("name", "Anna Moss"), ("email", "anna.moss@mail.example.org"), ("phone", "+44 (0)7700 900123")}),
    2: ("Write to b.stone (at) notes (dot) example, mailto:X_1+y@A.EXAMPLE, not @bela or Recall@10 rose.", {("email", "b.stone (at) notes (dot) example"), ("email", "X_1+y@A.EXAMPLE")}),
    3: ("ring (312) 555 0107, 07700 900 985, 030/23125208, 0049 30 23125-284 2024-01-01, 1-202-555-0157. ISBN 978-0-288-74137-5", {("phone", "(312) 555 0107"), ("phone", "07700 900 985"), ("phone", "030/23125208"), ("phone", "0049 30 23125-284"), ("phone", "1-202-555-0157")}),
    4: ("My SSN is 969-17-2075, passport no.: XK 3370084; NI number=QQ 16 66 79 B; DNI 99866198-Z. Our form asks for a tax id, e.g. 500834-8966 and nothing else.", {("id_number", "969-17-2075"), ("id_number", "XK 3370084"), ("id_number", "QQ 16 66 79 B"), ("id_number", "99866198-Z"), ("id_number", "500834-8966")}),
    5: ("Flat 3, 206 Old Mill Street or 12 bis, rue du Vieux Moulin, C/ Molino Viejo nº 12b, Amselgasse 9a, 8 N. Orchard Ave.", {("address", "206 Old Mill Street"), ("address", "12 bis, rue du Vieux Moulin"), ("address", "C/ Molino Viejo nº 12b"), ("address", "Amselgasse 9a"), ("address", "8 N. Orchard Ave")}),
    6: ("The old Moss Road is closed; The Stone Bridge and Mount Anna. ISSN 7587-9243, offset 242000430, Order 0740-705.", set()),
    7: ("Signed, Stone, Bela\nDr. CLARA MOSS's plan; Anna K. Moss-Åberg", {("name", "Stone, Bela"), ("name", "CLARA MOSS"), ("name", "Anna K. Moss-Åberg")}),
    8: (None, set()),
    9: ("", set()),
    10: ("   ", set()),
}


def run(spark, texts, names=NAMES):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts], "doc_id long, text string, kind string")
    listed = spark.createDataFrame(names, "name string, role string")
    return docs, pii.personal_items(docs, listed)


def test_items(spark):
    rows = [(k, t) for k, (t, _) in DOCS.items()]
    docs, found = run(spark, [*rows, rows[0], (None, rows[0][1])])
    got = {}
    for r in found.collect():
        text = DOCS[r.doc_id][0]
        assert text[r.start : r.end] == r.found
        got.setdefault(r.doc_id, set()).add((r.kind, r.found))
    for k, (_, want) in DOCS.items():
        assert got.get(k, set()) == want, k
    clean = {r.doc_id: r.text for r in pii.sanitised(docs.filter("doc_id is not null").distinct(), found).collect()}
    assert clean[1] == "Contact: [NAME] <[EMAIL]> or [PHONE]." and clean[8] is None and clean[9] == "" and clean[6] == DOCS[6][0]


def test_unlisted_names_are_learned(spark):
    """A word that stands before listed family names becomes a given name; a title does not."""
    texts = [(i, f"drawn by Dorit {f} and kept.") for i, f in enumerate(["Moss", "Stone", "Åberg", "Moss"])]
    texts += [(10 + i, f"drawn by {g} Zwick and kept. Mr Moss left the house by the sea. The Stone type of the north.") for i, g in enumerate(["Anna", "Bela", "Clara"])] + [(20, "Then Dorit Zwick came by the road. The Moss type, the Stone Bridge. The end of the day, the end.")]
    _, found = run(spark, texts)
    got = {(r.doc_id, r.found) for r in found.collect()}
    assert (20, "Dorit Zwick") in got and (0, "Dorit Moss") in got and (10, "Anna Zwick") in got
    assert not any(f.startswith(("The ", "Mr ")) for _, f in got)


def test_nothing_and_long(spark):
    _, found = run(spark, [])
    assert found.count() == 0
    _, found = run(spark, [(1, "x " * 200_000 + "call +12025550119 " + "9" * 100_000 + " A" * 50_000)], [])
    assert [(r.kind, r.found) for r in found.collect()] == [("phone", "+12025550119")]


@pytest.mark.parametrize(("spans", "want"), [([], "abcdef"), ([(1, 3, "name")], "a[NAME]def"), ([(1, 3, "name"), (1, 5, "email"), (4, 6, "phone")], "a[EMAIL]f"), ([(0, 6, "address")], "[ADDRESS]")])
def test_replaced(spans, want):
    assert pii.replaced("abcdef", spans) == want


def test_gates_let_non_breaking_spaces_through():
    """What only a pattern with a non-breaking space finds is tried at all."""
    for text, kind, found in (
        ("ring (030)\xa01234567", "phone", "(030)\xa01234567"),
        ("at 206 Old\xa0Mill\xa0Lane", "address", "206 Old\xa0Mill\xa0Lane"),
        ("12 Old\xa0Mill\xa0Street", "address", "12 Old\xa0Mill\xa0Street"),
        ("AT 206 OLD\xa0MILL\xa0ROAD", "address", "206 OLD\xa0MILL\xa0ROAD"),
        ("b.stone (at\xa0) notes (dot) example", "email", "b.stone (at\xa0) notes (dot) example"),
        ("conservé au 147a bis, avenue aux Herbes", "address", "147a bis, avenue aux Herbes"),
    ):
        assert (kind, found) in {(k, text[a:b]) for a, b, k, *_ in pii.scan(text)}, text


PIECES = ["12", "07700", "900", "123", "+44", "0049", "(030)", "(0)", "969", "17", "2075", "12345678", "QQ", "A", "X", "XK", "QUILL", "Old", "Mill", "Street", "LANE", "Rd", "rue", "du", "Calle", "C/", "nº", "Amselgasse", "Kurze", "Str.", "Am", "Unter", "den", "Anna", "Moss", "Moss's", "Moss,", "B.", "bis,", "a", "b.stone", "notes", "example", "@", "[at]", "(at\xa0)", "(dot)", "dot", "at", "SSN", "passport", "no.:", "é", "١٢٣", "𝟙", "Ǆ", "_", "x_"]


@given(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from(["", " ", "\xa0", "\u2009", "\u202f", "-", ".", "/", ", ", "\n", "  "])), max_size=24))
@settings(max_examples=1500, deadline=None)
def test_gates_change_nothing(pieces):
    """Trying the patterns only where they can match finds what trying them everywhere finds, with any blank between."""
    text = "".join(a + b for a, b in pieces)
    assert set(pii.scan(text)) == set(pii.scan(text, gates=False)), text


def test_forms_disclose_by_what_stands_beside_them(spark):
    """A published form that the collection uses for other things stops to disclose; an unknown one that stands behind labels begins to."""
    texts = [(i, f"Part 123-{10 + i % 90}-{1000 + i} fits the pump and was made in the old mill by the river, with brass at both ends and a lid of oak.") for i in range(400)]
    texts += [(1000 + i, f"My passport no. is KLM-{100000 + i}-B. The mill stands by the river and the old road leads from it to the hill.") for i in range(40)]
    texts += [(2000, "We keep KLM-555555-C in the box."), (2001, "Write to a.b@mail.example or call +44 7700 900123.")]
    got = {}
    for r in run(spark, texts, [])[1].collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.found))
    assert not any(k < 1000 for k in got)
    assert got[1000] == {("id_number", "KLM-100000-B")} and got[2001] == {("email", "a.b@mail.example"), ("phone", "+44 7700 900123")}
