"""One consistent form for text that looks the same but is stored with different characters (problem 1).

Strings that look the same are joined by union-find into classes, transitively: a
full-width form with its letter, a ligature with its letters, a letter of another
alphabet with the one it is drawn like, any space sign with the space, signs without
visible form with the empty string. Of a class, the representative is the member that
the collection uses most. Texts are decomposed canonically, rewritten by a
multi-pattern automaton (the longest pattern at each place, from left to right), and
composed again, so that a separate accent meets its letter also where a sign without
form stood between them or the letter came from another alphabet.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other alphabets and the Latin letters they are drawn like (fixed values, by the Unicode consortium's
#: published confusable characters; both strings are read in parallel): Greek, Cyrillic, Armenian, phonetic, Cherokee,
#: Lisu, Coptic, small capitals.
ALIKE = (
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("αινορυϲϳ", "aivopucj"),
    ("АВЕЅІЈКМНОРСТХҮԌԚԜӀ", "ABESIJKMHOPCTXYGQWI"),
    ("аеѕіјһорсухүѵԁԛԝӏ", "aesijhopcyxyvdqwl"),
    ("ՕՍՏօսոհցզ", "OUSounhgq"),
    ("ɡɑ", "ga"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    ("ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "HIKMNOoPpCcTYX"),
    ("ᴄᴏᴜᴠᴡᴢꜱѡ", "couvwzsw"),
)
#: Hyphens (fixed values): hyphen, non-breaking, Armenian, Canadian, Mongolian, hyphen bullet, small and full-width.
HYPHENS = "-‐‑֊᐀᠆⁃﹣－"
#: Signs of category Cf that do have a visible form: number signs and marks over digits (fixed values).
VISIBLE_FORMATS = frozenset("؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd")
#: Signs without visible form that aren't of category Cf: joiner of marks, fillers, inherent vowels (fixed values).
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍᠏"
#: Tags of a compatibility decomposition under which a sign counts as what it decomposes to.
FORMS = ("<wide>", "<narrow>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>")
#: Tags under which it does so only if it shows letters alone: ligatures, numerals of letters, squared words.
LETTERS_ONLY = ("<compat>", "<square>")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(g) for g in out.values() if len(g) > 1]


def alike_pairs() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same, by rule from the Unicode database and the fixed values above."""
    for theirs, ours in ALIKE:
        yield from zip(theirs, ours, strict=True)
    for c in HYPHENS:
        yield c, "-"
    for c in INVISIBLE:
        yield c, ""
    yield "\r\n", "\n"
    yield "\t", " "
    yield "⠀", " "
    for code in range(0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Zs":
            yield c, " "
        elif (kind == "Cf" and c not in VISIBLE_FORMATS) or (kind == "Cc" and c not in "\t\n\v\f\r\x85") or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            yield c, ""
        elif c != "ſ" and (shown := unicodedata.decomposition(c)).startswith("<"):  # the long s is seen as another letter
            tag, _, rest = shown.partition(" ")
            target = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
            if unicodedata.normalize("NFKD", c) != target:
                target = unicodedata.normalize("NFKD", c) if tag in FORMS else target
            letters = all(unicodedata.category(x)[0] in "LM" for x in target)
            if tag in FORMS or (tag in LETTERS_ONLY and letters):
                yield c, target
    yield "\r", ""


@lru_cache(maxsize=1)
def classes() -> tuple[tuple[str, ...], ...]:
    """The classes of strings that look the same; there are a few thousand members, whatever the data."""
    found = Classes()
    for a, b in alike_pairs():
        found.union(a, b)
    return tuple(tuple(g) for g in found.groups())


@lru_cache(maxsize=1)
def single_members() -> frozenset[str]:
    """The members of one sign, whose frequencies choose representatives."""
    return frozenset(x for g in classes() for x in g if len(x) == 1)


def rewriting(counts: dict[str, int]) -> dict[str, str]:
    """Pattern to representative, for every member that isn't one, given how often the signs occur.

    Of a class with the empty string that is the representative; of a class with a string
    of several signs, that string, each sign replaced by its own representative, as only
    that stays consistent; else the most frequent member; of equally frequent ones the smallest printable one.
    """
    chosen: dict[str, str] = {}
    longer: list[tuple[str, ...]] = []
    for group in classes():
        if "" in group:
            chosen.update((x, "") for x in group if x)
        elif any(len(x) > 1 for x in group):
            longer.append(group)
        else:
            best = min(group, key=lambda x: (-counts.get(x, 0), not x.isprintable(), x))
            chosen.update((x, best) for x in group)
    for group in longer:
        base = max(group, key=lambda x: (len(x), x)) if "\n" not in group else "\n"
        spelled = "".join(chosen.get(x, x) for x in base)
        chosen.update((x, spelled) for x in group)
    return {x: r for x, r in chosen.items() if x != r}


class _Rewriter:
    """The automaton of the rules. Its first level, the patterns of one sign, is kept as a table, which
    is all that a text without a longer pattern needs."""

    def __init__(self, rules: tuple[tuple[str, str], ...]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, to in rules:
            self.automaton.add_word(pattern, (len(pattern), to))
        self.automaton.make_automaton()
        self.table = str.maketrans({p: to for p, to in rules if len(p) == 1})
        longer = sorted(p for p, _ in rules if len(p) > 1)
        self.longer = re.compile("|".join(map(re.escape, longer))) if longer else None
        plain = {p[0] for p, _ in rules if p.isascii()}
        self.plain = re.compile("[" + "".join(map(re.escape, sorted(plain))) + "]") if plain else None

    def __call__(self, text: str) -> str:
        if text.isascii() and (self.plain is None or not self.plain.search(text)):
            return text
        if self.longer is None or not self.longer.search(text):
            return text.translate(self.table)
        out, at = [], 0
        for end, (size, to) in self.automaton.iter_long(text):
            out.append(text[at : end + 1 - size])
            out.append(to)
            at = end + 1
        out.append(text[at:])
        return "".join(out)


@lru_cache(maxsize=4)
def rewriter(rules: tuple[tuple[str, str], ...]) -> _Rewriter:
    """The rewriter of some thousand rules; a task looks it up once."""
    return _Rewriter(rules)


def consistent(text: str | None, rewrite: _Rewriter) -> str | None:
    """The consistent form of a text; null stays null, an empty text empty."""
    if text is None:
        return None
    return rewrite(text) if text.isascii() else unicodedata.normalize("NFC", rewrite(unicodedata.normalize("NFD", text)))


def sign_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """How often the collection uses each sign that has look-alikes: one pass, one small row per task and sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for column in batch.columns:
                for text in column:
                    if (t := text.as_py()) is not None:
                        total.update(t if t.isascii() else unicodedata.normalize("NFD", t))
        kept = [(c, n) for c, n in total.items() if c in single_members()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["sign", "n"])

    found = df.select(*columns).mapInArrow(run, "sign string, n long").groupBy("sign").agg(F.sum("n").alias("n"))
    return {r.sign: r.n for r in found.collect()}  # bounded by the members of the classes


def learn_rules(df: DataFrame, columns: list[str]) -> tuple[tuple[str, str], ...]:
    """The rewriting rules whose representatives this collection uses most."""
    return tuple(sorted(rewriting(sign_counts(df, columns)).items()))


def with_forms(df: DataFrame, columns: list[str], rules: tuple[tuple[str, str], ...], keep: Iterable[str]) -> DataFrame:
    """``keep`` and, for each of ``columns``, its consistent form under the same name: one pass, no shuffle."""
    keep = list(keep)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + "".join(f", `{c}` string" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = rewriter(rules)
        for batch in batches:
            forms = [pa.array([consistent(t, rewrite) for t in batch.column(c).to_pylist()], pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *forms], names=[*keep, *columns])

    return df.select(*keep, *columns).mapInArrow(run, schema)


def form_keys(df: DataFrame, key: str, columns: list[str], rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """(key, field, form_key, string_key): digests of the consistent form and of the string itself.

    Null texts and texts without a letter or digit are left out.
    """
    import hashlib

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, field string, form_key binary, string_key binary"

    def digest(text: str) -> bytes:
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = rewriter(rules)
        for batch in batches:
            for column in columns:
                keys, forms, strings = [], [], []
                for k, text in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist(), strict=True):
                    if text is None or k is None or not any(map(str.isalnum, text)):
                        continue
                    form = consistent(text, rewrite)
                    keys.append(k)
                    strings.append(own := digest(text))
                    forms.append(own if form == text else digest(form))
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(key).type), pa.array([column] * len(keys), pa.string()), pa.array(forms, pa.binary()), pa.array(strings, pa.binary())], names=[key, "field", "form_key", "string_key"])

    return df.select(key, *columns).mapInArrow(run, schema)
