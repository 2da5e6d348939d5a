"""Personal items in free text, and text without them (problem 10).

Finite patterns give candidates: what has the form of an email address, a phone
number, an identity number, a street address or a name. None is an item by its form
alone; what the whole collection shows about the terms of and around the candidates
decides. For a term t and a kind k, counts over all documents estimate how strongly t
reveals an item of the kind: P(k | t), and the pointwise mutual information
log2(P(k | t) / P(k)) in bits. Three sorts of terms are estimated:

* forms, a candidate generalised to its shape: how often it stands beside a word for
  its kind or beside a form of another kind, against how often any place of the texts
  does. Published forms (a grammar that issues them) begin with some occurrences of
  evidence, so they disclose in small collections too, and stop to disclose where the
  collection uses the form for something else;
* parts of names: capitalised words that stand before listed family names are learned
  as given names, and the other way round;
* frames, the words and signs beside a candidate: frames that mostly hold disclosing
  forms vouch for candidates whose form says too little.

Candidates with a term above the thresholds are replaced by their kind. All counts are
group-bys over all documents; nothing is read to the driver or sent to the tasks but the
table of forms, which the grammars bound.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.skew import lookup_join
from textloom.session import written

#: Thresholds of disclosure: a form's probability and information in bits; a name part's, with its different partners; a frame's probability and occurrences.
FORM_P, FORM_BITS = 0.25, 1.5
NAME_PART_P, NAME_PART_BITS, NAME_PART_PARTNERS = 0.25, 2.0, 2
FRAME_P, FRAME_SUPPORT = 0.5, 3
#: Where neither part of a name is known, the frame must say more.
BARE_FRAME_P, BARE_FRAME_SUPPORT = 0.75, 5
#: Occurrences of evidence that a form begins with: for a published form all of them speak for the kind, else as many as by chance.
PRIOR = 20
#: What stands within so many signs of a candidate is beside it; a word for its kind stands within the second number of signs before it.
BESIDE, BEFORE = 100, 48
#: A frame or term with more than this share of the candidates is joined in place.
HOT_SHARE = 1e-3
#: Signs of a cell of a text in which overlaps are looked for.
CELL_BITS = 9

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# --- forms ------------------------------------------------------------------------

_AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
EMAIL = re.compile(
    rf"(?<![\w.+%-])(?:[\w%+-]+(?:\.[\w%+-]+)*{_AT}[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)*{_DOT}[^\W\d_]{{2,}}"
    r"|[\w%+-]+(?:(?:\.| dot )[\w%+-]+)* at [^\W_][\w-]*(?: dot [^\W_][\w-]*)* dot [^\W\d_]{2,})(?![\w-])",
    re.I,
)

#: What each email can't do without; the text is in lower case.
EMAIL_SIGNS = ("@", "at)", "at]", " dot ")
EMAIL_SPACED = re.compile(r"at\s[\])]")
#: National digits behind a country code; codes not listed have 7 to 12.
_NATIONAL = {"1": (10, 10), "7": (10, 10), "33": (9, 9), "34": (9, 9), "44": (10, 10), "49": (7, 12)}
_INTERNATIONAL = re.compile(r"(?<![\w+.])(?:\+|00(?=[1-9]))([1-9]\d{0,14})")
_GROUP = re.compile(r"[ \xa0.\-/]?(?:\(0\)[ \xa0]?)?\(?(\d+)\)?")
#: Published national forms of phone numbers by name.
PHONES = {
    "north american": re.compile(r"(?<![\w.+\-/(])(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\w\-])"),
    "mobile 07": re.compile(r"(?<![\w.+\-/(])07\d{3}[ \xa0]?\d{3}[ \xa0]?\d{3}(?![\w\-])"),
    "area/number": re.compile(r"(?<![\w.+\-/(])0\d{2,5}/\d{4,9}(?:-\d{1,4})?(?![\w\-])"),
    "(area) number": re.compile(r"(?<![\w.+\-/])\(0\d{1,5}\)[ \xa0]?\d{3,9}(?:[ \xa0\-]\d{1,6})?(?![\w\-])"),
    "five pairs": re.compile(r"(?<![\w.+\-/(])0\d(?:[ \xa0.\-]\d\d){4}(?![\w\-])"),
}
#: A national number of other grouping, or plain digits.
WEAK_PHONE = re.compile(r"(?<![\w.+\-/(])(?:0\d{2,4}[ \xa0\-]\d{3,8}(?:[ \xa0\-]\d{2,5})?|0\d{9,10}|\d{9}|\d{3} \d{3} \d{3})(?![\w\-])")

#: Published forms of identity numbers by name.
IDS = {
    "two letters, six digits, a to d": re.compile(r"(?<![\w-])[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?![\w-])"),
    "eight digits and a letter": re.compile(r"(?<![\w-])\d{8}-?[A-Z](?![\w-])"),
    "x to z, seven digits and a letter": re.compile(r"(?<![\w-])[XYZ]-?\d{7}-?[A-Z](?![\w-])"),
    "3-2-4 digits": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
}
#: Digits, or letters and digits, of no published form: the collection decides on their shape.
WEAK_ID = re.compile(r"(?<![\w-])(?:\d{3} \d{2} \d{4}|\d{9}|\d{6}-\d{4}|[A-Z]{1,2} ?\d{7}|\d{11}|[A-Z]{1,6}-\d{5,9}(?:-[A-Z0-9]{1,4})?)(?![\w-])")
#: Words for numbers that are issued to one person, before such a number (fixed values, in lower case).
ID_LABEL = re.compile(
    r"(?:\bssn|social security|\bsoc\. ?sec|passport|national id|identity|\btax id|\btin|licen[cs]e|\bnino|\bni number|national insurance|\bdni|\bd\.n\.i|\bnie|\bnif|documento|pasaporte|\bid card|ausweis|steuer-?id"
    r"|sécurité sociale|passeport|permis|паспорт|инн|снилс)(?:[\w .,'’º°]{0,24})?[:=# ]{0,3}(?:is |was )?$",
    re.I,
)
#: Words for the other kinds (fixed values): ways to reach somebody, places to find them, forms of address.
CUES = {
    "email": re.compile(r"mail|write|contact|login|user|escrib|écri|schreib|пиш|почт|вопрос|anfragen|reported by", re.I),
    "phone": re.compile(r"\btel|phone|\bcall|\bring|\bfax|mobile|\btext|тел|llam|appel|ruf", re.I),
    "id_number": ID_LABEL,
    "address": re.compile(r"\blive|address|adres|dirección|domicil|deliver|resid|wohn|\bflat\b|\bapt|adresse|\bsent? to|адрес|visit|\baus der\b|\bdesk at", re.I),
    "name": re.compile(r"\b(?:mr|mrs|ms|miss|dr|prof|sir|don|doña|herrn?|frau|mme|mlle|m|sra?|señora?|signed|firmado|unterzeichnet|holder|contact|attn)\b[.:]? ?$|\bby $", re.I),
}

_NUM = r"\d{1,4}(?:[ ]?[A-Za-z]\b)?(?:[ ]?(?:bis|ter)\b)?"
_CAP = r"[^\W\d_a-zß-öø-ÿ][\w’'\-]*"
_EN_TYPE = r"(?:Lane|Road|Rd|Street|St|Close|Court|Ct|Terrace|Avenue|Ave|Crescent|Boulevard|Blvd|Drive|Way|Square|Row|Gardens|Place)"
_FR_TYPE = r"(?:rue|avenue|quai|place|boulevard|chemin|impasse|allée|cours|route|square|passage)"
_ES_TYPE = r"(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Camino|Ronda|Travesía)"
_OF = r"(?:(?:de la|de las|de los|de l['’]|del|de|du|des|aux|au|à la|d['’]) ?)"
ADDRESSES = [
    re.compile(rf"(?<![\w.,\-/])\d{{1,4}}[A-Za-z]?[ \xa0](?:(?:[NSEW]|St)\. )?(?:{_CAP}[ \xa0]){{1,3}}{_EN_TYPE}\b"),
    re.compile(rf"(?<![\w.,\-/])\d{{1,4}}[A-Z]?[ \xa0](?:(?:[NSEW]|ST)\. )?(?:[A-Z][A-Z'’\-]+[ \xa0]){{1,3}}{_EN_TYPE.upper()}\b"),
    re.compile(rf"(?<![\w.,\-/]){_NUM},? {_FR_TYPE} {_OF}?{_CAP}(?: {_OF}?{_CAP})*", re.U),
    re.compile(rf"(?<![\w]){_ES_TYPE} ?{_OF}?{_CAP}(?: {_OF}?{_CAP})*(?:, ?| nº ?|, nº ?| n\.º ?| )\d{{1,4}}[A-Za-z]?(?!\w)"),
    re.compile(r"(?<![\w])(?:[A-ZÄÖÜ][\w\-]*(?:straße|strasse|weg|gasse|platz|allee|ufer|damm|steig)|(?:[A-ZÄÖÜ]\w+ ){1,2}(?:Str\.|Straße|Weg|Gasse|Platz|Allee)) \d{1,4}[ ]?(?:[A-Za-z])?(?!\w)"),
]
#: What some of the patterns can't do without; the text is in lower case.
STREET_SIGNS = {
    2: ("rue ", "avenue ", "quai ", "place ", "boulevard ", "chemin ", "impasse ", "allée ", "cours ", "route ", "square ", "passage "),
    3: ("calle", "c/", "avda", "avenida", "plaza", "paseo", "camino", "ronda", "travesía"),
    4: ("straße", "strasse", "weg", "gasse", "platz", "allee", "ufer", "damm", "steig", "str."),
}
#: Weak: a German street named by a preposition, and a number before capitalised words of no known type.
_PREPOSITIONS = frozenset("An Am Au Un Hi Vo Zu Be Im In".split())
WEAK_ADDRESSES = [
    re.compile(r"(?:An|Am|Auf|Unter|Hinter|Vor|Zum|Zur|Bei|Beim|Im|In)(?: (?:den|der|dem|die))?(?: [A-ZÄÖÜ]\w+){1,2} \d{1,4}[A-Za-z]?(?!\w)"),
    re.compile(rf"(?<![\w.,\-/])\d{{1,3}}[A-Za-z]? {_CAP}(?: {_CAP}){{0,2}}"),
]

def _upper_class() -> str:
    """The upper-case letters as a character class, by rule."""
    codes = [i for i in range(0x10000) if chr(i).isupper()]
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


_UP = _upper_class()
_WORD = r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*"
_CAPITAL_WORD = rf"{_UP}[^\W\d_]*(?:[’'\-][^\W\d_]+)*"
_GAP = r"[ \xa0  ]{1,2}"
CAPITAL = re.compile(_CAPITAL_WORD)
#: What follows the first part of a name: the second, with initials between; or, behind a comma, the given name with initials.
NAME_REST = re.compile(rf"{_GAP}((?:[^\W\d_]\.{_GAP})*)({_CAPITAL_WORD})(?![\w@])")
NAME_BACK_REST = re.compile(rf", ?({_CAPITAL_WORD})((?:{_GAP}[^\W\d_]\.)*)(?![\w@])")
_NOT_BEFORE_NAME = frozenset("@#.-’'")
#: By rule, what a sign is: 1 a digit, 2 an upper-case letter of the patterns, 4 part of a word.
_SORT = np.array([chr(i).isdecimal() + 2 * (i < 0x10000 and chr(i).isupper()) + 4 * (chr(i).isalnum() or i == 95) for i in range(0x110000)], np.uint8)
_LOWER = frozenset("abcdefghijklmnopqrstuvwxyz")
_WITHIN_NUMBER = frozenset(" \xa0.-/()")
#: Forms of address are no parts of names (fixed values).
TITLES = frozenset("mr mrs ms miss dr prof sir don doña herr herrn frau mme mlle madame monsieur sr sra señor señora m".split())
_POSSESSIVE = re.compile(r"['’]s?$", re.I)
_CONTRACTED = re.compile(r"^\w['’][a-zß-ÿ]")
_FRAME_WORD = re.compile(r"[^\W_]+")
_AFTER = re.compile(r"[ \xa0]{0,2}([^\W\d_]+|\d|[^\w\s])?")


def _capital(word: str) -> bool:
    """Whether a word can be a part of a name: capitalised, and no contraction such as "I'm"."""
    return word[:1].isupper() and not _CONTRACTED.search(word)


def part_keys(word: str) -> list[str]:
    """What a part of a name is looked up by: itself and the halves of a double name, case aside."""
    low = word.casefold()
    return [low, *low.split("-")] if "-" in low else [low]


_OPENING, _CLOSING = frozenset("|\"'<([{=:;\t>"), frozenset("|\"'>)]};\t,<")


def frames(text: str, start: int, end: int) -> tuple[str, str, str | None]:
    """The frames of a span: the two words before it (one, if a sign ends it); the word before, if in the same sentence, with what follows; the signs that enclose it."""
    left = text[max(0, start - 40) : start]
    line = left.rpartition("\n")[2]
    words = _FRAME_WORD.findall(line)[-2:]
    if words:
        behind = line[line.rfind(words[-1]) + len(words[-1]) :]
        near = words[-1].casefold() + "".join(c for c in behind if c in '.:=,("')
        far = words[0].casefold() if len(words) > 1 else ""
        same = "^" if "." in behind or "?" in behind or "!" in behind else near
    else:
        near, far = ("^" if "\n" in left or not left else "?"), ""
        same = near
    m = _AFTER.match(text, end, end + 24)
    after = (m.group(1) or "") if m else ""
    a, b = text[max(0, start - 3) : start].rstrip(" \xa0")[-1:], text[end : end + 3].lstrip(" \xa0")[:1]
    return near if not near[-1].isalnum() else f"{far} {near}", f"{same}|{after.casefold()}", f"{a}…{b}" if a in _OPENING and b in _CLOSING else None


def _phones(text: str, windows: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    for x, y in windows:
        for m in _INTERNATIONAL.finditer(text, x, y):
            digits = m.group(1)
            code = next((c for n in (1, 2) if (c := digits[:n]) in _NATIONAL), digits[:2])
            least, most = _NATIONAL.get(code, (7, 12))
            have, end = len(digits) - len(code), m.end()
            groups = 0
            while have < most:
                g = _GROUP.match(text, end)
                if not g or have + len(g.group(1)) > most or (have >= least and groups >= 3):
                    break
                have, end, groups = have + len(g.group(1)), g.end(), groups + 1
            if least <= have <= most and not text[end : end + 1].isalnum():
                yield m.start(), end, "international"
        for name, pattern in PHONES.items():
            for m in pattern.finditer(text, x, y):
                yield m.start(), m.end(), name


def places(texts: list[str]) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """For each text, its runs of digits and where words begin with an upper-case letter; all texts at once."""
    sort = _SORT.take(np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.int32))
    begin = np.cumsum([1, *(len(x) + 1 for x in texts)])
    digit = (sort & 1).view(bool)
    change = np.flatnonzero(digit[1:] != digit[:-1]) + 1
    # A word begins where no letter, digit or underscore stands before.
    upper = np.flatnonzero((sort[1:] & 2 > 0) & (sort[:-1] & 4 == 0)) + 1
    at, to = (np.searchsorted(x, begin) for x in (change, upper))
    out = []
    for i, b in enumerate(begin[:-1].tolist()):
        edge = (change[at[i] : at[i + 1]] - b).tolist()
        out.append((list(zip(edge[::2], edge[1::2], strict=True)), (upper[to[i] : to[i + 1]] - b).tolist()))
    return out


def number_windows(runs: list[tuple[int, int]], text: str, least: int = 5, around: int = 14) -> list[tuple[int, int]]:
    """Where numbers of at least ``least`` digits stand, with what may belong to them on either side.

    ``runs`` are the runs of digits; those with only blanks and signs of numbers between count together.
    All numbers that the patterns for phones and identity numbers find have so many digits.
    """
    out: list[tuple[int, int]] = []
    a = b = n = 0
    for x, y in [*runs, (len(text) + 99, 0)]:
        if n and (x > len(text) or x - b > 4 or not _WITHIN_NUMBER.issuperset(text[b:x])):
            if n >= least:
                if out and a - around <= out[-1][1]:
                    out[-1] = (out[-1][0], b + around)
                else:
                    out.append((max(0, a - around), b + around))
            n = 0
        if not n:
            a = x
        b, n = y, n + y - x
    return out


#: The term that a word for the kind right before a candidate is; forms that begin with evidence.
LABELLED = "labelled"
PUBLISHED = ("email", "street with its type", "international", *PHONES, *IDS, LABELLED, "2 known parts")


def _shape(found: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", found))


def scan(text: str, gates: bool = True, where: tuple[list[tuple[int, int]], list[int]] | None = None) -> list[tuple]:
    """Candidates (start, end, kind, form, published, part 1, part 2, back) of one text; those of published forms don't overlap.

    Without ``gates`` every pattern is tried everywhere; the result is the same (see the tests).
    ``where`` is what :func:`places` found for the text.
    """
    out: dict[tuple, None] = {}
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y in taken)

    def take(a: int, b: int, kind: str, form: str) -> None:
        if free(a, b):
            out[a, b, kind, form, True, None, None, False] = None
            taken.append((a, b))

    low = text.lower()
    if not gates or any(x in low for x in EMAIL_SIGNS) or EMAIL_SPACED.search(low):
        for m in EMAIL.finditer(text):
            take(m.start(), m.end(), "email", "email")
    runs, starts = where or places([text])[0]
    # A house number: up to four digits with a blank, a comma or a letter behind them; streets of some patterns begin with a capital.
    houses, grand = [], []
    for x, y in runs:
        if y - x <= 4 and y < len(text):
            c = text[y]
            if c in " \xa0," or c.isalpha():
                houses.append(x)
                blank = y if c in " \xa0" else y + 1
                if text[blank : blank + 1] in (" ", "\xa0") and text[blank + 1 : blank + 2] not in _LOWER:
                    grand.append(x)
    if runs:
        for i, pattern in enumerate(ADDRESSES):
            signs = STREET_SIGNS.get(i)
            if not gates:
                found = pattern.finditer(text)
            elif signs is None:
                found = filter(None, (pattern.match(text, x) for x in grand))
            else:
                found = filter(None, (pattern.match(text, x) for x in (houses if i == 2 else starts))) if any(x in low for x in signs) else ()
            for m in found:
                take(m.start(), m.end(), "address", "street with its type")
        windows = number_windows(runs, text) if gates else [(0, len(text))]
        for name, pattern in (*IDS.items(), ("", WEAK_ID)) if windows else ():
            for x, y in windows:
                for m in pattern.finditer(text, x, y):
                    if ID_LABEL.search(text[max(0, m.start() - BEFORE) : m.start()].rpartition("\n")[2]):
                        take(m.start(), m.end(), "id_number", f"{name or _shape(m.group())}|{LABELLED}")
                    elif name:
                        take(m.start(), m.end(), "id_number", name)
        for a, b, form in sorted(_phones(text, windows), key=lambda x: (x[0], -x[1])) if windows else ():
            take(a, b, "phone", form)
        for pattern, kind in ((WEAK_PHONE, "phone"), (WEAK_ID, "id_number")) if windows else ():
            for x, y in windows:
                for m in pattern.finditer(text, x, y):
                    if free(m.start(), m.end()):
                        out[m.start(), m.end(), kind, _shape(m.group()), False, None, None, False] = None
    for start in starts:
        if start and text[start - 1] in _NOT_BEFORE_NAME:
            continue
        m = CAPITAL.match(text, start)
        at = m.end()
        if text[at : at + 1] not in (" ", "\xa0", "\u2009", "\u202f", ","):
            continue
        back = text[at] == ","
        rest = (NAME_BACK_REST if back else NAME_REST).match(text, at)
        if not rest:
            continue
        first = m.group()
        if first.casefold() in TITLES or not _capital(first):
            continue
        second, end = rest.group(1 if back else 2), rest.end()
        cut = _POSSESSIVE.search(second)
        if cut:
            end -= len(second) - cut.start() if not back or not rest.group(2) else 0
            second = second[: cut.start()]
        if not second or not _capital(second) or second.casefold() in TITLES or not free(start, end):
            continue
        g, f = (second, first) if back else (first, second)
        out[start, end, "name", "", False, g.casefold(), f.casefold(), back] = None
    if runs:
        # What has a weak form only yields to all others.
        for x in starts:
            if text[x : x + 2] not in _PREPOSITIONS:
                continue
            m = WEAK_ADDRESSES[0].match(text, x)
            if m and free(m.start(), m.end()):
                out[m.start(), m.end(), "address", "street with a preposition", False, None, None, False] = None
        for x in grand:
            m = WEAK_ADDRESSES[1].match(text, x)
            if m and free(m.start(), m.end()):
                out[m.start(), m.end(), "address", "number and capitals", False, None, None, False] = None
    return list(out)


CANDIDATES = "doc_id long, start int, end int, kind string, found string, form string, published boolean, beside boolean, given string, family string, back boolean, frame1 string, frame2 string, frame3 string, n long"


def _beside(text: str, spans: list[tuple]) -> list[bool]:
    """For each candidate, whether a word for its kind stands before it or a published form of another kind beside it."""
    firm = sorted((a, b, kind) for a, b, kind, _, published, *_ in spans if published)
    out = []
    for a, b, kind, *_ in spans:
        at = bisect_left(firm, (a,))
        near = firm[max(0, at - 2) : at + 3]
        other = any(k != kind and x < b + BESIDE and y > a - BESIDE and (y <= a or b <= x) for x, y, k in near)
        cue = CUES.get(kind)
        out.append(other or (cue is not None and cue.search(text[max(0, a - BEFORE) : a].rpartition("\n")[2]) is not None))
    return out


def candidates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the texts: candidates; rows of kind 'word' that count words per task, case aside; of kind 'signs', the signs of all texts, and of kind 'near', those near published forms."""
    word = re.compile(_WORD)
    columns = [c.split() for c in CANDIDATES.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def table(rows: list[tuple]) -> pa.RecordBatch:
        data = list(zip(*rows, strict=True)) if rows else [[] for _ in columns]
        return pa.RecordBatch.from_arrays([pa.array(d, types[t]) for d, (_, t) in zip(data, columns, strict=True)], names=[n for n, _ in columns])

    def counted(tokens: Counter[str]) -> pa.RecordBatch:
        words: Counter[str] = Counter()
        for token, n in tokens.items():
            for w in word.findall(token):
                words[w] += n
        return table([(None, None, None, "word", w, *[None] * 9, n) for w, n in words.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words never hold a blank, so blocks between blanks are counted, and cut into words once each.
        tokens: Counter[str] = Counter()
        for batch in batches:
            rows: list[tuple] = []
            signs = near = 0
            held = [(k, s) for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if s and k is not None]
            found = (w for at in range(0, len(held), 100) for w in places([s for _, s in held[at : at + 100]]))
            for (k, s), where in zip(held, found, strict=True):
                tokens.update(s.casefold().split())
                signs += len(s)
                spans = scan(s, where=where)
                if spans:
                    near += min(len(s), 2 * BESIDE * sum(x[4] for x in spans))
                    for (a, b, kind, form, published, g, f, back), beside in zip(spans, _beside(s, spans), strict=True):
                        rows.append((k, a, b, kind, s[a:b], form, published, beside, g, f, back, *frames(s, a, b), None))
                if len(rows) > 20_000:
                    yield table(rows)
                    rows = []
            yield table([*rows, (None, None, None, "signs", None, *[None] * 9, signs), (None, None, None, "near", None, *[None] * 9, near)])
            if len(tokens) > 200_000:
                yield counted(tokens)
                tokens.clear()
        yield counted(tokens)

    return documents.select(F.col(key).cast("long"), text).mapInArrow(run, CANDIDATES)


def name_parts(found: DataFrame, names: DataFrame) -> DataFrame:
    """(part, role): the listed parts and those that disclose a name.

    Evidence for a given name is a word that stands before a listed family name, without
    comma; for a family name, a word behind a listed given name. p is the share of the
    word's occurrences, in any case, with such evidence, bits its information against the share of
    all words. A word with a single partner isn't learned.
    """
    listed = names.select(F.lower("name").alias("part"), "role").dropna().distinct()
    words = found.filter("kind = 'word'").groupBy(F.col("found").alias("part")).agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n").alias("total"))
    straight = found.filter("kind = 'name' and not back").select("given", "family")
    known = lambda role, alias: listed.filter(F.col("role") == role).select(F.col("part").alias(alias))
    learned = None
    for part, other, role, other_role in (("given", "family", "given", "family"), ("family", "given", "family", "given")):
        # Words are counted first, so that a frequent one is one row in what follows.
        counts = straight.groupBy(part, other).agg(F.count(F.lit(1)).alias("c"))
        evidence = counts.join(known(other_role, other), other, "left_semi").groupBy(F.col(part).alias("part")).agg(F.sum("c").alias("e"), F.count(F.lit(1)).alias("partners"))
        base = evidence.agg(F.sum("e").alias("all"))
        scored = evidence.join(words, "part").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(base))
        p = F.least(F.lit(1.0), F.col("e") / F.col("n"))
        kept = scored.filter((p >= NAME_PART_P) & (F.col("partners") >= NAME_PART_PARTNERS) & (F.log2(p / (F.col("all") / F.col("total"))) >= NAME_PART_BITS)).select("part", F.lit(role).alias("role"))
        learned = kept if learned is None else learned.unionByName(kept)
    return listed.unionByName(learned).distinct()


def disclosing_forms(spans: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, form, n, p, bits): each form's occurrences, the probability that it reveals an item of its kind, and its information.

    p is the share of occurrences beside a word for the kind or a form of another kind, the
    prior included; bits compares it with the share of all signs that lie so near.
    """
    share = found.filter("kind in ('signs', 'near')").agg((F.sum(F.when(F.col("kind") == "near", F.col("n"))) / F.sum(F.when(F.col("kind") == "signs", F.col("n")))).alias("base"))
    base = F.least(F.lit(0.25), F.greatest(F.lit(0.01), F.coalesce("base", F.lit(0.01))))
    counted = spans.select("kind", F.explode(F.split("form", r"\|")).alias("form"), "beside").groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n"), F.count_if("beside").alias("e")).crossJoin(F.broadcast(share))
    published = F.col("form").isin(*PUBLISHED)
    p = (F.col("e") + F.lit(float(PRIOR)) * F.when(published, F.lit(1.0)).otherwise(base)) / (F.col("n") + F.lit(float(PRIOR)))
    return counted.select("kind", "form", "n", published.alias("published"), p.alias("p"), F.log2(p / base).alias("bits"))


def items(found: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, found) of the items among the candidates."""
    parts = written(name_parts(found, names), "parts")
    spans = found.filter("kind not in ('word', 'signs', 'near')").drop("n")
    has = {}
    for role in ("given", "family"):
        keys = parts.filter(F.col("role") == role).select("part")
        words = spans.filter("kind = 'name'").select(F.col(role).alias("w")).distinct()
        # A double name is known by any of its halves.
        has[role] = words.withColumn("part", F.explode(F.array_union(F.array("w"), F.split("w", "-")))).join(keys, "part", "left_semi").select(F.col("w").alias(role)).distinct().withColumn(f"is_{role}", F.lit(True))
    # A name of which no part is known must at least have words of its own: such as stand in names for a good share of their occurrences.
    words = found.filter("kind = 'word'").groupBy(F.col("found").alias("w")).agg(F.sum("n").alias("n"))
    inside = spans.filter("kind = 'name'").select(F.explode(F.array("given", "family")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    own = written(inside.join(words, "w").filter(F.col("c") >= F.lit(NAME_PART_P) * F.col("n")).select("w", F.lit(True).alias("own")), "own")
    named = spans.filter("kind = 'name'")
    for role in ("given", "family"):
        named = named.join(has[role].join(own.select(F.col("w").alias(role), F.col("own").alias(f"own_{role}")), role, "full_outer"), role, "left")
    # The form of a name is the number of its parts that disclose one.
    named = named.withColumn("own", F.coalesce(F.col("own_given") & F.col("own_family"), F.lit(False)))
    known = named.withColumn("parts", F.coalesce("is_given", F.lit(False)).cast("int") + F.coalesce("is_family", F.lit(False)).cast("int"))
    known = known.withColumn("form", F.concat("parts", F.lit(" known parts"))).withColumn("published", F.col("parts") == 2)
    # Behind a comma stands more than given names: what overlaps a known name in the other order isn't one. So with numbers before names.
    cells = F.explode(F.sequence(F.shiftright("start", CELL_BITS), F.shiftright("end", CELL_BITS)))
    forward = known.filter("not back and parts = 2").select(F.col("doc_id").alias("d"), F.col("start").alias("x"), F.col("end").alias("y"), cells.alias("c"))
    yields = (F.col("kind") == "name") & F.col("back") | (F.col("kind") == "address") & ~F.col("published")
    columns = ["doc_id", "start", "end", "kind", "found", "form", "published", "beside", "parts", "own", "frame1", "frame2", "frame3"]
    everything = known.select(*columns, "back").unionByName(spans.filter("kind <> 'name'").withColumn("parts", F.lit(0)).withColumn("own", F.lit(False)).select(*columns, "back"))
    everything = written(everything, "named")
    overlapping = everything.filter(yields).select("doc_id", "start", "end", "kind", cells.alias("cell")).join(forward, F.expr("doc_id = d and cell = c and start < y and x < end"), "left_semi").select("doc_id", "start", "end", "kind").distinct()
    kept = everything.filter(~yields).unionByName(everything.filter(yields).join(overlapping, ["doc_id", "start", "end", "kind"], "left_anti"))
    scored = written(kept.select(*columns), "scored")
    # Forms first; there are as many as the grammars have, so their table is sent to all tasks.
    forms = written(disclosing_forms(scored, found), "forms")
    sure = forms.filter((F.col("p") >= FORM_P) & (F.col("bits") >= FORM_BITS) & (F.col("published") | (F.col("p") >= FRAME_P))).select("kind", "form")
    some = lambda i, c: sure.select("kind", F.col("form").alias(c), F.lit(True).alias(f"sure{i}"))
    term = F.split("form", r"\|")
    scored = scored.withColumn("form1", F.get(term, F.lit(0))).withColumn("form2", F.get(term, F.lit(1))).join(F.broadcast(some(1, "form1")), ["kind", "form1"], "left").join(F.broadcast(some(2, "form2")), ["kind", "form2"], "left")
    scored = scored.withColumn("sure", F.coalesce("sure1", F.lit(False)) | F.coalesce("sure2", F.lit(False)))
    # Then frames: how strongly each reveals an item of the kind, over all candidates of the kind.
    each = F.explode(F.array_compact(F.array("frame1", "frame2", "frame3"))).alias("frame")
    framed = scored.select("kind", F.col("sure").cast("long").alias("s"), each)
    table = framed.groupBy("kind", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("e"))
    telling = table.filter(f"e / n >= {FRAME_P} and n >= {FRAME_SUPPORT}").select(F.concat_ws("\u0001", "kind", "frame").alias("frame"), "n", "e")
    size = max(1, scored.count())
    weak = scored.filter("not sure").select("doc_id", "start", "end", "kind", "found", "parts", "own", each).withColumn("frame", F.concat_ws("\u0001", "kind", "frame"))
    vouched = lookup_join(weak, telling, "frame", F.col("n") > F.lit(HOT_SHARE * size)).filter((F.col("kind") != "name") | (F.col("parts") > 0) | (F.col("own") & (F.col("e") >= BARE_FRAME_P * F.col("n")) & (F.col("n") >= BARE_FRAME_SUPPORT)))
    out = ["doc_id", "start", "end", "kind", "found"]
    return scored.filter("sure").select(*out).unionByName(vouched.select(*out)).distinct()


def personal_items(documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, kind, found): every personal item of every document, with its place.

    Null, empty and blank texts have none; null keys are left out; repeated rows give the
    same items once. ``names`` (name, role) may be empty and need not be complete.
    """
    return items(written(candidates(documents, key, text), "candidates"), names)


def replaced(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with a typed placeholder for each span; of overlapping spans the first and longest counts."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[kind]]
            at = b
    return "".join(out) + text[at:]


def sanitised(documents: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): all documents, the personal items replaced by placeholders."""
    spans = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    dirty = documents.select(F.col(key).cast("long").alias(key), text).join(spans, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replaced(t, [(s["start"], s["end"], s["kind"]) for s in sp or []]) for t, sp in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=[key, text])

    return dirty.mapInArrow(run, f"`{key}` long, `{text}` string")
