"""Text to search terms, as columns.

Two profiles: ``plain`` folds case canonically, cuts terms and drops stop words, and stays
in the JVM for ASCII texts; ``english`` also stems. Folding is NFC(casefold(NFD(text))),
for which the JVM has no function, so only texts with other signs pass through Arrow.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.porter2 import stem
from textloom.functions.text import JVM_TERM, PY_TERM

PROFILES = ("plain", "english")
#: English stop words, dropped before stemming (fixed values).
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)
_STOP = frozenset(STOP_WORDS)
_ASCII = r"^[\x00-\x7F]*$"


def fold(text: str) -> str:
    """Canonical caseless form, composed."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())


def analyze(text: str | None, profile: str = "plain") -> list[str]:
    """The terms of one text in Python: for queries, tests and the Arrow functions."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    terms = [t.replace("’", "'") for t in PY_TERM.findall(fold(text or ""))]
    kept = [t for t in terms if t not in _STOP]
    return [stem(t) for t in kept] if profile == "english" else kept


@F.pandas_udf(T.StringType())
def _fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(fold, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in lists:
        yield series.map(lambda terms: [stem(t) for t in terms], na_action="ignore")


def folded(text: Column) -> Column:
    """The folded text; rows of ASCII alone don't leave the JVM."""
    plain = text.rlike(_ASCII)
    return F.coalesce(_fold(F.when(~plain, text)), F.lower(text))


def terms(text: Column, profile: str = "plain") -> Column:
    """The terms of a text in order, stop words left out; of a null text none."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    found = F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(JVM_TERM), F.lit(0))
    found = F.transform(found, lambda t: F.replace(t, F.lit("’"), F.lit("'")))
    kept = F.filter(found, lambda t: ~t.isin(*STOP_WORDS))
    return _stems(kept) if profile == "english" else kept
