"""Terms of a text: longest runs of letters and numbers, inner apostrophes kept."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The same rule three times: for the JVM, for Python's re and for DuckDB.
JVM_TERM = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
PY_TERM = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
SQL_TERM = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*"


def terms_col(text: Column) -> Column:
    """The lower-cased terms of a text in order; null and letterless texts give an empty array.

    Texts are cut into terms before they are lower-cased, as a lower-cased letter can
    consist of two signs. It stays in the JVM.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(JVM_TERM), F.lit(0))
    return F.transform(found, lambda t: F.lower(F.replace(t, F.lit("’"), F.lit("'"))))


def terms_of(text: str | None) -> list[str]:
    """The same in Python, for the Arrow operators."""
    if not text:
        return []
    if "İ" in text or "Σ" in text:
        # Lower-cased, one grows by a mark and the other depends on what stands beside it: cut first.
        return [t.replace("’", "'").lower() for t in PY_TERM.findall(text)]
    text = text.lower()
    return PY_TERM.findall(text.replace("’", "'") if "’" in text else text)
