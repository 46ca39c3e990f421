"""Text column functions: the simple tokeniser and its derived views.

A token is a run of letters/digits/marks, or one visible non-space
character.  Everything is ``regexp_extract_all`` plus array functions, so it
stays in the JVM.  ``length`` counts code points, as Python does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the token pattern (alphanumeric runs, else one non-space char)
ALPHA_NUM = r"[\p{L}\p{N}\p{M}]+"
NON_WS = r"[^\p{Z}\p{C}]"
TOKEN = f"{ALPHA_NUM}|{NON_WS}"
GAP = r"[\p{Z}\p{C}]*"
PIECE = f"(?:{TOKEN}){GAP}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(text) -> Column:
    """``ARRAY<STRING>`` of token texts in order."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN), 0)


def words(text, uncased: bool = False) -> Column:
    toks = tokenize(text)
    return F.transform(toks, lambda t: F.lower(t)) if uncased else toks


def token_count(text) -> Column:
    return F.size(tokenize(text))


def token_pieces(text) -> Column:
    """Token plus its trailing whitespace, in order (the ``text_ws`` of each token)."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(PIECE), 0)


def leading_gap(text) -> Column:
    return F.length(F.regexp_extract(F.coalesce(_c(text), F.lit("")), "^" + GAP, 0))


def passage_text(title, contents) -> Column:
    """Cross-encoder input: ``"{title}: {contents}"``."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(": "), F.coalesce(_c(contents), F.lit("")))


def jaccard(a, b) -> Column:
    """Set overlap of two string arrays: |A∩B| / |A∪B| (null when both are empty)."""
    da, db = F.array_distinct(_c(a)), F.array_distinct(_c(b))
    inter = F.size(F.array_intersect(da, db))
    union = F.size(da) + F.size(db) - inter
    return F.try_divide(inter.cast("double"), union.cast("double"))
