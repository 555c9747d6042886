"""Canonical order of the marks of Myanmar syllables, the one text function that needs Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The order of marks after a base letter.
MARK_ORDER = "ျြွှေိီဲုူါာံ့်း"
RANK = {c: k for k, c in enumerate(MARK_ORDER)}
MARKS = re.compile(f"[{MARK_ORDER}]{{2,}}")


def reorder(text: str | None) -> str | None:
    """NFC, then the marks after each base letter in canonical order, equal marks in their order; null stays null."""
    if text is None:
        return None
    return MARKS.sub(lambda m: "".join(sorted(m[0], key=RANK.__getitem__)), unicodedata.normalize("NFC", text))


@F.pandas_udf(T.StringType())
def reorder_marks(texts: pd.Series) -> pd.Series:
    return texts.map(reorder, na_action="ignore")
