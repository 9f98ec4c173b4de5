"""Arrow-backed functions for what column expressions cannot say."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.functions import fixed as X

_TRIGGER = re.compile(X.NUMBER_TRIGGER, re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


def spoken_numbers(text: str | None) -> list[str]:
    """Ten digits said in words within 200 characters after a trigger; a number stops at the first other word (SF-4)."""
    found: list[str] = []
    low = (text or "").lower()
    for start in (m.end() for m in _TRIGGER.finditer(low)):
        number = ""
        for word in _WORD.findall(low[start : start + 200]):
            digit = X.WORD_DIGITS.get(word)
            if digit is not None:
                number += digit
            elif number:
                break
        if len(number) == 10 and number[0] in "6789":
            found.append(number)
    return list(dict.fromkeys(found))


@F.pandas_udf(T.ArrayType(T.StringType()))
def word_form_phones(text: pd.Series) -> pd.Series:
    return text.map(spoken_numbers)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition (the part of SF-22 that Spark has no function for)."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def name_similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity of names without ``@ _ . -`` and digits (SF-33)."""
    a, b = (re.sub(r"[@_.\-\d]", "", (x or "").lower()) for x in (a, b))
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def username_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
