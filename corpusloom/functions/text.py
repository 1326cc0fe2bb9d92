"""Text projections: joined texts, normal form, hashes, estimates and hosts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NON_WORD = r"[^\p{L}\p{N}_]+"
#: Beyond Latin letters, found fast; a character that NFC may change or join to the one before; all others (Latin, Cyrillic, usual punctuation, kana, CJK) stay as they are in any text.
BEYOND_LATIN = r"[^\x00-\x{2FF}]"
MAYBE_OPEN = r"[^\x00-\x{2FF}\x{400}-\x{482}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"


def classifier_text(title: Column, abstract: Column) -> Column:
    """Title and abstract on two lines, white space collapsed; null counts as empty."""
    both = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    return F.trim(F.regexp_replace(both, r"\s+", " "))


def pair_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed normal form; Spark has no built-in for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """NFC; Python gets a null in place of each text whose characters all stay as they are, so that its batches hold few texts."""
    other = F.when((F.length(text) != F.octet_length(text)) & text.rlike(BEYOND_LATIN) & text.rlike(MAYBE_OPEN), text)
    return F.coalesce(nfc(other), text)


def normal_form(text: Column, unicode: bool = True) -> Column:
    """NFC, lower case, everything but letters, digits and underscores to single spaces, trimmed."""
    source = composed(text) if unicode else text
    return F.trim(F.regexp_replace(F.lower(source), NON_WORD, " "))


def exact_key(text: Column, unicode: bool = True) -> Column:
    """Key of exact duplicates: half a SHA-256 of the normal form (classes agree with any other digest)."""
    return F.substring(F.sha2(normal_form(text, unicode), 256), 1, 32)


def token_estimate(chars: Column) -> Column:
    return chars / F.lit(4.0)


def host(url: Column) -> Column:
    """Lower-case network location, port included, of http URLs; null for others."""
    return F.when(F.lower(url).startswith("http"), F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), F.lit("")))


def short_id(oid: Column) -> Column:
    """Last path segment."""
    return F.element_at(F.split(oid, "/"), -1)


def seeded(seed: int, *keys: Column) -> Column:
    """Reproducible order value of keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
