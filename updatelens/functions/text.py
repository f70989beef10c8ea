"""Text normalisation and tokens as column expressions."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from updatelens import constants as K

SPACE = r"[\s\p{Z}\x{85}]"
# Only these characters: lower-casing plus ss for sharp s is then all that compatibility
# normalisation and case folding do, so the text can stay in the JVM.
_PLAIN_TEXT = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ«»¡¿£§°–—‘’“”€]*$"
_PROTECTED = "\ue000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the planner copies the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column | str) -> Column:
    return _col(c).isNull() | (trim_ws(c) == "")


def collapse_ws(c: Column | str) -> Column:
    """Trim and squeeze every run of whitespace to one space."""
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def upper_invariant(c: Column | str) -> Column:
    """Upper case character by character: sharp s has no single upper-case form and stays."""
    return F.replace(
        F.upper(F.replace(_col(c), F.lit("ß"), F.lit(_PROTECTED))), F.lit(_PROTECTED), F.lit("ß")
    )


def clean_title(c: Column | str) -> Column:
    """Collapsed title; null when blank or longer than the limit."""
    t = collapse_ws(c)
    return F.when((t != "") & (F.char_length(t) <= K.TITLE_MAX), t)


def title_error(c: Column | str) -> Column:
    return let(
        collapse_ws(c),
        lambda t: F.when(F.coalesce(t, F.lit("")) == "", F.lit("title_missing")).when(
            F.char_length(t) > K.TITLE_MAX, F.lit("title_too_long")
        ),
    )


def normalize_title(c: Column | str) -> Column:
    return upper_invariant(clean_title(c))


def clean_optional(c: Column | str) -> Column:
    """Trimmed text, blank becomes null. Length is a separate check: ``too_long``."""
    t = trim_ws(c)
    return F.when(t != "", t)


def too_long(c: Column | str, limit: int) -> Column:
    return F.coalesce(F.char_length(trim_ws(c)) > limit, F.lit(False))


def _decode_one(match: re.Match) -> str:
    name = match.group(1)
    if not name.startswith("#"):
        code = 39 if name == "apos" else html.entities.name2codepoint.get(name)
    else:
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
            code = None
    return match.group(0) if code is None else chr(code)


_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def _decode_entities(values: pd.Series) -> pd.Series:
    return values.map(lambda v: _ENTITY.sub(_decode_one, v), na_action="ignore")


def decode_entities(c: Column | str) -> Column:
    """Character references to characters; text without ``&`` is not sent to Python."""
    c = _col(c)
    needs = c.contains("&")
    return F.coalesce(_decode_entities(F.when(needs, c)), c)


def strip_markup(c: Column | str) -> Column:
    """Drop tags. ``<`` opens a tag only before a letter, ``!``, ``?`` or ``/`` and a letter."""
    no_tags = F.regexp_replace(_col(c), r"<(?:[\p{L}!?]|/\p{L})[^>]*>?", "")
    return F.replace(no_tags, F.lit(">"), F.lit(""))


def bounded_text(c: Column | str, limit: int, decode: bool = True) -> Column:
    """Decode, strip tags, collapse and cut; a blank input is null."""
    c = _col(c)
    plain = decode_entities(c) if decode else c
    return F.when(~is_blank(c), F.substring(collapse_ws(strip_markup(plain)), 1, limit))


@F.pandas_udf(StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


def fold_text(c: Column | str) -> Column:
    """Compatibility-normalised, case-folded text. Only unusual characters are sent to Python."""
    c = _col(c)
    plain = c.rlike(_PLAIN_TEXT)
    native = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.coalesce(F.when(plain, native), _fold(F.when(~plain, c)))


def normalize_text(c: Column | str) -> Column:
    folded = F.regexp_replace(fold_text(c), r"[\s\p{Z}\x{85}\x1c-\x1f]+", " ")
    return F.trim(folded)


def tokens_of(folded: Column | str) -> Column:
    """Runs of letters and digits of already folded text."""
    return F.regexp_extract_all(_col(folded), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def tokenize(c: Column | str) -> Column:
    return tokens_of(fold_text(c))


def adjacent_pairs(tokens: Column | str) -> Column:
    """Neighbouring tokens joined by a space, in order."""
    t = _col(tokens)
    n = F.size(t)
    pairs = F.zip_with(
        F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def bigrams(c: Column | str) -> Column:
    return adjacent_pairs(tokenize(c))


def bound_content(*parts: Column | str, budget: int | None = K.CONTENT_BUDGET) -> Column:
    """The parts that are present, one per line, cut at ``budget`` when one is given."""
    joined = F.concat_ws("\n", *[_col(p) for p in parts])
    return joined if budget is None else F.substring(joined, 1, budget)


def clamp(c: Column | str, limit: int) -> Column:
    return F.substring(_col(c), 1, limit)


def clamp_trimmed(c: Column | str, limit: int) -> Column:
    return F.substring(trim_ws(c), 1, limit)


def normalize_name(c: Column | str) -> Column:
    """Trimmed upper-case name; null when blank or over the limit."""
    t = trim_ws(c)
    return F.when((t != "") & (F.char_length(t) <= K.NAME_MAX), upper_invariant(t))


def name_error(c: Column | str) -> Column:
    t = F.coalesce(trim_ws(c), F.lit(""))
    return F.when(t == "", F.lit("name_missing")).when(
        F.char_length(t) > K.NAME_MAX, F.lit("name_too_long")
    )
