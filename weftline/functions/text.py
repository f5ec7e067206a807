"""Text functions as columns: normal form, cleaning, tokens, clocks, previews, hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A token: a run of letters and digits (Unicode L and N) of the text in NFC and lower case.
TOKEN = r"([\p{L}\p{N}]+)"


#: What a text must hold for NFC to change it: marks, conjoining Hangul, and the characters that NFC replaces (with some that it
#: doesn't, so that the class stays short and quick). None stands before U+0300, which is looked at first.
UNSTABLE = (
    r"[\u0300-\x{10FFFF}&&[\p{M}\u0340-\u0387\u0958-\u095F\u09DC-\u09DF\u0A33-\u0A5E\u0B5C\u0B5D\u0F43-\u0FB9\u1100-\u11FF\u1F71-\u1FFD\u2000\u2001"
    r"\u2126\u212A\u212B\u2329\u232A\u2ADC\uF900-\uFB4F\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]]"
)


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Unicode NFC. Only texts that hold a character that NFC may touch go through Python."""
    return F.coalesce(_nfc(F.when(text.rlike(UNSTABLE), text)), text)


def lexical_tokens(text: Column, normalize: bool = True) -> Column:
    """The tokens of a text as an array; null for null."""
    return F.regexp_extract_all(F.lower(nfc(text) if normalize else text), F.lit(TOKEN), F.lit(1))


def token_count(text: Column, normalize: bool = True) -> Column:
    """The number of tokens; a null text has 0."""
    return F.coalesce(F.size(F.when(text.isNotNull(), lexical_tokens(text, normalize))), F.lit(0)).cast("int")


#: White space as Python's str.split sees it: Unicode white space and the separators 1C-1F.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none outside."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def clean_text(text: Column, normalize: bool = True) -> Column:
    """Without byte order marks, in NFC, white space collapsed and stripped."""
    bare = F.replace(text, F.lit("\ufeff"), F.lit(""))
    return collapse(nfc(bare) if normalize else bare)


def clean_label(label: Column, normalize: bool = True) -> Column:
    """A speaker label: cleaned, without a leading '>>', up to the first ' - '."""
    bare = F.trim(F.regexp_replace(clean_text(label, normalize), r"^>>\s*", ""))
    return F.trim(F.split_part(bare, F.lit(" - "), F.lit(1)))


def clock_seconds(clock: Column) -> Column:
    """'HH:MM:SS' as seconds; null where it isn't such a clock or minutes or seconds exceed 59. Hours may exceed 23."""
    ok = clock.rlike(r"^[0-9]{2}:[0-5][0-9]:[0-5][0-9]$")
    part = F.split(clock, ":")
    return F.when(ok, part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int"))


def preview(text: Column, limit: int) -> Column:
    """White space collapsed; longer texts are cut to limit characters that end with an ellipsis."""
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
