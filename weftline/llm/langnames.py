"""Language codes, tags and names in any language, resolved to two-letter codes.

The names come from the Java runtime's locale data by rule: every wanted language as displayed in every locale.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import SparkSession

#: Codes that some catalogues use beside ISO 639-2/T, and names that locale data doesn't hold. Fixed values.
EXTRA = {"fre": "fr", "ger": "de", "chi": "zh", "cmn": "zh", "arb": "ar", "mandarin": "zh", "castellano": "es", "castilian": "es", "ภาษาไทย": "th", "汉语": "zh", "普通话": "zh", "漢語": "zh", "عربي": "ar"}
_CACHE: dict[tuple[str, ...], dict[str, str]] = {}


def fold(name: str) -> str:
    """Lower case without accents on Latin letters and outer white space."""
    out = unicodedata.normalize("NFD", name.strip().lower())
    out = re.sub(r"(?<=[a-z])[̀-ͯ]+", "", out)
    return unicodedata.normalize("NFC", out)


def names(spark: SparkSession, codes: list[str]) -> dict[str, str]:
    """Folded name or code -> two-letter code. Its size is the codes times the runtime's languages: some thousands."""
    key = tuple(sorted(codes))
    if key not in _CACHE:
        locale = spark._jvm.java.util.Locale
        shown = {x.getLanguage(): x for x in locale.getAvailableLocales() if not x.getCountry() or x.getLanguage() in ("zh", "pt")}
        out: dict[str, str] = {}
        for code in key:
            own = locale.forLanguageTag(code)
            for where in shown.values():
                out.setdefault(fold(own.getDisplayLanguage(where)), code)
            out[code] = code
            out[own.getISO3Language()] = code
        _CACHE[key] = out | {fold(k): v for k, v in EXTRA.items() if v in key}
    return _CACHE[key]


def parse(value: str | None, table: dict[str, str]) -> list[str]:
    """The codes that a value names, in order: 'es-MX' -> es, 'Deutsch' -> de, 'es+fr' -> es, fr; none for 'und'."""
    if not value:
        return []
    whole = fold(value)
    if whole in table:
        return [table[whole]]
    found: list[str] = []
    for part in re.split(r"[+,;/|&、，]|\s+(?:and|y|e|et|und|и|و)\s+", whole):
        part = part.strip()
        tag = re.split(r"[-_]", part)[0]
        code = table.get(part) or (table.get(tag) if len(tag) <= 3 or "-" in part or "_" in part else None)
        if not code:
            code = next((table[w] for w in re.findall(r"[^\W_]+", part) if len(w) > 3 and w in table), None)
        if code and code not in found:
            found.append(code)
    return found
