"""Text decoding and ASCII folding.

Unicode normalisation (NFKD) and byte decoding with replacement have no
built-in Spark expression, so these are small per-value Python helpers run
over Arrow batches; texts become Python strings a few at a time.  Everything around them (charset choice,
fast paths, the unmapped-character report, grouping) is native.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.functions.common import col_of

# ASCII substitutes applied after NFKD, in the source table's
# order (single characters only; the later of two entries for one character
# wins, as it would in the source table).
FOLD_TABLE = {
    "\u0300": '`',
    "\u0301": "'",
    "\u0302": '^',
    "\u0303": '~',
    "\u0304": '-',
    "\u0306": '^',
    "\u0308": 'e',
    "\u030a": '^',
    "\u030c": '^',
    "\u0327": ',',
    "\u0131": 'i',
    "\u03bc": '(u)',
    "\u200b": '',
    "\u2010": '-',
    "\u2013": '-',
    "\u2014": '--',
    "\u2015": '--',
    "\u2016": '||',
    "\u2018": '`',
    "\u2019": "'",
    "\u201a": ',',
    "\u201c": '"',
    "\u201d": '"',
    "\u201e": '"',
    "\u2020": '*',
    "\u2021": '*',
    "\u2022": '*',
    "\u2028": '_',
    "\u2032": "'",
    "\u2039": '&lt;',
    "\u203a": '&gt;',
    "\u2044": '/',
    "\u2190": '<-',
    "\u2191": '^',
    "\u2192": '-&gt;',
    "\u2193": 'v',
    "\u20ac": '(EUR)',
    "\u25cf": '*',
    "\ufeff": '',
    "\ufffd": "'",
    "\x85": '...',
    "\x92": "'",
    "\x93": '"',
    "\x94": '"',
    "\x96": '-',
    "\xa1": '!',
    "\xa2": '(c)',
    "\xa3": '(L)',
    "\xa5": '(Y)',
    "\xa7": '(sect)',
    "\xa8": ':',
    "\xa9": '-',
    "\xab": '<<',
    "\xad": '-',
    "\xae": '(R)',
    "\xb0": '^',
    "\xb1": '+/1',
    "\xb6": 'PP',
    "\xb7": '*',
    "\xbb": '>>',
    "\xbf": '?',
    "\xc6": 'ae',
    "\xd7": 'x',
    "\xd8": 'O/',
    "\xdf": 'ss',
    "\xf8": 'o/',
}


def escape_char(ch: str) -> str:
    """Backslash escape of one character: \\xNN, \\uNNNN or \\UNNNNNNNN."""
    n = ord(ch)
    if n < 0x100:
        return "\\x%02x" % n
    if n < 0x10000:
        return "\\u%04x" % n
    return "\\U%08x" % n


def fold_one(text: str | None) -> str | None:
    """C3 for one value: NFKD, ASCII kept, table substitutes, others escaped."""
    if text is None:
        return None
    out = []
    for ch in unicodedata.normalize("NFKD", text):
        if ch < "\x80":
            out.append(ch)
        elif ch in FOLD_TABLE:
            out.append(FOLD_TABLE[ch])
        else:
            out.append(escape_char(ch))
    return "".join(out)


#: Texts of an Arrow batch that are Python strings at the same time.
SLICE_ROWS = 64


def by_slices(fn, texts: pa.Array) -> pa.Array:
    """``fn`` of each text; a batch holds up to 64 MB, and only a slice of it is there as Python strings."""
    parts = [pa.array([None if t is None else fn(t) for t in texts.slice(k, SLICE_ROWS).to_pylist()], pa.string())
             for k in range(0, len(texts), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _fold(s: pa.Array) -> pa.Array:
    return by_slices(fold_one, s)


@F.arrow_udf(StringType())
def _nfkd(s: pa.Array) -> pa.Array:
    return by_slices(lambda t: unicodedata.normalize("NFKD", t), s)


def _beyond_ascii(udf, text) -> Column:
    """``udf`` of the texts with a character beyond ASCII; the others stay as they are and reach Python as nulls."""
    t = col_of(text)
    return F.coalesce(udf(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)


def fold_ascii(text) -> Column:
    """C3 ASCII folding (Arrow batches; ASCII text is its own folding)."""
    return _beyond_ascii(_fold, text)


def nfkd(text) -> Column:
    """NFKD normal form (Arrow batches; ASCII text is its own normal form)."""
    return _beyond_ascii(_nfkd, text)


def slugify(text) -> Column:
    """E13 in full: NFKD, non-ASCII dropped, then the ASCII slug rules."""
    from feedloom.operators.entries import slugify_ascii
    return slugify_ascii(F.regexp_replace(nfkd(text), r"[^\x00-\x7F]", ""))


def unmapped_class() -> str:
    """Java character class of characters the fold leaves escaped."""
    mapped = "".join("\\x{%x}" % ord(k) for k in FOLD_TABLE)
    return "[^\\x00-\\x7F" + mapped + "]"


def unmapped_chars(normalized, cls: str | None = None) -> tuple[Column, Column, Column]:
    """C4: for each unmapped character in NFKD text: (chars, before, after) arrays.

    One regex pass per value; each match takes the character with up to 15
    characters of context on each side (the left context stops at the
    previous match).  ``cls`` overrides the character class searched.
    """
    cls = cls or unmapped_class()
    pat = "(?s)(.{0,15}?)(" + cls + ")(?=(.{0,15}))"
    t = col_of(normalized)
    return (F.regexp_extract_all(t, F.lit(pat), F.lit(2)), F.regexp_extract_all(t, F.lit(pat), F.lit(1)),
            F.regexp_extract_all(t, F.lit(pat), F.lit(3)))


def decode_one(body: bytes | None, charset: str) -> str | None:
    """C2 for one value: decode with the charset; bad bytes become \\xNN escapes."""
    if body is None:
        return None
    try:
        return bytes(body).decode(charset or "utf-8", errors="backslashreplace")
    except LookupError:
        return bytes(body).decode("utf-8", errors="backslashreplace")


@F.pandas_udf(StringType())
def decode_bytes(body: pd.Series, charset: pd.Series) -> pd.Series:
    """C2 decoding (Arrow batches); only rows off the UTF-8 fast path reach it."""
    return pd.Series([decode_one(b, c) for b, c in zip(body, charset)], dtype=object)
