"""Text normalisation as JVM-side expressions (X1-X5, S1 strip).

The normaliser applies, in this order: clean_text (X1) -> pad CJK
ideographs (X2) -> strip accents (X3) -> optional lowercase.  Everything is
``regexp_replace`` / ``translate``; only characters whose canonical
decomposition yields several base characters (Hangul syllables and a few
dozen others) go through an Arrow-batched pandas UDF, and only for the rows
that contain one (other rows pass a null, which costs nothing).
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes (str.isspace):
# tab, LF, VT, FF, CR, FS, GS, RS, US, space, NEL, NBSP, OGHAM SPACE MARK,
# U+2000-U+200A, LINE SEPARATOR, PARAGRAPH SEPARATOR, NARROW NBSP,
# MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE.
PY_SPACE_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# Whitespace for clean_text - tab, LF, CR, category Zs, and the
# line / paragraph separators.
WS_CLASS = r"[\t\n\r\p{Zs}\x{2028}\x{2029}]"
# The same set without U+0020 (category Zs enumerated: U+00A0, U+1680,
# U+2000-U+200A, U+202F, U+205F, U+3000).
WS_NON_SPACE = r"[\t\n\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2028}\x{2029}]"
# Removed by clean_text - NUL, U+FFFD and every "other"
# category character (Cc, Cf, Co, Cn); tab/LF/CR were turned into spaces first.
DROP_CLASS = r"[\x{0}\x{FFFD}\p{C}]"

# A character other than printable ASCII and U+00A1-U+02FF without the soft
# hyphen (a format character): the others have no white space but U+0020,
# nothing that clean_text drops, no ideograph, no mark, and every decomposition
# has one base character.  One range per alternative: Java's negation of
# several ranges is ten times slower when many threads match.
NOT_LATIN = r"[^\x20-\x{2FF}]|[\x7F-\xA0]|\xAD"

# The CJK ideograph ranges padded with spaces.
CJK_CLASS = (r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
             r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]")

# Word tokens for the vocabulary (A19): runs of letters/digits, or any other
# single non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
# The same matches: the second choice only meets what the first one refused.
TOKEN_FIND = r"[\p{L}\p{N}]+|\S"


def strip_py(text: Column) -> Column:
    """Strip leading/trailing whitespace as Python's str.strip() does
    (plain ``trim`` removes only U+0020).  Only texts whose first or last
    character is in the class are searched."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(PY_SPACE_CLASS),
                  F.regexp_replace(text, f"^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$", "")).otherwise(text)


def _once(text: Column, step: Callable[[Column], Column]) -> Column:
    """``step(text)`` with ``text`` computed once, however often ``step`` names
    it: as the variable of a lambda over an array of one."""
    return F.get(F.transform(F.array(text), step), F.lit(0))


def _chain(text: Column, steps: Sequence[Callable[[Column], Column]]) -> Column:
    """The steps one after the other, each on the value of the one before; a
    step names its input several times, so plain nesting would compute the
    first one again for every way through the later ones."""
    for step in steps:
        text = _once(text, step)
    return text


def _guarded(text: Column, pattern: str, replacement: str) -> Column:
    """regexp_replace only on rows that contain a match: a find is cheaper
    than a replace (no copy), and most rows have nothing to replace."""
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, replacement)).otherwise(text)


def _clean_spaces(text: Column) -> Column:
    # the plain space maps to itself, so only the other ones trigger a replace
    return _guarded(text, WS_NON_SPACE, " ")


def _clean_dropped(text: Column) -> Column:
    return _guarded(text, DROP_CLASS, "")


def clean_text(text: Column) -> Column:
    """Whitespace -> one space each; drop NUL, U+FFFD, control/format."""
    return _chain(text, [_clean_spaces, _clean_dropped])


def pad_cjk(text: Column) -> Column:
    """A space on each side of every CJK ideograph."""
    return _guarded(text, CJK_CLASS, " $0 ")


@functools.lru_cache(maxsize=1)
def _accent_maps() -> tuple[str, str, str]:
    """Built by rule from ``unicodedata``: every character whose canonical
    decomposition minus non-spacing marks is exactly one other character
    (from, to), and the class of characters whose result has several
    characters (fallback)."""
    src, dst, multi = [], [], []
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        if unicodedata.category(c) == "Mn":
            continue
        d = unicodedata.normalize("NFD", c)
        s = "".join(ch for ch in d if unicodedata.category(ch) != "Mn")
        if s == c:
            continue
        if len(s) == 1:
            src.append(c)
            dst.append(s)
        else:
            multi.append(cp)
    ranges = []
    for cp in multi:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    cls = "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    return "".join(src), "".join(dst), cls


def _strip_accents_py(s):
    import pandas as pd

    def one(x):
        if x is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn")
    return pd.Series([one(x) for x in s])


_strip_udf = F.pandas_udf(_strip_accents_py, T.StringType())


def strip_accents(text: Column) -> Column:
    """Canonical decomposition, then drop non-spacing marks (Mn); no
    recomposition.  translate() covers one-to-one results, a regex drops
    marks already decomposed, and the rare rows with a multi-character
    decomposition go through the pandas UDF."""
    return F.coalesce(_strip_udf(_several(text)), _strip_single(text))


def _several(text: Column) -> Column:
    """The text if it has a character with a multi-character decomposition."""
    return F.when(text.rlike(_accent_maps()[2]), text)


def _strip_single(text: Column) -> Column:
    """X3 of a text without multi-character decompositions.  Cheap
    single-range tests skip the work for texts that cannot change: nothing
    below U+00C0 decomposes, and every Mn mark is at or above U+0300."""
    src, dst, _ = _accent_maps()
    base = F.translate(text, src, dst)
    return F.when(text.rlike(r"[^\x{0}-\x{BF}]"), F.when(
        text.rlike(r"[^\x{0}-\x{2FF}]"), F.regexp_replace(base, r"\p{Mn}", "")).otherwise(base)).otherwise(text)


def normalise_text(text: Column, lowercase: bool = False, strip: bool = True,
                   clean: bool = True, cjk: bool = True) -> Column:
    """X1 -> X2 -> X3 -> optional lowercase, in this order.  Printable
    ASCII passes all three unchanged, Latin letters (:data:`NOT_LATIN`) need
    translate() alone, other texts take every step once."""
    steps = [*([_clean_spaces, _clean_dropped] if clean else []), *([pad_cjk] if cjk else [])]
    latin, other = text, _chain(text, steps)
    if strip:
        src, dst, several = _accent_maps()
        latin = F.translate(text, src, dst)
        # the steps only remove characters or add spaces
        rare = F.when(text.rlike(NOT_LATIN) & text.rlike(several), _chain(text, [*steps, _several]))
        other = F.coalesce(_strip_udf(rare), _chain(text, [*steps, _strip_single]))
    t = F.when(text.rlike(NOT_LATIN), other).when(text.rlike(r"[^\x20-\x7E]"), latin).otherwise(text)
    if lowercase:
        t = F.lower(t)
    return t


def element_name(name: Column) -> Column:
    """Strip, drop every '%', then first character upper and the rest
    lower (not initcap, which capitalises every word)."""
    t = F.regexp_replace(strip_py(name), "%", "")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))


def word_tokens(text: Column) -> Column:
    """Word tokens of a normalised line."""
    return F.regexp_extract_all(text, F.lit(TOKEN_FIND), 0)
