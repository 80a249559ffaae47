"""Text expressions: stripping, tokens, letter words, digit runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace, which are Unicode White_Space
# and the four separators U+001C to U+001F; first as ranges, then as the body of a
# regex class. \p{Z} covers all of them but the control characters.
WHITESPACE_RANGES = [
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
]
SPACE_CLASS = r"\p{Z}\x{9}-\x{D}\x{1C}-\x{1F}\x{85}"
# Fixed value: letters of a word, Latin lower case with accents.
LETTERS = "a-zá-ú"
# ---- end of fixed values

WHITESPACE = "".join(chr(c) for lo, hi in WHITESPACE_RANGES for c in range(lo, hi + 1))
TOKEN = f"[^{SPACE_CLASS}]+"

_WORD_CHAR = r"[\p{L}\p{N}_]"
# A word boundary over Unicode letters, digits and "_", spelled out because Java's
# own \b counts combining marks as part of a word.
_BOUNDARY = f"(?:(?<={_WORD_CHAR})(?!{_WORD_CHAR})|(?<!{_WORD_CHAR})(?={_WORD_CHAR}))"
LETTER_WORD = f"{_BOUNDARY}[{LETTERS}]+{_BOUNDARY}"
DIGITS = r"\p{Nd}+"


def strip(text: Column) -> Column:
    """cut whitespace, Unicode included, from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens of the lower-cased text."""
    return _all_matches(F.lower(text), TOKEN)


def letter_words(text: Column) -> Column:
    """Words made of letters only, lower-cased."""
    return _all_matches(F.lower(text), LETTER_WORD)


def digit_runs(text: Column) -> Column:
    """every run of digits."""
    return _all_matches(text, DIGITS)


def word_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(text, F.lit(TOKEN))


def preview(text: Column, characters: int = 200) -> Column:
    """the first characters of a text, for display."""
    return F.substring(text, 1, characters)
