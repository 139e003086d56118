"""Splitting patterns as the tokenizer libraries read them.

``regex`` knows a newer Unicode than the tokenizer libraries, which take the code
points below for neither letters nor numbers.  A text that holds one of them is split
by a pattern without them; any other text by the pattern as it is.  Lower-casing
and composition (NFC) of the ``tokenizers`` library differ from Python's as well.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

# Code points that are letters to the pattern engine, but unassigned in Unicode 16.
YOUNG_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3
16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5
1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
# The same for numbers.
YOUNG_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Capital letters that the tokenizers library lower-cases and Python's Unicode 15 does
# not, as ranges and what is added to a code point.
LATE_CAPITALS = """
1C89 1  A7CB -42343  A7CC 1  A7CE 1  A7D2 1  A7D4 1  A7DA 1  A7DC -42561  10D50-10D65 32  16EA0-16EB8 27
"""
# Code points that take part in composition for Python, and stand for themselves
# in the tokenizers library, whose tables of combining marks are older.
LATE_MARKS = """
07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27
10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 11938
1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F
1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF
"""


def code_points(ranges: str) -> list[tuple[int, int]]:
    """(first, last) of each range in a list of hexadecimal ranges."""
    return [(int(r.split("-")[0], 16), int(r.split("-")[-1], 16)) for r in ranges.split()]


def table(ranges: str) -> np.ndarray:
    """For each code point, whether it is in the ranges."""
    out = np.zeros(0x110000, dtype=bool)
    for a, b in code_points(ranges):
        out[a: b + 1] = True
    return out


def holds(text: str, marked: np.ndarray) -> bool:
    """Whether a code point of the text is marked in the table."""
    return not text.isascii() and bool(marked[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())


def _set(ranges: str) -> str:
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in code_points(ranges))


_late = LATE_CAPITALS.split()
LOWER = {c: c + int(step) for r, step in zip(_late[::2], _late[1::2])
         for a, b in code_points(r) for c in range(a, b + 1)}
_LOWER = table(" ".join(_late[::2]))
_MARKS = table(LATE_MARKS)
_MARK = regex.compile(f"([{_set(LATE_MARKS)}])")


def lower(text: str) -> str:
    """Each character in lower case by itself (no final sigma)."""
    if holds(text, _LOWER):
        text = text.translate(LOWER)
    return text.replace("Σ", "σ").lower()


def compose(text: str) -> str:
    """NFC by the library's tables."""
    if text.isascii():
        return text
    if not holds(text, _MARKS):
        return unicodedata.normalize("NFC", text)
    return "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(_MARK.split(text)))


_YOUNG = table(YOUNG_LETTERS) | table(YOUNG_NUMBERS)


class Splitter:
    """``findall`` of a pattern, with the letters and numbers of Unicode 16."""

    def __init__(self, pattern: str):
        self.plain = regex.compile(pattern)
        for name, young in (("L", YOUNG_LETTERS), ("N", YOUNG_NUMBERS)):
            pattern = pattern.replace(f"\\p{{{name}}}", f"[\\p{{{name}}}--[{_set(young)}]]")
        self.careful = regex.compile(pattern, regex.V1)

    def findall(self, text: str) -> list[str]:
        return (self.careful if holds(text, _YOUNG) else self.plain).findall(text)
