"""Splitting texts into the pieces that byte-pair merges never cross, and the byte alphabet of the vocabularies."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

# The code points with the property White_Space.
_WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CLITICS = "'(?:s|t|re|ve|m|ll|d)"


@functools.cache
def _classes() -> tuple[str, str, str]:
    """Letters, numbers and numbers that are no decimal digits, as the inside of a regular expression's character class."""
    runs: dict[str, list[list[int]]] = {"L": [], "N": [], "odd": []}
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        for name in (kind[0], "odd" if kind in ("Nl", "No") else ""):
            if name in runs:
                at = runs[name]
                if at and at[-1][1] == cp - 1:
                    at[-1][1] = cp
                else:
                    at.append([cp, cp])
    text = lambda ranges: "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return text(runs["L"]), text(runs["N"]), text(runs["odd"])


@functools.cache
def _word_patterns() -> tuple[re.Pattern[str], re.Pattern[str], re.Pattern[str]]:
    letter, number, odd = _classes()
    # Without odd numbers, the built-in word class is letters, decimal digits and the underscore.
    plain = re.compile(f"[^\\W\\d_]+|\\d|{_CLITICS}|(?:[^\\w{_WHITE}]|_)+")
    full = re.compile(f"[{letter}]+|[{number}]|{_CLITICS}|[^{_WHITE}{letter}{number}]+")
    return plain, full, re.compile(f"[{odd}]")


def words(text: str) -> list[str]:
    """Pieces of word vocabularies: white space is dropped, digits stand alone, clitics are cut off."""
    plain, full, odd = _word_patterns()
    return (full if not text.isascii() and odd.search(text) else plain).findall(text)


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
