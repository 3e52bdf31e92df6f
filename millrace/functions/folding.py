"""Accent folding table, generated from the Unicode rules of this Python version."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

ASCII_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def _stripped(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters to replace or delete, replacements, multi-character expansions).

    Only characters whose folded form matters for `[a-z0-9_]+` are listed: those that become
    such a character, expand to text with such a character, or vanish.
    """
    single_from, single_to, deleted, many = [], [], [], []
    for code in range(128, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if ch.lower() != ch:
            continue
        out = _stripped(ch)
        if out == ch:
            continue
        if out == "":
            deleted.append(ch)
        elif len(out) == 1 and out in ASCII_WORD:
            single_from.append(ch)
            single_to.append(out)
        elif ASCII_WORD & set(out):
            many.append((ch, out))
    return "".join(single_from + deleted), "".join(single_to), tuple(many)


def char_class(chars: list[str]) -> str:
    """Regex class of the characters, neighbours joined to ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"
