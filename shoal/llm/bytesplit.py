"""Splitting texts for the byte-level vocabularies.

A blank between two characters that aren't white space always starts a new match of the public
pattern, and nothing before it matters to what follows. So a text is cut into *units* there: the
first as it stands, each later one with its blank in front. A unit's matches depend on it alone.
"""

from __future__ import annotations

import public_tokenizers
import regex

#: The printable letters that stand for bytes in vocabulary files: printable bytes for themselves, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}

PATTERN = public_tokenizers.PATTERN
#: White space of the pattern (Unicode's property), spelled out where Python's own notion differs.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NEAR_SPACE = regex.compile(f"[{_SPACE}] | [{_SPACE}]|^ | $")
_CUT = regex.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def units(text: str) -> list[str]:
    """The text's units without their leading blanks: every unit but the first has one."""
    if _NEAR_SPACE.search(text):
        return _CUT.split(text)
    return text.split(" ")
