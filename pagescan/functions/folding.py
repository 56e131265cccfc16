"""Case folding that keeps lengths, as matching without case sees it, so that offsets hold for the text itself."""

import re


def _simple(c: str) -> str:
    """The letter that matching without case takes ``c`` for: upper case, then lower case, of one character each."""
    if c == "İ":
        return "i"
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


def _table() -> dict[str, str]:
    letters = (chr(i) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000)
    return {c: _simple(c) for c in letters if c.lower() != c or c.upper() != c}


_FOLDED = _table()
#: Letters that ``str.lower`` does not fold as wanted; the Greek sigma depends on what stands behind.
_ODD = re.compile("[" + "".join(c for c, f in _FOLDED.items() if c.lower() != f or c == "Σ") + "]")
_MAP = {ord(c): f for c, f in _FOLDED.items()} | {i: chr(i + 32) for i in range(65, 91)}


def folded(text: str) -> str:
    """The text with every letter folded, character by character."""
    if text.isascii() or not _ODD.search(text):
        return text.lower()
    return text.translate(_MAP)


def caseless(c: str) -> bool:
    """Whether a character is the same in any case, or is an ASCII one, whose cases are plain."""
    return c.isascii() or (c.lower() == c == c.upper() and c not in _FOLDED)
