"""Characters that look like others, and characters that cannot be seen.

Width forms, joined letters, kinds of space and ignorable characters follow
from the Unicode character database by rule; only letters of other alphabets
that look like Latin ones are listed.
"""

from __future__ import annotations

import unicodedata

#: Letters of other alphabets beside the Latin letters they look like.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "с": "c", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y",
    # Greek
    "ο": "o", "ν": "v", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
    # Armenian and others
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "ɡ": "g", "ɑ": "a", "ı": "i",
}

#: Letters beside a Latin letter they may also be read as, or look like in some faces only.
DOUBTFUL = {
    "Ι": "l", "І": "l", "Ӏ": "l", "ӏ": "I",
    "α": "a", "γ": "y", "η": "n", "ι": "i", "κ": "k", "к": "k", "ρ": "p", "τ": "t", "υ": "u", "ω": "w",
}

#: Format characters that do leave a mark on the page.
SEEN_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Characters without a mark that are no format characters.
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
HYPHENS = {0x2010, 0x2011, 0xFE63, 0xFF0D}
LINE_ENDS = {0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}


def fold_character(code: int) -> str:
    """What one (decomposed) character is written as in the common form."""
    c = chr(code)
    if code < 0x80:
        return c if code >= 32 and code != 127 else " " if c.isspace() else ""
    if code in UNSEEN:
        return ""
    kind = unicodedata.category(c)
    if kind == "Cf":
        return c if code in SEEN_FORMATS else ""
    if code in LINE_ENDS or kind == "Zs":
        return " "
    if kind == "Cc":
        return ""
    if code in HYPHENS:
        return "-"
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    how, _, parts = unicodedata.decomposition(c).partition(" ")
    if how in ("<wide>", "<narrow>"):
        return "".join(fold_character(int(x, 16)) for x in parts.split())
    if how == "<compat>" and kind in ("Ll", "Lu", "Lt"):
        plain = "".join(chr(int(x, 16)) for x in parts.split())
        if plain.isalpha():
            return "".join(fold_character(ord(x)) for x in plain)
    return c


class Folding(dict):
    """Table for ``str.translate`` that is filled as characters are met."""

    def __missing__(self, code: int) -> str:
        s = self[code] = fold_character(code)
        return s


FOLDING = Folding()


def fold(text: str) -> str:
    """``text`` in the common form: one character for all that read the same.

    Blanks and line ends become one space each run, outer ones go; nothing with
    a visible difference (wording, digits, case, accents) changes.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(FOLDING))
    elif not text.isprintable():
        text = text.translate(FOLDING)
    return " ".join(text.split())
