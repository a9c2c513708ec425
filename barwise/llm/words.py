"""Words of a text in a form in which look-alike characters and scanning errors compare equal."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = str.maketrans(
    "авекмнорстухіјѕԁһԛԝ" + "αβεικνορτυχ" + "АВЕКМНОРСТУХІЈЅ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "ɡıſμßøłđ",
    "abekmhopctyxijsdhqw" + "abeikvoptux" + "abekmhopctyxijs" + "abezhikmnoptyx" + "gisubold",
)
_INVISIBLE = re.compile("[​-‏⁠-⁤﻿­]+")
_MARKS = re.compile("[̀-ͯ]+")
_PUNCTUATION = re.compile("[ -¿×÷ -⁞℀-⯿　-〿＀-／：-＠]+")
# Characters that scanning takes for one another are written as one of them.
SCAN = str.maketrans("015etuqih", "olscfnglb")

_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑¬][ \t]*\r?\n\s*(?=[^\W\d_])")
_SIGN = re.compile(r"\(\s*\d{1,4}[a-z]?\s*\)|\[\s*\d{1,4}\s*\]")
_DECIMAL = re.compile(r"(?<=[0-9])[.,](?=[0-9])")
_OTHER = re.compile(r"[^\w]|_")
# letters lower-cased, digits kept, everything else a blank
_ASCII = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(128))


def plain(text: str) -> str:
    """Lower-case words between blanks, without accents, invisible characters, look-alikes,
    line-end hyphens and reference signs; a decimal number is one word."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
        text = _PUNCTUATION.sub(" ", _BROKEN.sub("", text))
        if not text.isascii():
            text = text.translate(LOOK_ALIKE)
    elif "-\n" in text or "- \n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    if "(" in text or "[" in text:
        text = _SIGN.sub(" ", text)
    text = _DECIMAL.sub("", text)
    return text.translate(_ASCII) if text.isascii() else _OTHER.sub(" ", text.lower())


def words(text: str) -> list[str]:
    return plain(text).split()


def folded(word: str) -> str:
    """A word as one representative of all words that scanning may turn it into."""
    return word.replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("ii", "n").translate(SCAN)
