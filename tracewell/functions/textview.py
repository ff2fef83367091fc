"""The text as quotations are compared: one kind of space, quotation mark and dash, composed letters, no invisibles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

#: Characters without meaning to a comparison, and the quotation marks and dashes that are one each.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟«»″"
DASHES = "‐‑‒–—―−"

_FOLDED = {ord(c): to for group, to in ((SINGLE_QUOTES, "'"), (DOUBLE_QUOTES, '"'), (DASHES, "-")) for c in group}

_BLANK, _GAP = re.compile(r"\s"), re.compile(r"\s\s")


def unseen(c: str) -> bool:
    return c in INVISIBLE


def unprinted(c: str) -> bool:
    """Format characters of any kind, which boundaries look through."""
    return unicodedata.category(c) == "Cf"


def _belongs(cluster: str, c: str) -> bool:
    """Whether c is a mark on the cluster or composes with it."""
    if unicodedata.combining(c) or unicodedata.category(c).startswith("M"):
        return True
    if c.isascii():
        return False
    nfc = unicodedata.normalize
    return nfc("NFC", cluster + c) != nfc("NFC", cluster) + c


def view(text: str, drop: Callable[[str], bool] = unseen) -> tuple[str, list[int | None]]:
    """(the text as compared, where each offset of `text` and its end stand in it).

    An offset inside a letter with its marks has no place: None. Offsets in a run of white space stand at its space.
    """
    if text.isascii() and not _GAP.search(text) and drop in (unseen, unprinted):  # neither drops any of ASCII
        return _BLANK.sub(" ", text), list(range(len(text) + 1))
    return _walked(text, drop)


def _walked(text: str, drop: Callable[[str], bool]) -> tuple[str, list[int | None]]:
    shown: list[str] = []
    places: list[int | None] = []
    length = 0

    def put(piece: str, offsets: int, inner: bool) -> None:
        nonlocal length
        places.append(length)
        places.extend([None if inner else length] * (offsets - 1))
        shown.append(piece)
        length += len(piece)

    k, n = 0, len(text)
    while k < n:
        c, stop = text[k], k + 1
        if c.isspace():
            for j in range(k + 1, n):
                if text[j].isspace():
                    stop = j + 1
                elif not drop(text[j]):
                    break
            put(" ", stop - k, inner=False)
        elif drop(c):
            put("", 1, inner=False)
        else:
            while stop < n and not text[stop].isspace() and not drop(text[stop]) and _belongs(text[k:stop], text[stop]):
                stop += 1
            put(unicodedata.normalize("NFC", text[k:stop]).translate(_FOLDED), stop - k, inner=True)
        k = stop
    places.append(length)
    return "".join(shown), places


def normal(text: str) -> str:
    """The form in which two texts are the same quotation: the view, trimmed, without case. Compatibility characters stay."""
    if text.isascii():
        return " ".join(text.split()).casefold()
    return view(text)[0].strip().casefold()
