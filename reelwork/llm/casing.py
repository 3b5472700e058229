"""Case and kind of the characters of UTF-8 bytes, in any script, as masks and tables over the bytes."""

from __future__ import annotations

import unicodedata

import numpy as np

from reelwork.llm.kernel import LOWER

#: Code points up to the end of the plane of historic scripts; what lies beyond has no case and counts as a letter.
_MOST = 0x20000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its small form where that has as many bytes, and a mask of UPPER, SMALL, DIGIT and APART."""
    small, kind = np.arange(_MOST, dtype=np.int64), np.zeros(_MOST, np.uint8)
    for p in range(0x80, _MOST):
        if 0xD800 <= p < 0xE000:
            continue
        c = chr(p)
        category = unicodedata.category(c)
        if category in ("Lu", "Lt"):
            kind[p] = UPPER
            low = c.lower()
            if len(low) == 1 and len(low.encode()) == len(c.encode()):
                small[p] = ord(low)
        elif category == "Ll":
            kind[p] = SMALL
        elif category == "Nd":
            kind[p] = DIGIT
        elif category[0] in "PZSC" and category != "Cn":
            kind[p] = APART
    return small, kind


UPPER, SMALL, DIGIT, APART = 1, 2, 4, 8
_found: list[tuple[np.ndarray, np.ndarray]] = []


def cased(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in small letters, kind of the character that begins at each byte) of UTF-8 bytes.

    Kinds are UPPER, SMALL, DIGIT and APART (punctuation, symbols, white space); of the bytes that go on with a
    character, APART stands at all of them. A capital whose small form has another number of bytes stays as it is.
    """
    lower, kind = LOWER[data], np.zeros(len(data), np.uint8)
    kind[(data >= 65) & (data <= 90)] = UPPER
    kind[(data >= 97) & (data <= 122)] = SMALL
    kind[(data >= 48) & (data <= 57)] = DIGIT
    if len(data) and data.max() >= 0x80:
        if not _found:
            _found.append(_tables())
        small, kinds = _found[0]
        for size, low, high, bits in ((2, 0xC2, 0xDF, 0x1F), (3, 0xE0, 0xEF, 0x0F), (4, 0xF0, 0xF4, 0x07)):
            at = np.flatnonzero((data >= low) & (data <= high))
            at = at[at + size <= len(data)]
            if not len(at):
                continue
            point = (data[at] & bits).astype(np.int64)
            for k in range(1, size):
                point = (point << 6) | (data[at + k] & 0x3F)
            known = point < _MOST
            at, point = at[known], point[known]
            kind[at] = kinds[point]
            for k in range(1, size):
                kind[at + k] = kinds[point] & APART
            turned = small[point] != point
            at, to = at[turned], small[point[turned]]
            for k in range(size - 1, 0, -1):
                lower[at + k] = 0x80 | (to & 0x3F)
                to = to >> 6
            lower[at] = (data[at] & ~np.uint8(bits)) | to.astype(np.uint8)
    return lower, kind
