"""Words as runs of letters, over the code points of a batch of texts."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Script ranges (first code point; a script lasts to the next entry). Fixed values.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"),
    (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x31350, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: is it a letter, its lower-case form, its script."""
    n = 0x110000
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(n)), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for c in np.flatnonzero(letter[:0x1F000]).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    script = np.zeros(n, np.uint8)
    for (first, name), (last, _) in zip(SCRIPTS, [*SCRIPTS[1:], (n, "")], strict=True):
        script[first:last] = NAMES.index(name)
    return letter, lower, script


@dataclass
class LetterWords:
    letters: np.ndarray     # lower-case code points of all words, one after the other
    inside: np.ndarray      # of each letter: its place in its word
    first: np.ndarray       # of each word: its first letter
    lens: np.ndarray
    starts: np.ndarray      # code point at which it starts in its text
    scripts: np.ndarray     # script number of its first letter
    text_first: np.ndarray  # first word of each text (n + 1)


def letter_words(data: np.ndarray, offsets: np.ndarray) -> LetterWords:
    letter, lower, script = _tables()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = heads[offsets]  # in code points
    is_letter = letter[points]
    change = np.ones(len(points) + 1, bool)
    if len(points):
        np.not_equal(is_letter[1:], is_letter[:-1], out=change[1:-1])
        change[at] = True
    cut = np.flatnonzero(change)
    starts, ends = cut[:-1], cut[1:]
    keep = is_letter[starts]
    starts, ends = starts[keep], ends[keep]
    lens = ends - starts
    first = np.cumsum(lens) - lens
    letters = lower[points[is_letter]]
    text_first = np.searchsorted(starts, at)
    origin = np.repeat(at[:-1], np.diff(text_first))
    return LetterWords(letters, np.arange(len(letters)) - np.repeat(first, lens), first, lens, starts - origin,
                       script[points[starts]], text_first)
