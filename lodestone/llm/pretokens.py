"""Byte-level BPE pre-tokens of many texts at once, by array operations on code points.

The rule is that of the vocabularies' pattern: contractions, then letters, digits or other characters with one
optional space before them, then white space, of which the last character before a word stays out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex

from lodestone.llm.common import slices

LETTER, NUMBER, OTHER, SPACE, BREAK = range(5)
#: The White_Space property.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point; made once in a process."""
    if not CLASSES:
        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        out[0xD800:0xE000] = OTHER
        out[WHITE] = SPACE
        CLASSES.append(out)
    return CLASSES[0]


def boundaries(text: str, breaks: np.ndarray) -> np.ndarray:
    """Sorted starts of the pre-tokens of ``text``; ``breaks`` are places of separators, each a token of its own."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    kind = classes()[points]
    kind[breaks] = BREAK
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[breaks] = True
    start[breaks + 1] = True
    # The last white space before a word is a token, or a space that belongs to the word.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # Contractions begin with an apostrophe that begins a token and is followed by a letter.
    mark = np.flatnonzero((points[:-1] == 39) & start[: n - 1] & (kind[1:] == LETTER) & (kind[:-1] == OTHER)) if n > 1 else np.zeros(0, np.int64)
    if len(mark):
        second = points[mark + 1]
        third = np.where(mark + 2 < n, points[np.minimum(mark + 2, n - 1)], 0)
        one = np.isin(second, [ord(c) for c in "stmd"])
        two = ((second == ord("r")) | (second == ord("v"))) & (third == ord("e")) | (second == ord("l")) & (third == ord("l"))
        start[mark[one | two] + 1] = False
        start[mark[one] + 2] = True
        start[mark[two & ~one] + 2] = False
        start[mark[two & ~one] + 3] = True
    return np.flatnonzero(start)


def pretokens(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """For slices of the texts: the first text's number, all pre-tokens of the slice, and how many each text has."""
    for a, b in slices([len(t) for t in texts], most):
        joined = "\0".join(texts[a:b]) + "\0"
        breaks = np.cumsum(np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a)) - 1
        starts = boundaries(joined, breaks)
        places = np.searchsorted(starts, breaks)  # of the separators among the tokens
        keep = np.ones(len(starts) - 1, bool)
        keep[places] = False
        tokens = [joined[i:j] for i, j in zip(starts[:-1][keep].tolist(), starts[1:][keep].tolist(), strict=True)]
        yield a, tokens, np.diff(places, prepend=-1) - 1


class Words(dict):
    """Numbers of distinct pre-tokens in order of appearance; ``new`` are those that have just been numbered."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new
