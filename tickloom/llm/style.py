"""Numbers that describe how a text is written, whatever it is about."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

NAMES = (
    "log_words", "word_length", "capitals", "digits", "marks", "symbols", "bars", "repeated_words", "top_word",
    "repeated_lines", "squeeze", "line_length", "marks_a_word", "odd_words",
)
_BYTES = np.arange(256)
_CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
_SMALL = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_WIDE = _BYTES >= 128
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_USUAL = np.isin(_BYTES, [ord(c) for c in ".,;:'\"-()"])
#: Bytes of a text that are compressed to see how it repeats itself; each block counts, so the text counts whole.
BLOCK = 4096


def style(text: bytes | None) -> np.ndarray:
    """One number for each of NAMES; shares are given by their square roots, so that small ones still tell."""
    if not text or text.isspace():
        return np.zeros(len(NAMES))
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    visible = max(1, int(b[~_SPACE].sum()))
    letters = max(1, int(b[_CAPITAL | _SMALL].sum()))
    other = ~(_CAPITAL | _SMALL | _DIGIT | _WIDE | _SPACE | _USUAL)
    count = Counter(words)
    odd = sum(n for w, n in count.items() if not w[-1:].isalnum() and w[-2:-1] and not w[-2:-1].isalnum() and w[-2] < 128 and w[-1] < 128)
    squeezed = sum(len(zlib.compress(text[k : k + BLOCK], 1)) for k in range(0, len(text), BLOCK))
    share = np.sqrt(
        [
            b[_CAPITAL].sum() / letters,
            b[_DIGIT].sum() / visible,
            b[ord("!")] / visible,
            b[other].sum() / visible,
            b[ord("|")] / visible,
            1 - len(count) / len(words),
            max(count.values()) / len(words),
            1 - len(set(lines)) / len(lines),
        ]
    )
    return np.concatenate(
        [
            [np.log1p(len(words)), np.log1p(visible / len(words))],
            share,
            [squeezed / len(text), np.log1p(len(words) / len(lines)), np.sqrt((b[_USUAL].sum()) / len(words)), np.sqrt(odd / len(words))],
        ]
    )
