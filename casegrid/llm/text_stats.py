"""Rule statistics of a text: counts that quality rules, the forest and the site classifier share."""

from __future__ import annotations

import numpy as np

from casegrid.llm.common import window_hashes, word_hashes, words_of

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_adjacent")

_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows that occur at least twice."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(hashes) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    marks[starts] += 1
    marks[starts + width] -= 1
    return int((np.cumsum(marks[:-1]) > 0).sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """The values of ``COUNTS``; all 0 for null or empty text."""
    words = words_of(text)
    if not words:
        return (0,) * len(COUNTS)
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    hashes = word_hashes(words)
    return (
        len(words),
        len(joined.translate(None, _CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(hashes),
        len(joined.translate(None, _NOT_UPPER)),
        len(joined) - len(joined.translate(None, _MARKS)),
        len(lines),
        int((hashes[1:] == hashes[:-1]).sum()),
    )


#: Added to the denominators of shares, so that a few marks in a short text do not look like an anomaly.
SMOOTH_CHARS, SMOOTH_LINES, SMOOTH_WORDS = 200.0, 10.0, 40.0


def features(c: np.ndarray) -> np.ndarray:
    """Smoothed shares that do not depend on length, one row per document: what the forest and the classifier see."""
    n_words, chars, symbols, dup_lines, repeat, upper, marks, lines, adjacent = c.T.astype(np.float64)
    words, chars, lines = n_words + SMOOTH_WORDS, chars + SMOOTH_CHARS, lines + SMOOTH_LINES
    return np.stack([symbols / chars, dup_lines / lines, repeat / words, upper / chars, marks / chars, adjacent / words], axis=1)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words
