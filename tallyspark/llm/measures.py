"""Measurements of a whole text, taken in one pass over its bytes; shared by the quality operators."""

from __future__ import annotations

from collections import Counter

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bangs", "n_distinct", "n_chars_all")


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words that stand in a window of ``size`` words found twice or more in the text, first finds included."""
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found, n, free = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            n += i + size - max(i, free)
            free = i + size
    return n


def measure(text: str | None) -> tuple[int, ...]:
    """The ``FIELDS`` of a text; all zero for null."""
    if not text:
        return (0,) * len(FIELDS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    drop = lambda what: len(raw) - len(raw.translate(None, what))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words), len(text) - drop(SPACE), drop(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), drop(UPPER), drop(DIGITS), raw.count(b"!"), len(set(words)), len(text),
    )
