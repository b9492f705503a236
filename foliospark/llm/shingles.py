"""Word and shingle hashes of whole texts, by array operations over batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .wordbpe import SpanHash, mixed

WORDS = 5
RUN_CHARS = 1 << 20
GAP = re.compile("[\x20\x09-\x0d]")
_MULTIPLY = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1) for i in range(WORDS)]
_HASH = SpanHash()


def _words(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word; words are runs without white space, compared in lower case."""
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    gap = (chars == 0x20) | ((chars >= 0x09) & (chars <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    return _HASH(chars, edge[::2], edge[1::2]), edge[::2]


def _runs(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > RUN_CHARS and (cut := GAP.search(text, at + RUN_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in order, and the text of each."""
    hashes, owners, group, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], 0

    def flush() -> None:
        if group:
            h, at = _words("\n".join(t for _, t in group))
            start = np.cumsum([0] + [len(t) + 1 for _, t in group[:-1]])
            hashes.append(h)
            owners.append(np.array([k for k, _ in group])[np.searchsorted(start, at, "right") - 1] if len(at) else np.empty(0, np.int64))
            group.clear()

    for k, t in enumerate(texts):
        for run in _runs((t or "").lower()):
            group.append((k, run))
            size += len(run)
            if size >= RUN_CHARS:
                flush()
                size = 0
    flush()
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: the text, the hash and the count of each, in order of text and hash.

    A shingle is WORDS successive words; a text of fewer words has one shingle, of all its words.
    """
    h, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    begin = np.cumsum(n) - n
    left = (begin + n)[owner] - np.arange(len(h))  # words from here to the text's end
    for i in range(WORDS):
        total += np.where(left > i, padded[i : i + len(h)], np.uint64(0)) * _MULTIPLY[i]
    keep = (left >= WORDS) | ((n[owner] < WORDS) & (left == n[owner]))
    value, owner = mixed(total[keep] + np.minimum(left[keep], WORDS).astype(np.uint64)), owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], value[at], np.diff(np.append(at, len(value)))
