"""Hashes of all words of many texts at once, without a Python step per word."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_PART = 1 << 20
_POWERS: list[np.ndarray] = []

#: Byte classes that make up words: everything but white space, or letters, digits and bytes of other scripts.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (multiply and xor-shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _PART + (1 << 16))
        steps = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        for s in steps:
            s[0] = 1
        _POWERS[:] = [np.cumprod(s, dtype=np.uint64) for s in steps]
    return _POWERS[0], _POWERS[1]


def _hash_part(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a stretch of bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], is_word[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(raw) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * inverse[starts]), starts


def word_hashes(texts: list[bytes], is_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): 64-bit hashes of the words of all texts in order, and words per text.

    A word's hash depends on its bytes only (a polynomial over them, by differences of
    running sums). Texts are joined into stretches of about a megabyte; a longer text is
    cut between words, so memory follows the stretch and not the text.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    owners: list[int] = []

    def flush() -> None:
        if group:
            h, starts = _hash_part(b"\n".join(group), is_word)
            lengths = np.fromiter(map(len, group), np.int64, len(group)) + 1
            owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
            np.add.at(counts, np.asarray(owners)[owner], 1)
            hashes.append(h)
            group.clear()
            owners.clear()

    held = 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > _PART:
                end = at + _PART
                while end < len(text) and is_word[text[end]]:
                    end += 1
            group.append(text[at:end])
            owners.append(k)
            held += end - at
            if held >= _PART:
                flush()
                held = 0
            at = end
            if at >= len(text):
                break
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts
