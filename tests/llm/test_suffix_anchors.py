"""Anchors of windows must not depend on what else is in their slice."""

import random

import numpy as np

from tidemark.llm import suffix_dedup


def anchored(finder, data):
    """The anchor, as a place, of each window of one piece."""
    _, first, windows, offset, _ = finder.of(data, np.array([0]), np.array([len(data)]))
    return {int(f) + k: int(f) + int(o) for f, n, o in zip(first, windows, offset, strict=True) for k in range(int(n))}


def test_slices_of_any_size_have_the_same_anchors():
    """Few distinct grams of nearly equal hashes would be ordered by their places if bits were given up by the slice's size."""
    rnd = random.Random(1)
    finder = suffix_dedup.Anchors(400, buffer=1 << 16)
    text = bytes(rnd.choice(b"abcdefgh ") for _ in range(3_000))
    alone = anchored(finder, text)
    for before in (1, 500, 60_000):
        data = bytes(rnd.choice(b"xyz") for _ in range(before)) + text
        _, first, windows, offset, _ = finder.of(data, np.array([before]), np.array([len(text)]))
        assert {int(f) + k: int(f) + int(o) for f, n, o in zip(first, windows, offset, strict=True) for k in range(int(n))} == alone


def test_order_of_grams_ignores_the_slice():
    """The bits that a hash keeps are those of the buffer, not of the data."""
    finder = suffix_dedup.Anchors(400, buffer=1 << 16)
    seen = []
    finder._least = lambda x: seen.append(x) or suffix_dedup.Anchors._least(finder, x)
    text = bytes(random.Random(2).choice(b"abc") for _ in range(500))
    finder.of(text, np.array([0]), np.array([500]))
    finder.of(text + bytes(30_000), np.array([0]), np.array([500]))
    low = np.uint64((1 << (1 << 16).bit_length()) - 1)
    assert all(((x[:300] & low) == np.arange(300, dtype=np.uint64)).all() for x in seen)
    assert (seen[0][:300] == seen[1][:300]).all()
