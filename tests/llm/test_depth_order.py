"""Sides of anchors are ordered from where the rows of their group begin to differ."""

import random

import numpy as np

from contentkit.llm import suffix_dedup as D


def test_strings_of_any_length_are_ordered():
    rng = random.Random(5)
    texts = sorted({bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randint(1, 30))) for _ in range(400)})
    shuffled = rng.sample(texts, len(texts))
    for block in (64, 1 << 16):
        ranks, common = D.depth_order(shuffled, block)
        assert [shuffled[k] for k in np.argsort(ranks)] == texts
        for k in range(1, len(texts)):
            a, b = texts[k - 1], texts[k]
            assert common[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_numbers_without_the_common_prefix(monkeypatch):
    rng = random.Random(6)
    group = np.sort(np.array([rng.randrange(40) for _ in range(200)]))
    prefix = {g: bytes(rng.choice(b"xyz") for _ in range(rng.choice([0, 20, 25]))) for g in set(group)}
    texts = [(prefix[g] + bytes(rng.choice(b"ab") for _ in range(30)))[:30] for g in group]
    rows = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, 30)
    common = np.array([next((i for i in range(30) if len({texts[j][i] for j in np.flatnonzero(group == g)}) > 1), 30) for g in group])
    symbols, whole = [], D.suffix_array
    monkeypatch.setattr(D, "suffix_array", lambda text: symbols.append(len(text)) or whole(text))
    numbers = D._numbers(rows, common)
    for a in range(200):
        for b in np.flatnonzero(group == group[a]).tolist():
            for d in range(31):
                assert (numbers[a, d] == numbers[b, d]) == (texts[a][:d] == texts[b][:d])
    assert sum(symbols) <= sum(31 - c for c in common) + len(symbols)


def test_numbers_without_what_follows_the_first_difference(monkeypatch):
    rng = random.Random(7)
    group = np.sort(np.array([rng.randrange(60) for _ in range(400)]))
    prefix = {g: bytes(rng.choice(b"xyz") for _ in range(rng.choice([0, 20, 29]))) for g in set(group)}
    texts = [(prefix[g] + bytes(rng.choice(b"\x00ab") for _ in range(rng.choice([1, 30]))) + b"\x00" * 30)[:30] for g in group]
    rows = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, 30)
    common = np.array([next((i for i in range(30) if len({texts[j][i] for j in np.flatnonzero(group == g)}) > 1), 30) for g in group])
    symbols, whole = [], D.suffix_array
    monkeypatch.setattr(D, "suffix_array", lambda text: symbols.append(len(text)) or whole(text))
    numbers = D._numbers(rows, common, group)
    for a in range(400):
        for b in np.flatnonzero(group == group[a]).tolist():
            for d in range(31):
                assert (numbers[a, d] == numbers[b, d]) == (texts[a][:d] == texts[b][:d])
    short = sum(symbols)
    symbols.clear()
    D._numbers(rows, common)
    assert 2 * short < sum(symbols)


def test_sides_of_two_documents_are_ordered_by_their_first_difference(monkeypatch):
    rng = random.Random(8)
    span, n = D.Span(), 200

    def side(k, d):
        return bytes([k % 7, 65 + d]) + bytes(rng.randrange(256) for _ in range(28))

    anchor, doc = (np.array(x, np.uint64) for x in zip(*[(k, d) for k in range(n) for d in range(2)]))
    sides = [b"".join(side(k, d) for k in range(n) for d in range(2)) for _ in range(2)]
    full = np.full(2 * n, 30, np.uint64)
    row = [0, *[D._pack(v, w) for v, w in ((anchor, 6), (doc, 8), (doc, 8), (doc + 100, 5), (doc * 0, 5), (full, 1), (full, 1))], *sides]
    symbols, whole = [], D.suffix_array
    monkeypatch.setattr(D, "suffix_array", lambda text: symbols.append(len(text)) or whole(text))
    assert D.resolve_sides(D._rows([row], D._SIDES), span, 1).num_rows == 0
    assert sum(symbols) <= 4 * 2 * 2 * n
