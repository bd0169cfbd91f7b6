"""Greedy string tiling against a word-by-word version, on common seeds, and in bounded memory."""

import random
import sys
import time

import numpy as np
import pytest

from contentkit.llm import tiling
from contentkit.llm.words import word_hashes


def brute(doc, item, seed):
    """Longest run of words unmarked in both, again and again: ties by document, then item position."""
    marks_a, marks_b = [False] * len(doc), [False] * len(item)
    while True:
        best = (seed - 1, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not marks_a[p + n] and not marks_b[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < seed:
            return sum(marks_b)
        for k in range(n):
            marks_a[p + k] = marks_b[q + k] = True


@pytest.mark.parametrize("seed", range(6))
def test_documents_against_a_word_by_word_version(spark, docs_of, seed):
    rng = random.Random(seed)
    phrases = [" ".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(7)]
    text = lambda n: " ".join(rng.choice(phrases) if rng.random() < 0.6 else rng.choice("nopq") for _ in range(n))
    items = [(k, text(rng.randint(1, 4))) for k in range(12)] + [(3, text(2))]
    rows = [(k, text(rng.randint(0, 9))) for k in range(25)]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    rule = tiling.TilingRule(seed=5, coverage=0.8)
    want = {}
    for i, t in rows:
        shares = []
        for key, item in sorted(set(items)):
            a, b = t.split(), item.split()
            covered = brute(a, b, min(5, len(b)))
            if covered:
                shares.append((-covered / len(b), key))
        want[i] = (sum(-s >= 0.8 for s, _ in shares), min(shares)[1] if shares else None, -min(shares)[0] if shares else 0.0)
    for block in (1 << 20, 120):
        got = {r.doc_id: (r.n_leaked, r.best_item, r.best_coverage) for r in tiling.find_leaks(docs_of(rows), bench, rule, block_bytes=block).collect()}
        assert got == want
        kept = {r.doc_id for r in tiling.drop_leaks(docs_of(rows), bench, rule, block_bytes=block).collect()}
        assert kept == {i for i, w in want.items() if not w[0]}


def test_items_with_a_common_sentence_are_ruled_out_by_counting():
    prompt = "choose the right answer to the question that follows here "
    index = tiling.BenchmarkIndex([(k, (prompt + " ".join(f"q{k}x{j}" for j in range(20))).encode()) for k in range(20_000)], 5)
    rng = random.Random(1)
    doc = (" ".join(f"w{rng.randrange(5000)}" for _ in range(10_000)) + " " + prompt + " ".join(f"v{rng.randrange(5000)}" for _ in range(10_000))).encode()
    start = time.perf_counter()
    assert index.judge(doc, 0.8) == (0, 10 / 30, 0) and not index.leaks(doc, 0.8)
    assert time.perf_counter() - start < 3


def test_index_size():
    rng = random.Random(2)
    words = [f"word{k}" for k in range(30_000)]
    items = [(k, " ".join(rng.choices(words, k=60)).encode()) for k in range(9_000)]
    index = tiling.BenchmarkIndex(items, 5)
    held = sum(x.nbytes for seeds in index.seeds.values() for x in seeds) + index.words.nbytes + index.filter.nbytes + sys.getsizeof(index.keys)
    assert held / sum(len(t) for _, t in items) < 8 and len(index.words) == 9_000 * 60


def test_word_memory_is_bounded():
    from contentkit.llm import words
    for k in range(3):
        word_hashes(" ".join(f"{k}-{j}" for j in range(150_000)).encode())
    assert words._CACHE.held <= words.KNOWN_BYTES and len(words._CACHE) < words.KNOWN_BYTES / 200
    long = b"x" * 10_000
    assert word_hashes(long)[0] == word_hashes(long)[0] and long not in words._CACHE and np.array_equal(word_hashes(b"A b"), word_hashes(b"a B"))
