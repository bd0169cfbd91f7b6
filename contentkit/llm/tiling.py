"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item become word sequences (ASCII letters in lower case).  Items that share a seed, a run of
``seed`` words, with the document are tiled: the longest run of words that both still have unmarked is found by Karp-Rabin
hashes of all windows of a length, marked in both, and the search repeats down to the seed length.  The share of the item's words
that end up marked is its coverage; the order of the tiles does not matter, so reordered passages count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentkit.llm.storage import bounded_batches
from contentkit.llm.words import word_hashes

#: Bytes of benchmark text that one pass over the documents broadcasts; a larger benchmark takes more passes.
BLOCK_BYTES = 16 << 20
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_FILTER_BITS = 20


@dataclass(frozen=True)
class TilingRule:
    """*seed*: shortest tile in words (shorter items match as a whole); *coverage*: share of an item that makes a leak."""

    seed: int = 5
    coverage: float = 0.8


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Roller:
    """Karp-Rabin hashes of all windows of any length of one sequence."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(words) + 1)

    def windows(self, length: int) -> np.ndarray:
        n = len(self.words) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[length:] - self.sums[:n]) * self.back[:n]


def _free(marks: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows of *length* without a marked word."""
    sums = np.concatenate([[0], np.cumsum(marks)])
    return np.flatnonzero(sums[length:] == sums[:len(sums) - length]) if length < len(sums) else np.zeros(0, np.int64)


def tile(doc: np.ndarray, item: np.ndarray, seed: int) -> int:
    """Words of *item* covered by greedy tiles of at least *seed* words, longest first; ties by document, then item position."""
    a, b = Roller(doc), Roller(item)
    marks_a, marks_b = np.zeros(len(doc), bool), np.zeros(len(item), bool)

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Free document windows whose hash is also that of a free item window, and the item's windows."""
        at_b = _free(marks_b, length)
        hashes = b.windows(length)[at_b]
        at_a = _free(marks_a, length)
        return at_a[np.isin(a.windows(length)[at_a], hashes)], at_b, hashes

    longest = min(len(doc), len(item))
    while longest >= seed:
        # A common window of one length implies common windows of all smaller ones.
        low, high = seed - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        longest = low
        if longest < seed:
            break
        at_a, at_b, hashes = common(longest)
        places: dict[int, list[int]] = {}
        for q, h in zip(at_b.tolist()[::-1], hashes.tolist()[::-1]):
            places.setdefault(h, []).append(q)
        own = a.windows(longest)
        marked = False
        free_until = 0
        for p in at_a.tolist():
            if p < free_until:
                continue
            stack = places.get(int(own[p]))
            while stack:
                q = stack[-1]
                if marks_b[q:q + longest].any():
                    stack.pop()
                    continue
                if np.array_equal(doc[p:p + longest], item[q:q + longest]):
                    marks_a[p:p + longest] = marks_b[q:q + longest] = marked = True
                    free_until = p + longest
                stack.pop()
                break
            if not any(places.values()):
                break
        if not marked:
            longest -= 1
        if marks_b.all():
            break
    return int(marks_b.sum())


class BenchmarkIndex:
    """Word sequences of a bounded block of benchmark items, and their seeds as sorted arrays: about 30 bytes a word in all."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int):
        self.seed = seed
        self.keys, words = [], []
        for key, text in items:
            found = word_hashes(text)
            if len(found):
                self.keys.append(key)
                words.append(found)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.lengths = sorted({min(seed, len(w)) for w in words}, reverse=True)
        # Per window length: the different window hashes, ascending, and for each the run of (item, position) in the lists behind.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in self.lengths:
            own = [k for k, w in enumerate(words) if min(seed, len(w)) == length]
            hashes = np.concatenate([Roller(words[k]).windows(length) for k in own])
            item = np.repeat(np.array(own, np.int32), [len(words[k]) - length + 1 for k in own])
            place = np.concatenate([np.arange(len(words[k]) - length + 1, dtype=np.int32) for k in own])
            order = np.argsort(hashes, kind="stable")
            known, first = np.unique(hashes[order], return_index=True)
            self.seeds[length] = (known, np.append(first, len(order)).astype(np.int64), item[order], place[order])
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        for known, *_ in self.seeds.values():
            self.filter[known >> np.uint64(64 - _FILTER_BITS)] = True

    def _bounds(self, doc: np.ndarray) -> list[tuple[float, int, int, np.ndarray]]:
        """(most that can be covered as a share, item id, item, starts of shared seeds in the text) of the items that share a seed.

        Words of an item that lie in no seed of the text cannot be covered, so counting them gives a bound without tiling.
        """
        roller, out = Roller(doc), []
        for length, (known, first, item, place) in self.seeds.items():
            hashes = roller.windows(length)
            at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
            spot = np.searchsorted(known, hashes[at])
            hit = spot < len(known)
            hit[hit] = known[spot[hit]] == hashes[at][hit]
            at, spot = at[hit], spot[hit]
            if not len(at):
                continue
            # Each different seed of the text meets its (item, position) entries once, however often the text repeats it.
            different = np.unique(spot)
            entries = _runs(first[different], first[different + 1])
            order = np.lexsort((place[entries], item[entries]))
            owner, position = item[entries][order], place[entries][order].astype(np.int64)
            # A window adds what the one before it, of the same item, did not reach.
            step = np.full(len(owner), length)
            near = owner[1:] == owner[:-1]
            step[1:][near] = np.minimum(length, (position[1:] - position[:-1])[near])
            held = np.bincount(owner, step, minlength=len(self.sizes))
            out += [(held[k] / self.sizes[k], self.keys[k], k, at) for k in np.flatnonzero(held).tolist()]
        return out

    def _covered(self, doc: np.ndarray, k: int, at: np.ndarray) -> int:
        """Words of item *k* that tiling covers; *at*: where the text has seeds."""
        words = self.words[self.starts[k]:self.starts[k + 1]]
        length = min(self.seed, len(words))
        shared = np.isin(Roller(doc).windows(length)[at], Roller(words).windows(length))
        starts = at[shared]
        # Only words inside a seed can be tiled; a unique separator keeps runs of overlapping seeds apart.
        breaks = np.flatnonzero(np.diff(starts) > length)
        lows, highs = starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)] + length
        parts = [x for s, e in zip(lows.tolist(), highs.tolist()) for x in (doc[s:e], np.array([s * 2 + 1], np.uint64))]
        return tile(np.concatenate(parts), words, length)

    def judge(self, data: bytes | None, coverage: float, best: tuple[float, int | None] = (0.0, None)) -> tuple[int, float, int | None]:
        """Items covered by at least *coverage*, and the highest coverage with its item (the least id of equal ones), *best* included.

        Items go by what can be covered of them; when neither the rule nor the best so far can be reached any more, the rest is left.
        """
        doc, leaked = word_hashes(data), 0
        for bound, key, k, at in sorted(self._bounds(doc), key=lambda x: (-x[0], x[1])):
            beaten = best[1] is not None and (-bound, key) >= (-best[0], best[1])
            if bound < coverage and beaten:
                break
            share = self._covered(doc, k, at) / int(self.sizes[k])
            leaked += share >= coverage
            if share and (best[1] is None or (-share, key) < (-best[0], best[1])):
                best = (share, key)
        return leaked, *best

    def leaks(self, data: bytes | None, coverage: float) -> bool:
        """Whether some item is covered by at least *coverage*."""
        doc = word_hashes(data)
        return any(self._covered(doc, k, at) >= coverage * int(self.sizes[k]) for bound, _, k, at in self._bounds(doc) if bound >= coverage)


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All indexes of the half-open runs, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in blocks whose texts have at most about *block_bytes* each, by hash of the id; null ids and texts are left out."""
    items = benchmark.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(size) // block_bytes
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)]


def _broadcast_blocks(docs: DataFrame, benchmark: DataFrame, rule: TilingRule, item_col: str, item_text_col: str, block_bytes: int):
    bounded_batches(docs.sparkSession)
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        items = sorted((r.item, bytes(r.text)) for r in block.collect())
        yield docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(items, rule.seed))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rule: TilingRule = TilingRule(), text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_leaked (items whose coverage reaches the rule), best_item (highest coverage, then least id) and best_coverage.

    best_item and best_coverage are over all items that share a seed.  Documents without a common seed, with a null text or without
    words have 0, null and 0.0.  Repeated documents are judged each; an item id with several texts counts once for each different
    one.  Own columns with one of the added names are replaced.  Documents are never shuffled: a block of the benchmark, bounded in
    bytes, goes to all executors, and each block adds to the columns.
    """
    carried = [c for c in docs.columns if c not in ("n_leaked", "best_item", "best_coverage")]
    at = carried.index(text_col)
    out = docs.select(*[F.col(f"`{c}`") for c in carried], F.lit(0).cast("long").alias("n_leaked"),
                      F.lit(None).cast("long").alias("best_item"), F.lit(0.0).alias("best_coverage"))
    for index in _broadcast_blocks(docs, benchmark, rule, item_col, item_text_col, block_bytes):
        def judge(batches, index=index, width=len(carried), names=out.columns):
            for batch in batches:
                leaked, best, coverage = (batch.column(width + k).to_pylist() for k in range(3))
                for k, text in enumerate(batch.column(at).cast(pa.binary())):
                    more, coverage[k], best[k] = index.value.judge(text.as_py(), rule.coverage, (coverage[k], best[k]))
                    leaked[k] += more
                yield pa.RecordBatch.from_arrays([
                    *batch.columns[:width], pa.array(leaked, pa.int64()), pa.array(best, pa.int64()), pa.array(coverage, pa.float64())], names)

        out = out.mapInArrow(judge, out.schema)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rule: TilingRule = TilingRule(), text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a leaked item, with the columns of *docs*; null and empty texts stay, repeated rows are judged each.

    A document is passed on from block to block until one holds an item that it covers.
    """
    out, at = docs, docs.columns.index(text_col)
    for index in _broadcast_blocks(docs, benchmark, rule, item_col, item_text_col, block_bytes):
        def keep(batches, index=index):
            for batch in batches:
                clean = [not index.value.leaks(text.as_py(), rule.coverage) for text in batch.column(at).cast(pa.binary())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(keep, out.schema)
    return out
