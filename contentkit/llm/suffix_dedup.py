"""Removal of byte strings that occur in earlier documents, by suffix arrays over grouped contexts.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

1. Anchors: of all k-grams in a string of ``length`` bytes, the one with the least hash.  Equal strings have equal
   anchors, so a document is described by a few anchors per hundred bytes: hash, position, and a fingerprint of the context
   (all strings that hold the anchor).  They are packed and shuffled by hash.
2. An anchor whose context has the fingerprint of an earlier document is covered as a whole.  What remains are first
   documents of contexts that share an anchor with different contexts, at every position they have the context.  Positions
   less than a string apart are asked as one run: what an answer covers at each of them is one range of bytes.
3. Only for those, the bytes left and right of the anchor are fetched.  Per block, a suffix array of the different sides is built by
   linear grouping construction; its order and common prefixes number the sides by every depth, which tells for every
   string around the anchor whether an earlier document has it.

Documents are cogrouped by buckets sized by bytes, and only those that a step needs (a bounded bitmap filters the others).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.llm.storage import prefilter, stage

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 48) - 1)
#: A mixed value per byte, made by rule.
_BYTES = (np.arange(1, 257, dtype=np.uint64) * _M1 ^ (np.arange(1, 257, dtype=np.uint64) * _M2 >> np.uint64(23))) * _M2


@dataclass(frozen=True)
class Span:
    """*length* of the strings that count as repeated, and *gram*, the length of an anchor."""

    length: int = 50
    gram: int = 20

    @property
    def side(self) -> int:
        return self.length - self.gram


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of *text*, whose last symbol is its only least one.

    First suffixes are grouped by their longest Lyndon prefix: groups are taken in descending order; every suffix points to the
    nearest one before it in a lower group, and the suffixes pointed to leave their group for a new one just above it, those with
    more pointers higher.  Then one pass over the order itself places, for each suffix, the one before it and those
    its pointers lead to, each at the front of what is left of its group.  No symbols are renamed and nothing recurs.
    """
    n = len(text)
    sa = np.argsort(np.asarray(text), kind="stable").tolist()
    start, size, at, previous = [0] * n, [0] * n, [0] * n, [-1] * n
    first = 0
    for k, s in enumerate(sa):
        if text[s] != text[sa[first]]:
            first = k
        start[s] = first
        size[first] += 1
        at[s] = k
    high = n
    while high:
        low = start[sa[high - 1]]
        members = sa[low:high]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and start[p] >= low:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            classes = [list(pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, many in pointed.items():
                by_count.setdefault(many, []).append(p)
            classes = [by_count[c] for c in sorted(by_count, reverse=True)]
        for moving in classes:
            ends: dict[int, int] = {}
            for p in moving:
                g = start[p]
                end = ends.get(g)
                if end is None:
                    end = g + size[g]
                end -= 1
                ends[g] = end
                other, place = sa[end], at[p]
                sa[place], at[other] = other, place
                sa[end], at[p] = p, end
            for g, end in ends.items():
                whole = g + size[g]
                if end > g:
                    size[end], size[g] = whole - end, end - g
                    for k in range(end, whole):
                        start[sa[k]] = end
        high = low
    front = list(range(n))
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not placed[p]:
            g = start[p]
            out[front[g]] = p
            front[g] += 1
            placed[p] = 1
            p = previous[p]
    return out


def _windows(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of *length* bytes, combined from windows of powers of two."""
    n = len(data) - length + 1
    level, span, parts = _BYTES[data], 1, []
    while True:
        if length & span:
            parts.append((level, span))
        if span * 2 > length:
            break
        level = (level[:-span] * _M1) ^ (level[span:] * _M2 + np.uint64(span))
        level ^= level >> np.uint64(31)
        span *= 2
    out, offset = np.zeros(n, np.uint64), 0
    for level, span in parts:
        out = (out * _M1) ^ level[offset:offset + n]
        offset += span
    out ^= out >> np.uint64(29)
    out *= _M2
    return out ^ (out >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(data: bytes, span: Span) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, 48-bit hashes and 48-bit context fingerprints of the anchors of a text of at least *span.length* bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    hashes, width, side = _windows(raw, span.gram), span.side + 1, span.side
    least = _least(hashes, width)
    top = np.uint64(2**64 - 1)
    edge = np.full(width - 1, top)
    most = top - _least(top - np.concatenate([top - edge, least, top - edge]), width)
    at = np.flatnonzero(hashes == most)
    whole = side * 2 + span.gram
    context = _windows(np.concatenate([np.zeros(side, np.uint8), raw, np.zeros(side, np.uint8)]), whole)[at]
    before, after = np.minimum(at, side), np.minimum(len(raw) - at - span.gram, side)
    context ^= (before * (side + 1) + after).astype(np.uint64) * _M1
    return at, hashes[at] & _LOW, (context ^ (context >> np.uint64(40))) & _LOW


def _pack(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of unsigned values below 256 ** width."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view("<u8").reshape(-1)


def _column(table: pa.Table, name: str, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[_unpack(x.as_py(), width) for x in table.column(name)]])


def _bucket(ids: np.ndarray, count: int) -> np.ndarray:
    ids = ids.view(np.int64)
    return (ids ^ (ids >> 7) ^ (ids >> 17)) % count


def _bucket_column(column: Column, count: int) -> Column:
    return F.pmod(column.bitwiseXOR(F.shiftright(column, 7)).bitwiseXOR(F.shiftright(column, 17)), F.lit(count)).cast("int")


def runs(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, positions in their order) per distinct key, by one sort however many keys there are."""
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(key[order][1:] != key[order][:-1]) + 1
    for part in np.split(order, edges) if len(order) else ():
        yield int(key[part[0]]), part


def _split(key: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> list[list]:
    """Rows (key, packed columns) per distinct key, entries in their order."""
    return [[k, *[_pack(c[part], w) for c, w in columns]] for k, part in runs(key)]


def _rows(rows: list[list], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_ENTRIES = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("mark", pa.binary()), ("id", pa.binary()), ("text_key", pa.binary()), ("doc", pa.binary()), ("at", pa.binary())])
_ENTRIES_DDL = "bucket int, hash binary, mark binary, id binary, text_key binary, doc binary, at binary"
_FOUND = pa.schema([("bucket", pa.int32()), ("id", pa.binary()), ("text_key", pa.binary()), ("first", pa.binary()), ("last", pa.binary()),
                    ("hash", pa.binary()), ("ask", pa.bool_())])
_FOUND_DDL = "bucket int, id binary, text_key binary, first binary, last binary, hash binary, ask boolean"
_SIDES = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("id", pa.binary()), ("text_key", pa.binary()), ("at", pa.binary()),
                    ("reach", pa.binary()), ("before", pa.binary()), ("after", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])
_SIDES_DDL = "bucket int, hash binary, id binary, text_key binary, at binary, reach binary, before binary, after binary, left binary, right binary"


def _found(ids, keys, first, last, hashes, ask: bool, buckets: int) -> list[list]:
    rows = _split(_bucket(ids, buckets), [(ids, 8), (keys, 8), (first, 5), (last, 5), (hashes, 6)])
    return [[*row, ask] for row in rows]


def group_anchors(table: pa.Table, span: Span, buckets: int) -> pa.Table:
    """Of one hash bucket: anchors covered by equal contexts, and the ones to ask their documents about."""
    hashes, marks = _column(table, "hash", 6), _column(table, "mark", 6)
    ids, keys, at = [], [], []
    for row_ids, row_keys, row_doc, row_at in zip(*(table.column(c) for c in ("id", "text_key", "doc", "at"))):
        doc = _unpack(row_doc.as_py(), 4).astype(np.int64)
        ids.append(_unpack(row_ids.as_py(), 8)[doc])
        keys.append(_unpack(row_keys.as_py(), 8)[doc])
        at.append(_unpack(row_at.as_py(), 5))
    ids, keys, at = (np.concatenate(x) for x in (ids, keys, at))
    order = np.lexsort((at, keys, ids.view(np.int64), marks, hashes))
    hashes, marks, ids, keys, at = (x[order] for x in (hashes, marks, ids, keys, at))
    new_hash = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    new_mark = new_hash | np.concatenate([[True], marks[1:] != marks[:-1]])
    mark_start = np.flatnonzero(new_mark)[np.cumsum(new_mark) - 1]
    signed = ids.view(np.int64)
    covered = signed > signed[mark_start]
    # The first document of a context asks wherever it has it, if its anchor has other contexts of another document; other
    # documents of the same id are not covered by it and ask as well.
    hash_start = np.flatnonzero(new_hash)
    group = np.cumsum(new_hash) - 1
    marks_of = np.add.reduceat(new_mark.astype(np.int64), hash_start)[group]
    mixed = (np.maximum.reduceat(signed, hash_start) > np.minimum.reduceat(signed, hash_start))[group]
    asks = ~covered & (marks_of > 1) & mixed
    new_run = new_mark | np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (at[1:] - at[:-1] > np.uint64(span.length))])
    run_last = np.concatenate([new_run[1:], [True]])
    side = np.uint64(span.side)
    begin = np.where(at > side, at - side, np.uint64(0))
    end = at + np.uint64(span.length)
    rows = _found(ids[covered], keys[covered], begin[covered], end[covered], hashes[covered], False, buckets)
    first, last = asks & new_run, asks & run_last
    return _rows(rows + _found(ids[first], keys[first], at[first], at[last], hashes[first], True, buckets), _FOUND)


def depth_order(sides: list[bytes], block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every distinct string, and its common prefix with the string of the rank before it; a prefix of another comes before it.

    Strings come from one suffix array per block of about *block* bytes; strings are put into blocks by their
    first bytes, so that ranks of blocks follow each other.
    """
    sizes = np.fromiter(map(len, sides), np.int64, len(sides))
    heads = sorted(range(len(sides)), key=lambda k: sides[k][:4])
    ends = np.cumsum(sizes[heads] + 1)
    ranks = np.zeros(len(sides), np.int64)
    begin, done = 0, 0
    while begin < len(heads):
        held = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, held + block, "right")))
        while end < len(heads) and sides[heads[end]][:4] == sides[heads[end - 1]][:4]:
            end += 1
        part = np.asarray(heads[begin:end])
        size = sizes[part] + 1
        starts = np.cumsum(size) - size
        text = np.zeros(int(size.sum()) + 1, np.int64)
        letters = np.ones(len(text) - 1, bool)
        letters[starts + size - 1] = False
        text[:-1][letters] = np.frombuffer(b"".join(sides[k] for k in part), np.uint8).astype(np.int64) + 2
        text[starts + size - 1] = 1
        which = np.full(len(text), -1)
        which[starts] = part
        found = which[np.asarray(suffix_array(text.tolist()))]
        ranks[found[found >= 0]] = done + np.arange(len(part))
        done += len(part)
        begin = end
    # Beyond its end a string has a symbol that no byte equals.
    rows = np.full((len(sides), int(sizes.max())), -1, np.int16)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(sides), np.uint8)
    order = np.argsort(ranks)
    rows, sizes = rows[order], sizes[order]
    same = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    return ranks, np.concatenate([[0], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))]).astype(np.int64)


def _distinct(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of one row of every different (group, bytes), and which of them each row equals."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, :rows.shape[1]] = rows
    words = padded.view(np.uint64).T
    order = np.lexsort((*words, group))
    new = np.ones(len(rows), bool)
    new[1:] = np.logical_or.reduce([key[order][1:] != key[order][:-1] for key in (*words, group)])
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _told(rows: np.ndarray, common: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Per row a depth at which no other text of its group has the same prefix, or the width; found in steps that double from *common*."""
    width, reach = rows.shape[1], 1
    texts, text = _distinct(group, rows)
    depth, todo = np.full(len(texts), width), np.arange(len(texts))
    while reach < width and len(todo):
        at = texts[todo]
        end = np.minimum(common[at] + reach, width)
        part = rows[at[:, None], np.minimum(common[at][:, None] + np.arange(reach), width - 1)]
        which = _distinct(group[at], part)[1]
        alone = np.bincount(which)[which] == 1
        depth[todo[alone]] = end[alone]
        todo, reach = todo[~alone], reach * 2
    return depth[text]


def _numbers(rows: np.ndarray, common: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """For every row and depth, a number that equal prefixes of that depth share within a group; rows whose group has all in *common* stay 0.

    *common* is the prefix that all rows of the group have, which decides nothing, and with *group* known, nor do the bytes
    beyond a depth at which a text differs from all others of its group: only those between are ordered.
    """
    width = rows.shape[1]
    out = np.zeros((len(rows), width + 1), np.int64)
    texts: dict[bytes, int] = {}
    where = np.flatnonzero(common < width)
    ends = np.full(len(where), width) if group is None else _told(rows[where], common[where], group[where])
    which = [texts.setdefault(rows[k, common[k]:end].tobytes(), len(texts)) for k, end in zip(where.tolist(), ends.tolist())]
    if texts:
        ranks, shared = depth_order(list(texts))
        classes = np.cumsum(shared[:, None] < np.arange(width + 1)[None, :], axis=0)
        depth = np.maximum(np.arange(width + 1)[None, :] - common[where][:, None], 0)
        out[where] = classes[ranks[np.asarray(which)][:, None], depth]
    return out


def _classes(*parts: np.ndarray) -> np.ndarray:
    """One number per combination of the non-negative *parts*."""
    out = parts[0]
    for part in parts[1:]:
        many = int(part.max()) + 1
        if (int(out.max()) + 1) * many >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
        out = out * many + part
    return out


def resolve_sides(table: pa.Table, span: Span, buckets: int) -> pa.Table:
    """Of one hash bucket: strings around the anchors that an earlier document has too, as byte ranges."""
    side = span.side
    hashes, ids, keys, at, reach = (_column(table, c, w) for c, w in (("hash", 6), ("id", 8), ("text_key", 8), ("at", 5), ("reach", 5)))
    before, after = (_column(table, c, 1).astype(np.int64) for c in ("before", "after"))
    left, right = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), np.uint8).reshape(-1, side) for c in ("left", "right"))
    order = np.lexsort((ids.view(np.int64), hashes))
    hashes, ids, keys, at, reach, before, after, left, right = (x[order] for x in (hashes, ids, keys, at, reach, before, after, left, right))
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    signed = ids.view(np.int64)

    def common(rows: np.ndarray) -> np.ndarray:
        same = np.logical_and.reduceat(rows == rows[starts[group]], starts)
        return np.cumprod(same, axis=1).sum(axis=1)[group]

    lefts, rights = _numbers(left, common(left), group), _numbers(right, common(right), group)
    covered = np.zeros((len(hashes), side + 1), bool)
    for o in range(side + 1):
        # The string with o bytes before the anchor; rows are sorted by id within a group, so the first of a class is the least.
        fits = np.flatnonzero((before >= o) & (after >= side - o))
        if not len(fits):
            continue
        # Rows come sorted by group and id, so a stable sort by class leaves the least id of a class first.
        classes = _classes(group[fits], lefts[fits, o], rights[fits, side - o])
        by = np.argsort(classes, kind="stable")
        head = np.concatenate([[True], classes[by][1:] != classes[by][:-1]])
        least = signed[fits][by][np.flatnonzero(head)[np.cumsum(head) - 1]]
        covered[fits[by], o] = signed[fits][by] > least
    # Runs of consecutive strings become one range of bytes, up to the last position that was asked with this one.
    padded = np.concatenate([np.zeros((len(hashes), 1), bool), covered, np.zeros((len(hashes), 1), bool)], axis=1).astype(np.int8)
    row_a, first_o = np.nonzero(np.diff(padded, axis=1) == 1)
    _, after_o = np.nonzero(np.diff(padded, axis=1) == -1)
    begin = at[row_a] - (after_o - 1).astype(np.uint64)
    end = at[row_a] + reach[row_a] - first_o.astype(np.uint64) + np.uint64(span.length)
    return _rows(_found(ids[row_a], keys[row_a], begin, end, hashes[row_a], False, buckets), _FOUND)


def merge_ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of byte ranges."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(first) - 1]])]


def _by_document(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Entries of a bucket per (id, text key)."""
    if not table.num_rows:
        return {}
    ids, keys = _column(table, "id", 8), _column(table, "text_key", 8)
    order = np.lexsort((keys, ids))
    edge = np.flatnonzero(np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])]))
    return {(int(ids[part[0]]), int(keys[part[0]])): part for part in np.split(order, edge[1:])}


def remove_repeats(docs: DataFrame, span: Span = Span(), id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20) -> DataFrame:
    """(id, text, n_bytes, n_removed, n_spans, kept) per row; text and kept are binary.

    Null texts are empty.  Rows with a null id come before and after nothing: they stay whole and remove nothing.  Rows of one id are
    judged each by itself against smaller ids.  Ids are longs; other columns of *docs* are not looked at.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + int(total) // bucket_bytes
    keyed = named.filter("id IS NOT NULL").select(
        "id", F.xxhash64("text").alias("text_key"), "text", _bucket_column(F.col("id"), buckets).alias("bucket"))

    def describe(batches):
        for batch in batches:
            ids, keys, at, hashes, marks, docs_of = [], [], [], [], [], []
            for k, (doc, key, text) in enumerate(zip(*batch.columns[:3])):
                ids.append(doc.as_py())
                keys.append(key.as_py())
                data = text.as_py()
                if len(data) >= span.length:
                    a, h, m = anchors(data, span)
                    at.append(a)
                    hashes.append(h)
                    marks.append(m)
                    docs_of.append(np.full(len(a), k))
            if not at:
                continue
            ids, keys = np.array(ids, np.int64).view(np.uint64), np.array(keys, np.int64).view(np.uint64)
            at, hashes, marks, docs_of = (np.concatenate(x) for x in (at, hashes, marks, docs_of))
            rows = []
            for bucket, part in runs((hashes % np.uint64(buckets)).astype(np.int64)):
                seen, local = np.unique(docs_of[part], return_inverse=True)
                rows.append([bucket, _pack(hashes[part], 6), _pack(marks[part], 6), _pack(ids[seen], 8), _pack(keys[seen], 8),
                             _pack(local.astype(np.uint64), 4), _pack(at[part].astype(np.uint64), 5)])
            yield from _rows(rows, _ENTRIES).to_batches()

    entries = keyed.select("id", "text_key", "text").mapInArrow(describe, _ENTRIES_DDL)
    found = stage(entries.groupBy("bucket").applyInArrow(lambda table: group_anchors(table, span, buckets), _FOUND_DDL), "anchors")
    asked = found.filter("ask")

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = _by_document(right)
        if not wanted or not left.num_rows:
            return _rows([], _SIDES)
        first, last, hashes = (_column(right, c, w) for c, w in (("first", 5), ("last", 5), ("hash", 6)))
        side, held = span.side, {k: [] for k in ("hash", "id", "key", "at", "reach", "before", "after", "left", "right")}
        for doc, key, text in zip(*(left.column(c) for c in ("id", "text_key", "text"))):
            name = (doc.as_py() % 2**64, key.as_py() % 2**64)
            part = wanted.pop(name, None)  # rows that repeat exactly are asked once
            if part is None:
                continue
            raw = np.frombuffer(text.as_py(), np.uint8)
            padded = np.concatenate([np.zeros(side, np.uint8), raw, np.zeros(side, np.uint8)])
            at = first[part].astype(np.int64)
            held["left"].append(padded[at[:, None] + np.arange(side - 1, -1, -1)[None, :]])
            held["right"].append(padded[at[:, None] + side + span.gram + np.arange(side)[None, :]])
            held["at"].append(first[part])
            held["reach"].append(last[part] - first[part])
            held["hash"].append(hashes[part])
            held["before"].append(np.minimum(at, side).astype(np.uint64))
            held["after"].append(np.minimum(len(raw) - at - span.gram, side).astype(np.uint64))
            held["id"].append(np.full(len(part), name[0], np.uint64))
            held["key"].append(np.full(len(part), name[1], np.uint64))
        if not held["at"]:
            return _rows([], _SIDES)
        h = {k: np.concatenate(v) for k, v in held.items()}
        bucket = (h["hash"] % np.uint64(buckets)).astype(np.int64)
        rows = _split(bucket, [(h["hash"], 6), (h["id"], 8), (h["key"], 8), (h["at"], 5), (h["reach"], 5), (h["before"], 1), (h["after"], 1)])
        order, begin = np.argsort(bucket, kind="stable"), 0
        for row in rows:
            part = order[begin:begin + len(row[6])]
            begin += len(part)
            row += [h["left"][part].tobytes(), h["right"][part].tobytes()]
        return _rows(rows, _SIDES)

    def ids_of(table: DataFrame) -> DataFrame:
        """The document ids inside packed rows."""
        def distinct(found: pa.Table) -> pa.Table:
            return pa.table({"id": pa.array(np.unique(_column(found, "id", 8)).view(np.int64), pa.int64())})

        return table.select("bucket", "id").groupBy("bucket").applyInArrow(distinct, "id long")

    # Spark groups by bucket; a bucket holds about bucket_bytes of text, or one longer document.
    asking = prefilter(keyed, "id", ids_of(asked), "id")
    sides = asking.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(fetch, _SIDES_DDL)
    resolved = stage(sides.groupBy("bucket").applyInArrow(lambda table: resolve_sides(table, span, buckets), _FOUND_DDL), "ranges")
    ranges = found.filter("NOT ask").unionByName(resolved)

    out_schema = pa.schema([("id", pa.int64()), ("text", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                            ("kept", pa.binary())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        spans = _by_document(right)
        first, last = (_column(right, c, 5).astype(np.int64) for c in ("first", "last"))
        rows = []
        for doc, key, text in zip(*(left.column(c) for c in ("id", "text_key", "text"))):
            data, part = text.as_py(), spans.get((doc.as_py() % 2**64, key.as_py() % 2**64))
            if part is None:
                rows.append([doc.as_py(), data, len(data), 0, 0, data])
                continue
            begin, end = merge_ranges(first[part], np.minimum(last[part], len(data)))
            kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
            rows.append([doc.as_py(), data, len(data), int((end - begin).sum()), len(begin), kept])
        return _rows(rows, out_schema)

    touched = prefilter(keyed, "id", ids_of(ranges), "id", flag="touched")
    changed = touched.filter("touched").drop("touched").groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(
        cut, "id long, text binary, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
                           F.col("text").alias("kept"))

    return changed.unionByName(whole(touched.filter("NOT touched"))).unionByName(whole(named.filter("id IS NULL")))
