"""Cross-tokenizer alignment by lockstep vectorised merging.

A text has two token sequences over the same bytes: A of a byte-level tokenizer, B of a piece tokenizer.  Both are cut into
groups at the byte offsets where a token of either ends, and two tokens are linked when their byte ranges overlap.

All documents of a batch are merged at once.  One NumPy state vector holds a pointer into A and one into B for every lane; a
step compares the two token ends of all lanes, emits one link a lane and a cut where the ends are equal, and advances the
pointer that ends first (both at a cut).  Lanes that are through are taken out of the vector.  A document has one lane for
every ``LANE`` tokens of A: a lane starts at the beginning of an A token, where exactly one new link starts, so long texts
take no more steps than short ones and every link comes out of one lane.

How often two token ids are linked is summed over the corpus.  The most frequent pairs, of which a bounded number is
broadcast, are looked up next to the documents; all others, none of which can be frequent, are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from contentkit.llm.storage import stage

#: A tokens of a lane, bytes of text that are merged at once, and pairs that are broadcast.
LANE = 96
BATCH_BYTES = 1 << 20
HEAD_PAIRS = 1 << 19
#: A pair of token ids is one long: A's id above B's.
_SHIFT = 24
_ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class ByteTokens:
    """Tokenizer A: a byte-level BPE of the ``tokenizers`` library; special strings in a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        with open(path, encoding="utf-8") as f:
            special = {t["id"] for t in json.load(f).get("added_tokens", [])}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes[k] = entry.encode() if k in special else bytes(byte[c] for c in entry)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceTokens:
    """Tokenizer B: a ``sentencepiece`` model that adds a leading space; U+2581 is a space, byte pieces are one byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Side:
    """A tokenizer with what the merge needs of its vocabulary: byte lengths, and ids as text followed by each separator."""

    def __init__(self, tokens: ByteTokens | PieceTokens, inner: str, outer: str):
        self.tokens = tokens
        self.lengths = np.array([len(b) for b in tokens.bytes], np.int64)
        width = len(str(len(tokens.bytes))) + 1
        self.printed = np.array([f"{k}{s}".encode() for k in range(len(tokens.bytes)) for s in (inner, outer)], f"S{width}")


@lru_cache(maxsize=2)
def _sides(a_path: str, b_path: str) -> tuple[_Side, _Side]:
    return _Side(ByteTokens(a_path), ",", "|"), _Side(PieceTokens(b_path), ",", ";")


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, stop: np.ndarray):
    """Merge lanes: (A positions of links, B positions of links, whether a link is the last of its group).

    *a_ends*, *b_ends* are byte offsets of token ends, ascending over the batch; a lane takes the A tokens from its *at_a* up to
    its *stop*, starting with the B token *at_b* that holds the first byte.
    """
    links_a, links_b, cuts = [], [], []
    while len(at_a):
        end_a, end_b = a_ends[at_a], b_ends[at_b]
        links_a.append(at_a)
        links_b.append(at_b)
        cuts.append(end_a == end_b)
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        going = at_a < stop
        if not going.all():
            at_a, at_b, stop = at_a[going], at_b[going], stop[going]
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(links_a), np.concatenate(links_b), np.concatenate(cuts)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def align_batch(texts: list[bytes | None], a: _Side, b: _Side) -> dict[str, pa.Array]:
    """Columns of a batch: counts, digest of the groups, linked pairs with how often, and tokens with the ends of groups."""
    shown = [(t or b"").decode("utf-8", "replace") for t in texts]
    full = [k for k, t in enumerate(texts) if t]
    ids_a = dict(zip(full, a.tokens.encode([shown[k] for k in full])))
    ids_b = dict(zip(full, b.tokens.encode([shown[k] for k in full])))

    def same(k: int) -> bool:
        want = b" " + texts[k]
        return all(b"".join(map(side.tokens.bytes.__getitem__, ids[k])) == want for side, ids in ((a, ids_a), (b, ids_b)))

    whole = {k for k in full if same(k)}
    rows_a = [ids_a[k] if k in whole else [] for k in range(len(texts))]
    rows_b = [ids_b[k] if k in whole else [] for k in range(len(texts))]
    off_a, off_b = (_offsets(np.array([len(r) for r in rows], np.int64)) for rows in (rows_a, rows_b))
    tok_a, tok_b = _flat(rows_a), _flat(rows_b)
    ends_a, ends_b = np.cumsum(a.lengths[tok_a]), np.cumsum(b.lengths[tok_b])
    # Both sequences of a document have the same bytes, so offsets over the batch compare as those of the document do.
    lanes = _offsets(-(-np.diff(off_a) // LANE))
    lane_doc = np.repeat(np.arange(len(texts)), np.diff(lanes))
    start = off_a[lane_doc] + (np.arange(lanes[-1]) - lanes[lane_doc]) * LANE
    stop = np.minimum(start + LANE, off_a[lane_doc + 1])
    first_byte = ends_a[start] - a.lengths[tok_a[start]] if len(start) else start
    link_a, link_b, cut = lockstep(ends_a, ends_b, start, np.searchsorted(ends_b, first_byte, "right"), stop)

    doc_of = np.repeat(np.arange(len(texts)), np.diff(off_a))
    link_doc = doc_of[link_a]
    pair, times = np.unique((link_doc << (2 * _SHIFT)) | (tok_a[link_a] << _SHIFT) | tok_b[link_b], return_counts=True)
    pair_off = np.searchsorted(pair >> (2 * _SHIFT), np.arange(len(texts) + 1))
    cut_a, cut_b = np.sort(link_a[cut]), np.sort(link_b[cut])
    # Text of the groups: a token stands behind all tokens of earlier groups and, on side B, behind the A tokens of its own.
    group_a, group_b = np.searchsorted(cut_a, np.arange(len(tok_a))), np.searchsorted(cut_b, np.arange(len(tok_b)))
    groups_a, groups_b = _offsets(np.bincount(group_a, minlength=len(cut_a))), _offsets(np.bincount(group_b, minlength=len(cut_b)))
    printed = np.zeros(len(tok_a) + len(tok_b), max(a.printed.dtype, b.printed.dtype))
    printed[np.arange(len(tok_a)) + groups_b[group_a]] = a.printed[2 * tok_a + np.isin(np.arange(len(tok_a)), cut_a, assume_unique=True)]
    printed[np.arange(len(tok_b)) + groups_a[group_b + 1]] = b.printed[2 * tok_b + np.isin(np.arange(len(tok_b)), cut_b, assume_unique=True)]
    digests = []
    for k in range(len(texts)):
        text = printed[off_a[k] + off_b[k]:off_a[k + 1] + off_b[k + 1]].tobytes().replace(b"\0", b"")[:-1]
        digests.append(hashlib.sha256(text).hexdigest() if k in whole else "")
    n_groups = np.bincount(doc_of[cut_a], minlength=len(texts))
    return {
        "n_a": pa.array(np.diff(off_a)), "n_b": pa.array(np.diff(off_b)), "n_groups": pa.array(n_groups),
        "n_links": pa.array(np.bincount(link_doc, minlength=len(texts))), "groups_sha256": pa.array(digests, pa.string()),
        "pairs": _lists(pair & ((1 << 2 * _SHIFT) - 1), pair_off, pa.int64()), "times": _lists(times, pair_off, pa.int32()),
        "a_ids": _lists(tok_a, off_a, pa.int32()), "b_ids": _lists(tok_b, off_b, pa.int32()),
        "a_cuts": _lists(cut_a - np.repeat(off_a[:-1], n_groups), _offsets(n_groups), pa.int32()),
        "b_cuts": _lists(cut_b - np.repeat(off_b[:-1], n_groups), _offsets(n_groups), pa.int32()),
    }


_LONGS, _INTS = ArrayType(LongType()), ArrayType(IntegerType())
_TYPES = {"n_a": LongType(), "n_b": LongType(), "n_groups": LongType(), "n_links": LongType(), "groups_sha256": StringType(), "pairs": _LONGS,
          "times": _INTS, "a_ids": _INTS, "b_ids": _INTS, "a_cuts": _INTS, "b_cuts": _INTS}


def _slices(texts: list[bytes | None]):
    """(start, end) of runs of about BATCH_BYTES; a longer text ends a run.  A row number must fit above two token ids."""
    start = held = 0
    for k, text in enumerate(texts, 1):
        held += len(text or b"")
        if held >= BATCH_BYTES or k - start == 1 << 14 or k == len(texts):
            yield start, k
            start, held = k, 0


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The columns of *docs* but the text, and of every text the *columns* asked for (all of them if None):

    n_a, n_b, n_groups, n_links, groups_sha256; pairs (A id above B id in one long, ascending) and times, how often each is
    linked in the text; a_ids, b_ids and, as positions in them, the last tokens of all groups, a_cuts and b_cuts.

    Texts that are null or empty, or whose A or B tokens do not spell a space and the text, have no tokens: zeros, empty lists
    and '' as digest.  Rows are judged one by one, so repeated rows and ids, null ids and extra columns do not matter; own
    columns of *docs* with one of these names are replaced.  The files are read on every executor.  Nothing is shuffled.
    """
    columns = columns or list(_TYPES)
    carried = [c for c in docs.columns if c not in _TYPES and c not in _ADDED and c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("binary").alias(text_col))
    schema = rows.drop(text_col).schema
    for c in columns:
        schema = schema.add(c, _TYPES[c])

    def merge(batches):
        sides = _sides(a_path, b_path)
        for batch in batches:
            texts = batch.column(len(carried)).to_pylist()
            for start, end in _slices(texts):
                found = align_batch(texts[start:end], *sides)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(carried)], *[found[c] for c in columns]], schema.names)

    return rows.mapInArrow(merge, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) over all rows of pairs and times: n links hold the pair, best says that no pair of its B id has more."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)))
    tops = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(tops, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _level():
    return F.floor(F.log2("n") * 4)


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int | None]:
    """The most frequent pairs, *most* at most, ascending, with n and best; the least level of all, and of these pairs.

    The threshold is a power of a quarter of two, read off a histogram: all pairs at or above it are taken, or none of a level.
    """
    histogram = sorted(((r.level, r.size) for r in counts.groupBy(_level().alias("level")).agg(F.count(F.lit(1)).alias("size")).collect()), reverse=True)
    held, least = 0, None
    for step, size in histogram:
        if held + size > most:
            break
        held, least = held + size, step
    rows = counts.filter(_level() >= F.lit(least)) if least is not None else counts.limit(0)
    found = rows.toArrow()
    pairs, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    return pairs[order].astype(np.int64), n[order].astype(np.int64), best[order].astype(bool), histogram[-1][0] if histogram else None, least


def _resolve(aligned: DataFrame, head: list) -> DataFrame:
    """Add n_best and count_sum as far as the head tells, and leave only unresolved entries in pairs and times."""
    table = aligned.sparkSession.sparkContext.broadcast(tuple(head))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    rows = aligned.select(*[F.col(f"`{c}`") for c in kept], "pairs", "times")
    schema = rows.select(*[F.col(f"`{c}`") for c in kept]).schema.add("n_best", "long").add("count_sum", "long").add("pairs", _LONGS).add("times", _INTS)

    def look_up(batches):
        pairs, n, best = table.value
        for batch in batches:
            lists, times = batch.column(len(kept)), batch.column(len(kept) + 1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64)
            count = times.values.to_numpy(zero_copy_only=False)
            first = times.offsets[0].as_py()
            count = count[first:first + len(values)].astype(np.int64)
            offsets = offsets - offsets[0]
            at = np.minimum(np.searchsorted(pairs, values), max(len(pairs) - 1, 0))
            hit = pairs[at] == values if len(pairs) else np.zeros(len(values), bool)

            def total(per_entry: np.ndarray) -> np.ndarray:
                return np.diff(_offsets(per_entry)[offsets])

            n_best = total(np.where(hit, count * best[at], 0)) if len(pairs) else np.zeros(len(offsets) - 1, np.int64)
            sums = total(np.where(hit, count * n[at], 0)) if len(pairs) else np.zeros(len(offsets) - 1, np.int64)
            open_off = _offsets(~hit)[offsets]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:len(kept)], pa.array(n_best), pa.array(sums), _lists(values[~hit], open_off, pa.int64()),
                _lists(count[~hit], open_off, pa.int32())], schema.names)

    return rows.mapInArrow(look_up, schema)


def link_report(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Per row the columns of *docs* but the text, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best counts the links whose pair of ids is linked as often, over all rows, as any pair of their B id (ties included);
    count_sum adds up, over the links, how often their pair is linked.  Texts without tokens have zeros (see ``align``).  Repeated
    rows each count; an empty table gives none.  The aligned rows are written to the shared folder once and read for the
    counts and for the report, so no text is encoded twice and a lost executor never changes the row numbers.
    """
    slim = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    carried = [c for c in docs.columns if c not in _TYPES and c not in _ADDED and c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row") if carried else F.struct(F.lit(0).alias("none")).alias("row"),
                         F.col(f"`{text_col}`").alias("text"))
    aligned = stage(align(packed, a_path, b_path, "text", slim).withColumn("at", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(aligned), "pair-counts")
    *head, last, least = _head(counts, head_pairs)
    solved = _resolve(aligned, head)
    out = [*[F.col(f"row.`{c}`") for c in carried], *[F.col(c) for c in _ADDED]]
    if last == least:
        return solved.select(*out)
    # Pairs below the head's level: each is rare, so no key of this join is hot.
    solved = stage(solved, "aligned")
    rest = solved.filter(F.size("pairs") > 0)
    tail = counts if least is None else counts.filter(_level() < F.lit(least))
    entries = rest.select("at", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("at", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    more = entries.join(tail, "pair").groupBy("at").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    late = rest.join(more, "at").withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    return solved.filter(F.size("pairs") == 0).select(*out).unionByName(late.select(*out))
