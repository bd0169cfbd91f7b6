"""N-gram Jaccard self-join by a prefix index whose lists are skipped in blocks.

Exact for any data: two sets link when ``100 * |intersection| >= percent * |union|``.

* Equal sets form a class; only its representative (least id) goes on.
* Shingles are ordered rare first by an approximate document frequency (a counting sketch of fixed size over all
  documents), ties by hash.  Linked sets share a shingle within the first ``(1 - t) n + 1`` of both.
* The index lists (one per shingle) are cut into blocks of similar set size.  Every block has a leader, the set with
  the fewest shingles before the list's one.  Sets that link with their leader take over its answers: they are
  in one component, so nothing inside it is compared again.
* What remains are pairs of blocks of one list that lie in different components.  A pair of blocks is skipped
  as a whole when sizes or positions rule out every link; the others are compared set by set.
* Candidates are screened by parity bitmaps of the sets, about one bit per shingle: bitmaps that differ in k bits mean
  sets that differ in at least k shingles, so no link is lost.  Those that pass are verified on the shingles of the whole texts.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.llm.graph import components
from contentkit.llm.storage import bounded_batches, prefilter, stage, without_ids
from contentkit.llm.words import shingles, signed, word_hashes

#: Counters of the frequency sketch (4 MB in all, whatever the input) and the blocks it is summed in.
SKETCH = 1 << 20
BLOCKS = 64


@dataclass(frozen=True)
class Rule:
    """What a set is and when two of them link."""

    width: int = 3
    percent: int = 90

    def set_of(self, data: bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes of a whole text."""
        return np.unique(shingles(word_hashes(data), self.width))


def parity_bits(found: np.ndarray) -> bytes:
    """Which cells hold an odd number of the set's hashes; as many cells as the power of two up to the set's size, 64 at least."""
    cells = max(64, 1 << (max(len(found), 1).bit_length() - 1))
    odd = np.bincount((found >> np.uint64(24) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets; the wider bitmap is folded to the other's cells."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        long, short = (x, y) if len(x) > len(y) else (y, x)
        x, y = long[:len(long) // 2] ^ long[len(long) // 2:], short
    return int(np.bitwise_count(x ^ y).sum())


def _need(n: Column, m: Column, percent: int) -> Column:
    """Least intersection of linked sets of sizes n and m."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9))


def frequency_sketch(docs: DataFrame, rule: Rule, text_col: str = "text") -> np.ndarray:
    """In how many documents the shingles of each counter occur, summed over the counter."""

    def count(batches):
        counters = np.zeros(SKETCH, dtype=np.uint32)
        for batch in batches:
            for text in batch.column(0):
                found = rule.set_of(text.as_py())
                counters += np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32) \
                    if len(found) > SKETCH // 8 else 0
                if len(found) <= SKETCH // 8:
                    np.add.at(counters, (found & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
        parts = counters.reshape(BLOCKS, -1)
        full = [k for k in range(BLOCKS) if parts[k].any()]
        salt = math.isqrt(TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([
            pa.array(full, pa.int32()), pa.array([salt] * len(full), pa.int32()),
            pa.array([zlib.compress(parts[k].tobytes(), 1) for k in full], pa.binary())], ["block", "salt", "counts"])

    def add(key, table):
        total = sum(np.frombuffer(zlib.decompress(c.as_py()), dtype=np.uint32).astype(np.uint64) for c in table.column("counts"))
        packed = zlib.compress(np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32).tobytes(), 1)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([packed], pa.binary())})

    schema = "block int, counts binary"
    parts = docs.select(F.col(text_col).cast("binary")).mapInArrow(count, "block int, salt int, counts binary")
    summed = parts.groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    out = np.zeros((BLOCKS, SKETCH // BLOCKS), dtype=np.uint32)
    for row in summed.collect():
        out[row.block] = np.frombuffer(zlib.decompress(row.counts), dtype=np.uint32)
    return out.reshape(-1)


def describe_sets(docs: DataFrame, sketch: np.ndarray, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, h1, h2, prefix, bits) per document: set size, two hashes of the set, its rarest shingles in order, its parities."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def rows(batches):
        for batch in batches:
            n, h1, h2, prefixes, bits = [], [], [], [], []
            for text in batch.column(1):
                found = rule.set_of(text.as_py())
                size = len(found)
                raw = found.tobytes()
                n.append(size)
                h1.append(xxhash.xxh3_64_intdigest(raw) - 2**63)
                h2.append(xxhash.xxh3_64_intdigest(raw, seed=1) - 2**63)
                keep = size - -(-rule.percent * size // 100) + 1 if size else 0
                rank = shared.value[(found & np.uint64(SKETCH - 1)).astype(np.int64)]
                prefixes.append(signed(found[np.lexsort((found, rank))[:keep]]))
                bits.append(parity_bits(found))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate([*prefixes, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(bits, pa.binary())], ["id", "n", "h1", "h2", "prefix", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        rows, "id long, n long, h1 long, h2 long, prefix array<long>, bits binary")


def screen(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that their parity bitmaps do not rule out."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    known = prefilter(sets.select("id", "n", "bits"), "id", wanted, "id")
    left = pairs.join(known.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    both = left.join(known.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")

    def check(batches):
        for batch in batches:
            n, m, x, y = (batch.column(k).to_pylist() for k in range(2, 6))
            near = [(100 + rule.percent) * least_difference(x[k], y[k]) <= (100 - rule.percent) * (n[k] + m[k]) for k in range(len(n))]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(check, "a long, b long").distinct()


def verify(pairs: DataFrame, docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) that link, judged on the shingle sets of their whole texts."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    texts = prefilter(texts, "id", wanted, "id").join(wanted, "id", "left_semi")
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches):
        for batch in batches:
            a, b = [], []
            last, set_a = None, None
            for k in range(batch.num_rows):
                text_a = batch.column(2)[k].as_py()
                if text_a != last:
                    last, set_a = text_a, rule.set_of(text_a)
                set_b = rule.set_of(batch.column(3)[k].as_py())
                same = len(np.intersect1d(set_a, set_b, assume_unique=True))
                if 100 * same >= rule.percent * (len(set_a) + len(set_b) - same):
                    a.append(batch.column(0)[k].as_py())
                    b.append(batch.column(1)[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def link_representatives(heads: DataFrame, sets: DataFrame, docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, label) for the class representatives that link with another one."""
    entries = heads.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 + (100 - rule.percent) / (2 * rule.percent)))).cast("int")

    def fits(n, pos, m) -> Column:
        return pos <= n - _need(n, m, rule.percent)

    # Size and position in one long: the pair of a list of two is judged inside the aggregate, and only longer
    # lists are read again.
    place = F.shiftleft("n", 32) + F.col("pos")
    lists = entries.withColumn("place", place).groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("a"), F.max("id").alias("b"), F.min("place").alias("p"), F.max("place").alias("q"))
    n, m = F.shiftright("p", 32), F.shiftright("q", 32)
    x, y = F.col("p").bitwiseAND(2**32 - 1), F.col("q").bitwiseAND(2**32 - 1)
    couple = (n * 100 >= m * rule.percent) & fits(n, x, m) & fits(m, y, n)
    lists = stage(lists.filter((F.col("size") > 2) | ((F.col("size") == 2) & couple)).select("token", "size", "a", "b"), "lists")
    longer = lists.filter("size > 2").select("token")
    index = stage(prefilter(entries, "token", longer, "token").join(longer, "token").withColumn("band", band), "index")

    leaders = index.groupBy("token", "band").agg(F.min(F.struct("pos", "id", "n")).alias("leader"), F.count(F.lit(1)).alias("many"))
    leaders = leaders.filter("many > 1").select("token", "band", F.col("leader.id").alias("lid"), F.col("leader.n").alias("ln"),
                                                F.col("leader.pos").alias("lpos"))
    star = index.join(leaders, ["token", "band"]).filter(
        (F.col("id") != F.col("lid")) & fits(F.col("n"), F.col("pos"), F.col("ln")) & fits(F.col("ln"), F.col("lpos"), F.col("n")))
    star = star.select(F.least("id", "lid").alias("a"), F.greatest("id", "lid").alias("b"))
    star = stage(star.union(lists.filter("size = 2").select("a", "b")).distinct(), "star")
    first = stage(verify(stage(screen(star, sets, rule), "near"), docs, rule, id_col, text_col), "links")

    # Members of a component have each other's answers; only blocks of different components are compared.
    label = components(first)
    labelled = stage(index.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "label", F.coalesce("label", "id")), "labelled")
    blocks = labelled.groupBy("token", "band", "label").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("pos"))
    mixed = blocks.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("token")
    blocks = blocks.join(mixed, "token")
    right = blocks.select("token", *[F.col(c).alias(f"{c}_b") for c in ("band", "label", "lo", "hi", "pos")])
    reach = F.lit(rule.percent / 100)

    def loosest(hi: str, other_lo: str) -> Column:
        """The latest position that any pair of the two blocks allows on the side with sizes up to *hi*."""
        return F.col(hi) - _need(F.col(hi), F.greatest(F.col(other_lo).cast("double"), F.col(hi) * reach), rule.percent) + 1

    skip_free = (
        (F.col("label") < F.col("label_b")) & (F.col("lo_b") * reach <= F.col("hi") + 1e-6) & (F.col("lo") * reach <= F.col("hi_b") + 1e-6)
        & (F.col("pos") <= loosest("hi", "lo_b")) & (F.col("pos_b") <= loosest("hi_b", "lo"))
    )
    block_pairs = blocks.join(right, "token").filter(skip_free).select("token", "band", "label", "band_b", "label_b")
    one = labelled.select("token", "band", "label", "id", "n", "pos")
    two = labelled.select("token", *[F.col(c).alias(f"{c}_b") for c in ("band", "label", "id", "n", "pos")])
    pairs = (
        block_pairs.join(one, ["token", "band", "label"]).join(two, ["token", "band_b", "label_b"])
        .filter(fits(F.col("n"), F.col("pos"), F.col("n_b")) & fits(F.col("n_b"), F.col("pos_b"), F.col("n"))
                & (F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * rule.percent))
        .select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()
    )
    late = stage(screen(stage(pairs.join(star, ["a", "b"], "left_anti"), "cross"), sets, rule), "near")
    return components(first.union(verify(late, docs, rule, id_col, text_col)))


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per document.

    component_id is the least id reachable by links.  Null and blank texts have an empty set and link with nothing.
    A repeated id keeps one row per occurrence; rows with a null id come back with a null component.  Ids are longs;
    other columns of *docs* are not looked at.
    """
    bounded_batches(docs.sparkSession)
    sketch = frequency_sketch(docs, rule, text_col)
    sets = stage(describe_sets(docs, sketch, rule, id_col, text_col), "sets")
    usable = sets.filter("id IS NOT NULL AND n > 0")
    classes = usable.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    # Copies of another set's text are few next to all sets, so only they (and repeated ids) are looked up.
    slim = usable.select("id", "n", "h1", "h2")
    copies = slim.join(classes, ["h1", "h2", "n"]).filter("id <> rep").select("id")
    repeated = slim.groupBy("id").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("id")
    heads = without_ids(usable, "id", copies, repeated, ["h1", "h2", "n"]).select("id", "n", "prefix")
    label = link_representatives(heads, usable, docs, rule, id_col, text_col)
    final = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", "n", F.coalesce("label", "rep").alias("component"))
    rows = sets.select("id", "n", "h1", "h2").withColumn("usable", F.col("id").isNotNull() & (F.col("n") > 0))
    linked = rows.filter("usable").join(final, ["h1", "h2", "n"], "left").select("id", "n", "component")
    alone = rows.filter("NOT usable").select("id", "n", F.col("id").alias("component"))
    return linked.union(alone).select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one_per_group(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of *docs* that are the least id of their component; repeated rows of one id keep one.

    Rows with a null id are kept as they are.
    """
    found = stage(jaccard_components(docs.filter(F.col(id_col).isNotNull()), rule, id_col, text_col), "groups")
    dropped = found.filter("id <> component_id").select("id")
    repeated = found.groupBy("id").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("id")
    kept = without_ids(docs.filter(F.col(id_col).isNotNull()), id_col, dropped, repeated)
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
