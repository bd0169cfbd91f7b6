"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are taken in batches of about equal bytes and split at safe boundaries: ASCII white space.  The tokenizer drops white
space, and neither its normalizer nor its merges reach across it, so the counts of the pieces add up to the count of the whole.
Within a batch every different piece is encoded once; a bounded table remembers lengths of short pieces.  A run without white
space stays whole, however long.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a batch; longest piece that is remembered, and how many are.
BATCH_BYTES = 1 << 20
KNOWN_BYTES = 48
KNOWN_PIECES = 1_000_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def _known(path: str) -> dict[bytes, int]:
    return {}


def _encode(pieces: list[bytes], path: str) -> dict[bytes, int]:
    """Length of every piece, encoded in batches of about equal bytes."""
    tokenizer, out, start, held = _tokenizer(path), {}, 0, 0
    for k, piece in enumerate(pieces, 1):
        held += len(piece)
        if held >= BATCH_BYTES // 4 or k == len(pieces):
            part = pieces[start:k]
            found = tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)
            out.update(zip(part, map(len, found)))
            start, held = k, 0
    return out


def count_batch(texts: list[bytes], path: str) -> list[int]:
    """Tokens per UTF-8 text, without added special tokens."""
    known, counts, start, held = _known(path), [], 0, 0
    for k, text in enumerate(texts, 1):
        held += len(text)
        if held < BATCH_BYTES and k < len(texts):
            continue
        # The tokenizer lowers letters itself; special strings, which it looks for before that, all hold "<|".
        pieces = [(t if b"<|" in t else t.lower()).split() for t in texts[start:k]]
        if len(known) > KNOWN_PIECES:
            known.clear()
        known.update(_encode(list({w for words in pieces for w in words if w not in known}), path))
        counts += [sum(map(known.__getitem__, words)) for words in pieces]
        for long in {w for words in pieces for w in words if len(w) > KNOWN_BYTES}:
            del known[long]
        start, held = k, 0
    return counts


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than *limit* tokens) to every row; null texts count as empty.

    *tokenizer_path* is a ``tokenizers`` JSON file that every executor has.  It must drop white space (as word-end
    vocabularies do); special strings inside texts are treated as the file says.  Nothing is shuffled.
    """
    carried = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    kept = docs.select(*[F.col(f"`{c}`") for c in carried])
    schema = kept.schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("_text"))

    def count(batches):
        for batch in batches:
            texts = batch.column(len(carried)).to_pylist()
            counts = count_batch(texts, tokenizer_path)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:len(carried)], pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                pa.array([c > limit for c in counts], pa.bool_())], schema.names)

    return rows.mapInArrow(count, schema)
