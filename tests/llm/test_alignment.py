"""Token alignment against a brute-force version on byte ranges."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from contentkit.llm import queries, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["▁x y", "<s> a </s> <|endoftext|>", "tab\tnew\nline  two   three", "é ü 漢字 🙂🙂 \x00 \u200b", " lead and trail ", "a" * 3000, "x\u2581y", "don't 12345 -- <0x41>", "\r\n\r\n"]


def brute(rows):
    """Every pair of tokens whose byte ranges meet, found range by range."""
    a, b = token_alignment.ByteTokens(A), token_alignment.PieceTokens(B)
    found, corpus = [], Counter()
    for i, text in rows:
        links, groups = [], []
        if text:
            ids_a, ids_b = a.encode([text])[0], b.encode([text])[0]
            want = (" " + text).encode()
            if all(b"".join(s.bytes[x] for x in ids) == want for s, ids in ((a, ids_a), (b, ids_b))):
                def ranges(side, ids):
                    at, out = 0, []
                    for x in ids:
                        out.append((at, at + len(side.bytes[x]), x))
                        at = out[-1][1]
                    return out
                ra, rb = ranges(a, ids_a), ranges(b, ids_b)
                ends = sorted({e for _, e, _ in ra} & {e for _, e, _ in rb})
                owner_b = [k for k, (s, e, _) in enumerate(rb) for _ in range(s, e)]
                for s, e, x in ra:
                    links += [(x, rb[k][2]) for k in sorted(set(owner_b[s:e]))]
                start = 0
                for end in ends:
                    groups.append(([x for s, e, x in ra if start <= s < end], [x for s, e, x in rb if start <= s < end]) if len(text) < 4000 else None)
                    start = end
                found.append((i, len(ra), len(rb), len(ends), links, groups))
                corpus.update(links)
                continue
        found.append((i, 0, 0, 0, [], None))
    top = Counter()
    for (_, y), n in corpus.items():
        top[y] = max(top[y], n)
    out = []
    for i, n_a, n_b, n_groups, links, groups in found:
        text = None if groups is None else "" if None in groups else ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = "" if text is None else hashlib.sha256(text.encode()).hexdigest() if text else None
        out.append((i, n_a, n_b, n_groups, len(links), sum(corpus[x] == top[x[1]] for x in links), sum(corpus[x] for x in links), digest))
    return out


def compare(got, want):
    got, want = sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])


@pytest.mark.parametrize("head", [token_alignment.HEAD_PAIRS, 40, 0])
def test_links_and_groups(spark, docs_of, odd_rows, head):
    rows = odd_rows + [(20 + k, t) for k, t in enumerate(ODD)] + [(40, ODD[3]), (41, " ".join(ODD[1:5] * 30))]
    got = token_alignment.link_report(docs_of(rows).withColumn("n_a", F.lit("mine")), A, B, head_pairs=head)
    assert "text" not in got.columns and "score" in got.columns and len(set(got.columns)) == len(got.columns)
    compare(got.collect(), brute(rows))


def test_tokens_and_cuts_spell_the_text(docs_of):
    rows = [(k, t) for k, t in enumerate(ODD * 20)]
    b = token_alignment.PieceTokens(B)
    for r in token_alignment.align(docs_of(rows), A, B).collect():
        text = rows[r.doc_id][1]
        assert not r.n_b or b"".join(b.bytes[x] for x in r.b_ids) == (" " + text).encode()
        assert len(r.a_cuts) == len(r.b_cuts) == r.n_groups and (not r.n_a or r.a_cuts[-1] == r.n_a - 1)


def test_empty_table(docs_of):
    assert token_alignment.link_report(docs_of([]), A, B).count() == 0
    assert token_alignment.link_report(docs_of([(1, None), (2, "")]), A, B).filter("n_links = 0 AND groups_sha256 = ''").count() == 2


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    compare(queries.QUERIES["op11_token_alignment"](spark, sf).collect(), brute(rows))
