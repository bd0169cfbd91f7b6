"""Personal data: base spans against plain patterns, the random field against enumeration and on held-out regions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from contentkit.llm import private_spans as ps
from contentkit.llm import queries

SF = "/root/testdata/sf0.001"


def luhn(digits):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    """The patterns as they are stated, read left to right."""
    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def listed(spans):
    return ",".join(f"{ps.KINDS[k]}:{s}:{e}" for k, s, e in spans)


@pytest.fixture(scope="module")
def field():
    return ps.learn(ps._made(np.random.default_rng(7)))


@pytest.mark.parametrize("alphabet", ["a1.@", "12 -+(", "9.@-% _", "a@.", "4 1.+)"])
def test_base_spans(alphabet):
    rng = random.Random(alphabet)
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert sorted(ps.base_spans(text)) == plain(text), text


def test_long_runs_take_linear_time(field):
    for text in ("x" * 300_000, "1" * 300_000, "1." * 100_000, "+1 " * 100_000, "@" * 100_000, "a@" * 60_000, "1" + " " * 300_000 + "+", "a@b.c " * 20_000):
        got = sorted(ps.base_spans(text))
        assert got == (plain(text) if text[:2] in ("1.", "a@", "+1") else [])
        ps.regions(text, ps.base_spans(text))
    numbers = "123 4567 " * 3_000
    assert len(ps.find([numbers], field)) == 1


def score(region, segments, field):
    """The score of one segmentation, from the features of each entity alone."""
    atoms = ps.Atoms([region])
    total, last = 0.0, ps._O
    for kind, end, span in segments:
        total += field.moves[last, kind]
        if kind < ps._O:
            total += field.weights[atoms.features(np.array([0]), np.array([end]), np.array([span]))].sum(1)[0, kind]
        last = kind
    return total


def segmentations(size, allowed):
    if not size:
        yield []
        return
    for span in range(1, size + 1):
        for rest in segmentations(size - span, allowed):
            if span == 1:
                yield [*rest, (ps._O, size, 1)]
            if (size, span) in allowed:
                for kind in range(ps._O):
                    yield [*rest, (kind, size, span)]


@pytest.mark.parametrize("text", ["+1 55512345", "555-1234 5678901", "1.2.3.4 +12345678", "é@a.com", "4.3.2.1234567"])
def test_viterbi_is_the_best_of_all_segmentations(text):
    rng = np.random.default_rng(len(text))
    field = ps.Field(rng.standard_normal((sum(ps.FEATURES), ps._O)), rng.standard_normal((ps._O + 1, ps._O + 1)))
    region = ps.Region(text)
    atoms = ps.Atoms([region])
    _, ends, spans = atoms.candidates(1, int(atoms.sizes[0]))
    best = max(segmentations(int(atoms.sizes[0]), set(zip(ends.tolist(), spans.tolist()))), key=lambda s: score(region, s, field))
    want = [(k, atoms.starts[0][e - n], atoms.ends[0][e - 1]) for k, e, n in best if k < ps._O]
    assert ps.viterbi([region], field)[0] == want
    assert ps.viterbi([ps.Region("1234567 +1234567 12.3.4.5"), region, ps.Region("x")], field)[1] == want


def test_gradient_is_that_of_the_likelihood():
    region, truth = ps.Region("+1 5551234 5678901"), [(3, 0, 10)]
    one = ps.learn([(region, truth)], rounds=60)
    assert ps.viterbi([region], one)[0] == truth
    none = ps.learn([(region, [])], rounds=60)
    assert ps.viterbi([region], none)[0] == []


def test_held_out_regions(field):
    made = ps._made(np.random.default_rng(1234))
    got = ps.decode([r for r, _ in made], field)
    assert sum(got[r] == found for r, found in made) / len(made) > 0.97


def test_neighbours_that_the_patterns_lose(field):
    texts = ["ring +1 (743) 555-3824 4080166431094600 now", "at 38.253.197.126 4880761348116108", "write josé@example.org", "call (743) 555-3824.",
             "Version 2.0. of 2023-11-12, 978-3-16-148410-0, 1234567 items", "user@localhost and @name", ""]
    got = [s for _, s in ps.find(texts, field)]
    assert got[0] == [(2, 23, 39), (3, 5, 22)] and got[1] == [(1, 3, 17), (2, 18, 34)] and got[2] == [(0, 6, 22)] and got[3] == [(3, 5, 19)]
    assert got[4:] == [[], [], []]
    for (base, spans), text in zip(ps.find(texts, field), texts):
        assert sorted(base) == plain(text) and set(base) <= set(spans)
        assert all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(spans, 2))


def test_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op13_private_spans"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest() and set(listed(base).split(",")) - {""} <= set(r.spans.split(","))


def test_odd_rows(spark, docs_of, odd_rows):
    rows = [*odd_rows, (8, "a.b@c.de 1.2.3.4"), (8, "a.b@c.de 1.2.3.4")]
    docs = docs_of(rows).withColumnRenamed("source", "spans").withColumnRenamed("lang", "kind")
    got = ps.scan(docs, ps.fit(docs))
    assert got.count() == len(rows) and got.columns.count("spans") == 1 and "score" in got.columns
    assert [listed([tuple(s) for s in r.spans]) for r in got.filter("doc_id = 8").collect()] == ["email:0:8,ip:9:16"] * 2
    assert ps.scan(docs_of([]), ps.fit(docs_of([]))).count() == 0
