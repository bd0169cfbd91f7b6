"""Numbers are no secrets, keys next to them are; every length has a null in a small corpus too."""

import collections
import contextlib
import math
import random
import re
import string

import duckdb
from pyspark.sql import functions as F

from contentkit.llm import queries, secrets


def spans_of(docs, battery):
    return {r.doc_id: [(s.kind, s.start, s.stop) for s in r.secrets] for r in secrets.scan(docs, battery).select("doc_id", "secrets").collect()}


def test_numbers_next_to_keys(docs_of):
    rng = random.Random(11)
    prose = "the quick brown fox jumps over the lazy dog and then it rests for a while "
    number = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    rows, keys = [], {}
    for k in range(60):
        text = prose * 3 + f"order {number(16)} card {number(19)} ref {number(24)} "
        if k % 3 == 0:
            keys[k] = (len(text) + 4, len(text) + 44)
            text += f"use {key(40)} and {number(20)}"
        rows.append((k, text))
    docs = docs_of(rows)
    got = spans_of(docs, secrets.fit_battery(docs))
    texts = dict(rows)
    found = [(i, s) for i, spans in got.items() for s in spans]
    assert all(not texts[i][a:b].isdigit() for i, (_, a, b) in found)
    assert sum((3, *place) in got[i] for i, place in keys.items()) >= 0.9 * len(keys)


def test_no_plain_number_on_the_driver_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    spans = [(r.doc_id, x.split(":")) for r in queries.QUERIES["op6_secret_battery"](spark, sf).collect() for x in r.spans.split(",") if x.startswith("random")]
    assert not [1 for i, (_, a, b) in spans if texts[i][int(a):int(b)].isdigit()]


def test_pieces_come_from_the_whole_text(docs_of):
    texts = [" ".join(f"{w}{c}" for w in ("alpha", "beta") for c in string.ascii_lowercase) + f" {k} " + "tailword " * 600 for k in range(60)]
    docs = docs_of(list(enumerate(texts)))
    pieces = [p for r in docs.select(secrets._pieces(F.col("text")).alias("p")).collect() for p in r.p]
    assert any("TAIL" in p.upper() for p in pieces) and any("ALPHA" in p.upper() for p in pieces)


def test_pieces_hold_every_short_word(docs_of):
    texts = [" ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in string.ascii_lowercase for c in "xyz") + " " + "q" * 40 + f" end{k}" for k in range(3)]
    for r in docs_of(list(enumerate(texts))).select("text", secrets._pieces(F.col("text")).alias("p")).collect():
        whole = "".join(c for c in r.text.replace("q" * 40, " ") if c.isalpha())
        glued = "".join(p for p in r.p if p == p.lower() and set(p) - set("0123456789abcdef"))
        assert len(whole) - len(glued) < secrets.LEAST and whole.startswith(glued)
        assert sum(len(p) for p in r.p if p == p.upper()) > len(whole) - secrets.LEAST


def test_distance_against_its_definition(docs_of):
    rng = random.Random(4)
    tokens = ["".join(rng.choice(a) for _ in range(n)) for a in secrets.ALPHABETS.values() for n in (16, 23, 70)]
    kinds = [r.k for r in docs_of(list(enumerate(tokens))).select("doc_id", secrets._kind(F.col("text")).alias("k")).orderBy("doc_id").collect()]
    for token, kind, r in zip(tokens, kinds, docs_of(list(enumerate(tokens))).select("doc_id", secrets._distance(F.col("text")).alias("d")).orderBy("doc_id").collect()):
        letters = secrets.ALPHABETS[kind]
        v, m, n = [letters.find(c) for c in token], len(letters), len(token)
        chi = (sum(token.count(c) ** 2 for c in set(token)) * m / n - n - (m - 1)) / math.sqrt(2 * (m - 1))
        bits = [x > m / 2 for x in v]
        runs = (sum(a != b for a, b in zip(bits, bits[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
        serial = sum((a - (m - 1) / 2) * (b - (m - 1) / 2) for a, b in zip(v, v[1:])) / ((m * m - 1) / 12 * math.sqrt(n))
        assert abs(r.d - math.log(max(chi, 0) ** 2 + runs ** 2 + serial ** 2 + 1)) < 1e-9


def test_statistic_is_computed_once(docs_of, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise StopIteration

    monkeypatch.setattr(secrets, "stage", kept)
    with contextlib.suppress(StopIteration):
        secrets.fit_battery(docs_of([(1, "some words of a text")]))
    # One projection for the tokens of the documents and one for those of the passage; no filter repeats the statistic.
    lines = [x for x in plans[0].splitlines() if "zip_with" in x]
    assert len(lines) == 2 and not any(x.lstrip(" :+-").startswith("Filter") for x in lines)


def test_pieces_against_their_definition_with_one_pass_per_alphabet(docs_of):
    texts = ["Größe 12 of DEADBEEF, café\nline two " * 9, "x", "", "k" * 30 + " a b c d e f " * 4 + "q" * 15, "日本 語 abc DEF 0123 " * 12]
    got = docs_of(list(enumerate(texts))).select(
        "text", secrets._pieces(F.col("text")).alias("p"), *[(F.pmod(F.xxhash64(F.lit(k), "text"), F.lit(113)) + 16).alias(f"n{k}") for k in range(3)])
    for r in got.collect():
        short = re.sub(secrets.CANDIDATE, " ", r.text)
        letters, digits = re.sub("[^A-Za-z]", "", short), re.sub("[^0-9A-Fa-f]", "", short)
        rests = [(letters, r.n0), (letters.upper(), r.n1), (digits.lower(), r.n2)]
        assert sorted(r.p) == sorted(p for rest, n in rests for p in (rest[k:k + n] for k in range(0, len(rest), n)) if len(p) >= 16)
    # Nothing is removed character by character, and letters are glued once for the two encodings that are made of them.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "[^" not in plan and plan.count("[A-Za-z]+") == 1


def test_statistic_of_any_token(spark):
    rng = random.Random(31)
    tokens = ["A" * 16 + "==", "KLZ2" * 5 + "=", "=" * 20, "f" * 40, "a" * (secrets.PACKED + 1), "b" * secrets.PACKED]
    tokens += ["".join(rng.choice(a) for _ in range(rng.randint(16, 300))) for a in secrets.ALPHABETS.values() for _ in range(20)]
    token = F.col("token")

    def want(token, kind):
        letters, n = secrets.ALPHABETS[kind], len(token)
        m, squares = len(letters), sum(c * c for c in collections.Counter(token).values())
        values = [letters.find(c) - (m - 1) / 2 for c in token]
        halves = [letters.find(c) > m / 2 for c in token if c in letters]
        changes = sum(a != b for a, b in zip(halves, halves[1:]))
        chi = max((squares * m / n - n - (m - 1)) / math.sqrt(2 * (m - 1)), 0)
        runs = (changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)
        serial = sum(a * b for a, b in zip(values, values[1:])) / ((m * m - 1) / 12 * math.sqrt(n))
        return squares, math.log(chi**2 + runs**2 + serial**2 + 1)

    rows = spark.createDataFrame([(t,) for t in tokens], "token string").withColumn("kind", secrets._kind(token))
    rows = rows.withColumn("values", secrets._values(token, F.col("kind"))).withColumn("ordered", F.sort_array("values"))
    found = rows.select("token", "kind", secrets._squares(token, F.col("ordered")).alias("squares"), secrets._distance(token).alias("distance"),
                        secrets._statistic(token, F.col("kind"), F.col("values"), F.col("ordered")).alias("statistic")).collect()
    for r in found:
        squares, statistic = want(r.token, r.kind)
        assert r.squares == squares and r.distance == r.statistic and abs(r.statistic - statistic) < 1e-9
