"""The operators against row-by-row renderings of their contracts, and on odd inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from contentkit.llm import (chat, compact_windows, jaccard_join, pairwise_quality, quality_rules, queries, raking, secrets, suffix_dedup,
                            tiling, token_counts)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules(spark, texts):
    rows = queries.QUERIES["op1_quality_rules"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        many = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if many[g] > 1 for j in range(3)}
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_rules_learn_a_threshold(spark):
    rows = [(k, int(k % 4 != 0)) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, label int")
    for m in quality_rules.MEASURES:
        frame = frame.withColumn(m, F.lit(0.5))
    frame = frame.withColumn("symbol_share", F.when(F.col("label") == 0, 0.4).otherwise(0.0) + F.col("doc_id") / 10000)
    rules = quality_rules.learn(frame)
    assert len(rules) == 1 and rules[0].conditions[0].measure == "symbol_share" and rules[0].good == 0 and rules[0].bad == 100
    assert quality_rules.learn(frame.filter("label = 1")) == [] and quality_rules.learn(frame.limit(0)) == []


def test_rules_on_odd_rows(docs_of, odd_rows):
    got = quality_rules.judge(docs_of(odd_rows), []).collect()
    assert len(got) == len(odd_rows) and {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert all(r.kept for r in got if r.doc_id == 5) and quality_rules.judge(docs_of([]), []).count() == 0


def test_token_counts(spark, docs_of, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    special = [(10, "a <|endoftext|> B <|ENDOFTEXT|>x"), (11, "é ́x  y z Iİ don't 12.5\x1cq")]
    rows = odd_rows + special
    got = token_counts.count_tokens(docs_of(rows), path).collect()
    want = sorted((len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for _, t in rows)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want and "score" in got[0]


def test_pairwise_quality(spark):
    got = queries.QUERIES["op3_pairwise_quality"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_pairwise_quality_odd(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(5, 1), (5, 0), (99, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = pairwise_quality.fit(docs_of(odd_rows), labels)
    scored = pairwise_quality.score_documents(docs_of(odd_rows), model)
    assert scored.count() == len(odd_rows) and scored.filter("score IS NULL").count() == 0
    assert pairwise_quality.drop_rejected(docs_of(odd_rows), model).count() == len(odd_rows)
    assert pairwise_quality.fit(docs_of([]), labels.limit(0)).weights.any() == np.False_


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = random.Random(seed)
    text = [rng.randint(1, 1 + seed % 4) for _ in range(rng.randint(1, 60))] + [0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def removed(rows, length):
    first, out = {}, []
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows if i is not None), key=lambda r: r[0]):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k:k + length], i)
    for i, t in rows:
        t, mask = (t or "").encode(), None
        mask = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if i is not None and first[t[k:k + length]] < i:
                mask[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(t)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((i, len(t), sum(mask), runs, hashlib.sha256(bytes(c for c, m in zip(t, mask) if not m)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_random(docs_of):
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(30, 120))) for _ in range(12)] + ["é" * 40, "a" * 70]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for k in range(120)]
    rows += [(k, t[:len(t) // 2] + "#" + t[len(t) // 2:]) for k, (_, t) in enumerate(rows[:40], 200)] + [(5, rows[9][1]), (None, rows[3][1]), (7, None)]
    got = suffix_dedup.remove_repeats(docs_of(rows), bucket_bytes=4000).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted([(r.id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got], key=str) == removed(rows, 50)


def test_suffix_dedup_repeats_inside_a_document(docs_of):
    rng = random.Random(7)
    line, passage = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (60, 200))
    noise = ["".join(rng.choice("ijklmnop ") for _ in range(90)) for _ in range(12)]
    rows = [(1, noise[0] + "-" * 60 + noise[1]), (2, noise[2] + "-" * 1000 + noise[3]), (3, noise[4] + line + noise[5]), (4, noise[6] + line * 5 + noise[7]),
            (5, noise[8] + passage[:120]), (6, noise[9] + passage + noise[10] + passage + noise[11] + passage), (7, "=-" * 30), (8, "=-" * 400 + noise[0][:20])]
    got = suffix_dedup.remove_repeats(docs_of(rows), bucket_bytes=500).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted([(r.id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got], key=str) == removed(rows, 50)
    assert {r.id: r.n_removed for r in got}[2] >= 1000


def test_suffix_dedup_odd(docs_of, odd_rows):
    got = suffix_dedup.remove_repeats(docs_of(odd_rows)).collect()
    assert sorted((r.id or 0, r.n_removed) for r in got if r.id == 6) == [(6, r.n_bytes) for r in got if r.id == 6]
    assert len(got) == len(odd_rows) and suffix_dedup.remove_repeats(docs_of([])).count() == 0


def test_compact_windows_cover_every_subsequence():
    rng = np.random.default_rng(1)
    values = rng.permutation(60).astype(np.uint64)
    left, at, right = compact_windows.compact_windows(values, 7)
    for i in range(60):
        for j in range(i + 6, 60):
            c = i + int(np.argmin(values[i:j + 1]))
            assert sum(a <= i <= p <= j <= b and p == c for a, p, b in zip(left, at, right)) == 1


def test_passages(docs_of, odd_rows):
    rng = random.Random(5)
    def prose(n):
        return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = prose(70)
    near = [w if k % 35 else "edit" for k, w in enumerate(passage)]
    rows = [(1, " ".join(prose(80) + passage + prose(40))), (2, " ".join(passage + prose(90))), (3, " ".join(prose(30) + near)), (4, " ".join(prose(200)))]
    got = {r.id: r for r in compact_windows.passage_report(docs_of(rows + [(i and i + 10, t) for i, t in odd_rows])).collect()}
    assert {got[k].class_id for k in (1, 2, 3)} == {1} and got[4].n_passages == 0 and got[4].class_id == 4
    assert got[1].spans == "80:150" and got[2].spans == "0:70"
    assert compact_windows.passage_report(docs_of([])).count() == 0


def test_separated_passages(docs_of):
    rng = random.Random(8)
    def prose(n):
        return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, want = [], {}
    for pair in range(24):
        shared, own = [prose(60) for _ in range(2 + pair % 2)], prose(30)
        rows.append((2 * pair, " ".join(prose(20) + [w for p in shared for w in p + prose(150)])))
        for p in shared:
            want.setdefault(2 * pair + 1, []).append(f"{len(own)}:{len(own) + 60}")
            own += p + prose(240)
        rows.append((2 * pair + 1, " ".join(own)))
    got = {r.id: r.spans for r in compact_windows.passage_report(docs_of(rows)).collect()}
    assert {k: got[k].split(",") for k in want} == want


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets(spark, docs_of, odd_rows):
    rows = odd_rows + [
        (20, 'é Token: "abcdefgh1" secret=short token: secret: abcdefghijk'), (21, "AKIAAKIA1234567890 AKIAshort " + "0af" * 20 + "x" + "b" * 32),
        (22, "PASSWORD=" + "d" * 40), (23, "api_key : xxxxxxxx\npasswd='12345678'")]
    scanned = secrets.digest(secrets.scan(docs_of(rows), secrets.Battery({}))).collect()
    want = sorted((i, *[sum(k == q for _, k, _ in base(t)) for q in range(3)], ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base(t))) for i, t in rows if i)
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in scanned if r.doc_id) == want
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in scanned)
    clean = {r.doc_id: r for r in secrets.redact(docs_of(rows), secrets.Battery({})).collect() if r.doc_id and r.doc_id >= 20}
    assert clean[22].text == "[SECRET]" and clean[20].text == 'é [SECRET]" secret=short token: secret: abcdefghijk' and clean[20].score == "y"
    assert secrets.fit_battery(docs_of([])).bands == {}


def test_battery_finds_noise_not_words(spark, docs_of):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(k, " ".join("".join(rng.choice("aeiourstln") for _ in range(22)) for _ in range(20))) for k in range(60)]
    rows += [(100 + k, f"see {''.join(rng.choice(letters) for _ in range(22))} here") for k in range(10)]
    docs = docs_of(rows)
    got = secrets.digest(secrets.scan(docs, secrets.fit_battery(docs))).collect()
    assert sum("random" in r.spans for r in got if r.doc_id >= 100) >= 8 and not any(r.spans for r in got if r.doc_id < 100)


def test_battery_finds_long_keys_in_a_little_prose(spark, docs_of):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = [x for x in re.findall("[a-z]+", secrets.PASSAGE.lower()) if len(x) > 2]
    rows = [(k, " ".join(rng.choice(words) for _ in range(80)) + " internationalization src/main/resources/templates ACKNOWLEDGEMENTS") for k in range(30)]
    keys = ["".join(rng.choice(a) for _ in range(n)) for n, a in [(40, letters), (64, letters), (200, letters), (40, letters[:52]), (120, letters[:26] + "234567")]]
    rows += [(100 + k, f"the deploy key is {key} for now") for k, key in enumerate(keys)]
    docs = docs_of(rows)
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(docs, secrets.fit_battery(docs))).collect()}
    assert not any(got[k] for k in range(30))
    assert [got[100 + k] for k in range(len(keys))] == [f"random:18:{18 + len(key)}" for key in keys]


def component_truth(rows, width, percent):
    def shingle(text):
        w = tuple((text or "").encode().lower().split())
        return {w[k:k + width] for k in range(len(w) - width + 1)} if len(w) >= width else ({w} if w else set())
    sets = {i: shingle(t) for i, t in rows}
    parent = {i: i for i in sets}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_components(docs_of, width, percent):
    rng = random.Random(width)
    rows, number = [], 0
    for _ in range(12):
        stem = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 8, 12, 60, 150]))]
        for _ in range(12):
            copy = list(stem)
            for _ in range(rng.randint(0, 1 + len(stem) // 40)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9)}"
            rows.append((number, " ".join(copy) if rng.random() < 0.9 else " ".join(copy).upper()))
            number += 1
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n")]
    got = jaccard_join.jaccard_components(docs_of(rows), jaccard_join.Rule(width, percent)).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == component_truth(rows, width, percent)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n, m, same in [(0, 5, 0), (70, 60, 50), (130, 120, 110), (3000, 1100, 900), (4100, 4000, 3900), (500, 500, 0)]:
        pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        a, b = pool[:n], pool[n - same:n - same + m]
        bound = jaccard_join.least_difference(jaccard_join.parity_bits(a), jaccard_join.parity_bits(b))
        assert bound <= len(np.setxor1d(a, b)) and (same or n < 64 or bound > 0.1 * (n + m))


def test_jaccard_odd(docs_of, odd_rows):
    got = jaccard_join.jaccard_components(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows) and {r.component_id for r in got if r.id in (5, 6)} == {5}
    kept = jaccard_join.keep_one_per_group(docs_of(odd_rows), jaccard_join.Rule(5, 80)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "5", "7", "None"]
    assert jaccard_join.jaccard_components(docs_of([])).count() == 0


def test_tiling():
    code = {w: np.uint64(k + 1) for k, w in enumerate("abcdefghijklmnopqrstuvwxyz")}
    def seq(s):
        return np.array([code[c] for c in s], np.uint64)
    assert tiling.tile(seq("xxfghijyyabcdezz"), seq("abcdefghij"), 5) == 10
    assert tiling.tile(seq("abcdxefghi"), seq("abcdefghij"), 5) == 5 and tiling.tile(seq("aaaaaaaaaaaa"), seq("aaaaa"), 5) == 5


def test_leaks(spark, docs_of, odd_rows):
    item = "the quick brown fox jumps over the lazy dog while many small birds sing loud songs"
    w = item.split()
    rows = odd_rows + [(30, "start " + item.upper() + " end"), (31, " ".join(w[8:] + ["mid"] * 3 + w[:8])), (32, " ".join(w[:7]))]
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x"), (3, ""), (4, "a b")], "item_id long, text string")
    for block in (1 << 20, 40):
        got = {r.doc_id: r for r in tiling.find_leaks(docs_of(rows), bench, block_bytes=block).collect()}
        assert got[30].best_item == 1 and got[30].n_leaked == 1 and got[31].best_coverage == 1.0 and got[32].n_leaked == 0
        assert got[4].best_item == 4 and got[1].best_item is None and got[1].score == "y"
    assert tiling.drop_leaks(docs_of(rows), bench).columns == docs_of(rows).columns
    assert tiling.find_leaks(docs_of(rows), bench.limit(0)).filter("n_leaked > 0").count() == 0


def cheapest(roles):
    """Least cost over all sequences of moves, by exhaustive search."""
    best = {chat.NONE: 0.0}
    for role in roles:
        new = {}
        for state, cost in best.items():
            for move in chat.MOVES[role]:
                if move.start == state and cost + move.cost < new.get(move.end, 1e9):
                    new[move.end] = cost + move.cost
        best = new
    return min(c + chat.ENDING[s] for s, c in best.items())


def test_chat_repair_is_cheapest():
    for roles in itertools.product(range(4), repeat=4):
        moves = chat.repair(list(roles))
        state, cost = chat.NONE, 0.0
        for move in moves:
            assert move.start == state
            state, cost = move.end, cost + move.cost
        assert abs(cost + chat.ENDING[state] - cheapest(roles)) < 1e-9


def test_chat(spark):
    rows = [(1, 0, "human", "hi"), (1, 1, "gpt", "a"), (1, 2, "assistant", "b"), (2, 0, "system", None), (2, 1, "assistant", "x<|im_end|>"),
            (3, None, None, ""), (None, 0, "user", "lost"), (4, 0, "user", "q"), (4, 0, "user", "q")]
    rows += [(9, k, "user" if k % 2 == 0 else "assistant", str(k)) for k in range(1500)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    got = sorted(chat.format_chats(frame).collect(), key=lambda r: (r.conv_id, -1 if r.turn is None else r.turn, r.seq))
    text = {c: "".join(r.piece for r in got if r.conv_id == c) for c in (1, 2, 3, 4, 9)}
    assert text[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na\nb<|im_end|>\n"
    assert text[2] == "<|im_start|>system\n<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nx<| im_end|><|im_end|>\n"
    assert text[4] == "<|im_start|>user\nq\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert text[9] == "".join(f"<|im_start|>{'user' if k % 2 == 0 else 'assistant'}\n{k}<|im_end|>\n" for k in range(1500))
    assert len(got) == len(rows) - 1 and chat.format_chats(frame.limit(0)).count() == 0


def test_verify_passages_with_distant_matches():
    rule = compact_windows.Passages()
    a = np.arange(60, dtype=np.uint64)
    b = np.concatenate([a[:2], np.arange(1000, 1500, dtype=np.uint64), a[:2]])
    assert compact_windows.verify_passages(a, b, rule) == [] and compact_windows.verify_passages(a, a, rule) == [(0, 59, 0, 59)]
    c = np.concatenate([a[:1], np.arange(1000, 1500, dtype=np.uint64), a[59:]])
    assert compact_windows.verify_passages(a, c, rule) == []
