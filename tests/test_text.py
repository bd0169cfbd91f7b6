import random
import re

from pyspark.sql import functions as F

from contentkit.operators import text as T


def segments(text):
    """The line-by-line rule, as a check."""
    if len(text) < 20:
        return []
    out, cur, start = [], [], 1
    lines = text.split("\n")

    def flush(i):
        nonlocal cur, start
        if cur:
            body = "\n".join(cur).strip()
            if len(body) >= 50:
                out.append((start, body))
        cur, start = [], i + 1

    for i, line in enumerate(lines):
        t = line.strip()
        if not t:
            if cur and len("\n".join(cur).strip()) >= 50:
                flush(i)
            continue
        header = re.match(T.HEADER_PATTERN, t) and 3 <= len(t) <= 60 and not re.match(T.NOT_HEADER_PATTERN, t)
        nxt = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if (header or re.match(T.STAT_LINE_PATTERN, nxt)) and cur:
            flush(i)
        cur.append(line)
    flush(len(lines))
    return out


def test_segmenting_equals_the_line_rule(spark):
    rnd = random.Random(5)
    pool = ["", "  ", "HEADER ONE", "EAC", "Level: 3", "a short line", "  an indented line of some length here  ",
            "a much longer line that alone passes the fifty character limit", "HP: 4", "CR", "x"]
    pages = [(i, 1, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14)))) for i in range(150)]
    df = spark.createDataFrame(pages, "doc_id int, page_number int, text string")
    got = {}
    for r in T.segment_pages(df).orderBy("doc_id", "block_no").collect():
        got.setdefault(r.doc_id, []).append((r.start_line, r.text))
    for i, _, text in pages:
        assert got.get(i, []) == segments(text), text


def test_page_assembly_equals_the_item_rule(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for doc in range(60):
        text, last = "", None
        for seq in range(rnd.randint(1, 9)):
            s, y = rnd.choice(["", "ab", "c ", "d\n", "  "]), rnd.choice([None, 10.0, 11.0, 20.0])
            rows.append((doc, 1, seq, s, y))
            if last is not None and y is not None and abs(y - last) > 2:
                text += "\n"
            elif text and not text.endswith((" ", "\n")):
                text += " "
            text += s
            last = y if y is not None else last
        want[doc] = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    df = spark.createDataFrame(rows, "doc_id int, page_number int, seq int, str string, y double")
    assert {r.doc_id: r.text for r in T.assemble_page_text(df).collect()} == want


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


def test_cleaning(spark):
    raw = "Page 3\nThe exam-\nple is\nlong.    Wide\r\n— 12 —\nSir 4 CR5 hp7\n\n\n\nend"
    assert one(spark, T.clean_ocr_text, raw) == "The example is long.  Wide\nStr 4 CR 5 HP 7\n\nend"
    assert one(spark, lambda c: T.clean_ocr_text(c, "parity"), "foo\nbar exam-\nple") == "foobar exam-ple"


def test_quality_bounds(spark):
    assert one(spark, T.text_quality, "   ") == 0
    assert one(spark, T.text_quality, "some good plain words, here.") == 1
    assert one(spark, T.text_quality, "!!!! ???? ....") == 0
    assert 0 < one(spark, T.text_quality, "a b c d e") < 1


def test_ocr_merge_keeps_text_for_blank_results(spark):
    pages = spark.createDataFrame([(1, 1, "old"), (1, 2, "keep")], "doc_id int, page_number int, text string")
    ocr = spark.createDataFrame([(1, 1, " new text ", 88.0), (1, 2, "  ", 10.0)], "doc_id int, page_number int, text string, confidence double")
    rows = {r.page_number: (r.text, r.was_ocr, r.ocr_confidence, r.word_count) for r in T.merge_ocr(pages, ocr).collect()}
    assert rows == {1: ("new text", True, 88.0, 2), 2: ("keep", False, None, 1)}


def test_pdf_dates(spark):
    assert one(spark, T.pdf_date, "D:20200304050607+02'00'") == "2020-03-04T05:06:07.000Z"
    assert one(spark, T.pdf_date, "D:20209904050607") == "D:20209904050607"
    assert one(spark, T.pdf_date, "spring 2020") == "spring 2020"


def test_blocks_and_rejects_hold_every_line(spark):
    import random
    rng = random.Random(8)
    lines = ["HEADER LINE", "Type: weapon", "short", "", "  ", "x" * 60, "a line of some forty characters, more or less", "HP", "Level : 3", "\u00a0 odd"]
    pages = [(k, 1, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for k in range(120)] + [(500, 1, None), (501, 1, " tiny \n x"), (502, 1, "")]
    frame = spark.createDataFrame(pages, "doc_id int, page_number int, text string")
    got = {}
    for r in T.segment_pages(frame).collect():
        assert len(r.text) >= 50
        got.setdefault(r.doc_id, []).append(r.text)
    for r in T.segment_rejects(frame).collect():
        assert len(r.text) < 50 and (r.reason == "SHORT_PAGE") == (len(pages[r.doc_id][2] if r.doc_id < 500 else "") < 20)
        got.setdefault(r.doc_id, []).append(r.text)
    for doc, _, text in pages:
        want = sorted(x.strip() for x in (text or "").split("\n") if x.strip())
        assert sorted(x.strip() for t in got.get(doc, []) for x in t.split("\n") if x.strip()) == want, text
