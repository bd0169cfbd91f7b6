"""Page text: assembly, cleanup, quality, OCR merge, segmentation, document metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentkit.functions.scalars import WHITESPACE, bind, blank_to_null, strip, title_case
from contentkit.operators.plan import compute_once, explode_rows
from contentkit.operators.skew import one_per_key

# ---------------------------------------------------------------------------------------------
# Thresholds, patterns and word lists that decide results.
# ---------------------------------------------------------------------------------------------
LINE_GAP = 2.0
MIN_PAGE_CHARS = 20
MIN_BLOCK_CHARS = 50
HEADER_PATTERN = r"^[A-Z0-9\s'’\-\(\):]+$"
HEADER_MIN, HEADER_MAX = 3, 60
NOT_HEADER_PATTERN = r"(?i)^(?:EAC|KAC|CR|NPC|GM|DC|HP|PC)$"
STAT_LINE_PATTERN = r"(?i)^(?:Type|Level|CR|Category|Class|School|Hit\s*Points|HP|EAC|KAC|Fort|Ref|Will)\s*:"
PAGE_NUMBER_PATTERN = r"(?i)^(?:[—\-–]?\s*\d+\s*[—\-–]?|page\s+\d+)$"
OCR_WORD_FIXES = [
    (r"\bSir\b", "Str"), (r"\bOex\b", "Dex"), (r"\bCon\.\b", "Con"), (r"\blnt\b", "Int"),
    (r"\bWls\b", "Wis"), (r"\bCha\.\b", "Cha"), (r"(?i)\bCR(\d)", "CR $1"), (r"(?i)\bHP(\d)", "HP $1"),
]
UNHYPHENATED_WORDS = [
    "weapon", "ability", "attack", "damage", "special", "defense", "creature", "standard", "action", "movement",
    "monster", "character", "science", "fantasy", "shield", "armor", "feat", "skill", "spell", "level", "range",
    "speed", "bonus", "penalty", "round",
]
PUBLISHERS = [
    ("(?i)paizo", "Paizo"), ("(?i)starjammer", "Starjammer"), (r"(?i)rogue\s*genius", "Rogue Genius Games"),
    (r"(?i)legendary\s*games", "Legendary Games"), (r"(?i)fat\s*goblin", "Fat Goblin Games"),
    ("(?i)dreamscarred", "Dreamscarred Press"),
]
UNKNOWN_PUBLISHER = "Unknown Publisher"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def assemble_page_text(items: DataFrame) -> DataFrame:
    """Text of each page from its positioned items (doc_id, page_number, seq, str, y).

    An item starts a new line when its y differs by more than 2 from the last known y; otherwise it
    is separated by one space unless the text already ends with a space or newline.  An empty item
    leaves the text empty or ending in white space, so the separator depends on the previous item
    alone and one window (sharing the shuffle of the aggregation) is exact.
    """
    page = Window.partitionBy("doc_id", "page_number").orderBy("seq")
    text = F.coalesce("str", F.lit(""))
    last_y = F.last("y", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag(text).over(page)
    moved = F.coalesce(F.abs(F.col("y") - last_y) > LINE_GAP, F.lit(False))
    open_end = F.coalesce((before != "") & ~F.right(before, F.lit(1)).isin(" ", "\n"), F.lit(False))
    piece = F.concat(F.when(moved, "\n").when(open_end, " ").otherwise(""), text)
    pages = (
        items.withColumn("_piece", piece)
        .groupBy("doc_id", "page_number")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "_piece"))).alias("_pieces"))
    )
    raw = F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "")
    out = strip(F.regexp_replace(F.regexp_replace(raw, "[ \t]+", " "), "\n{3,}", "\n\n"))
    return with_text_stats(pages.select("doc_id", "page_number", out.alias("text")))


def with_text_stats(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"text_length": F.length("text"), "word_count": word_count(F.col("text"))})


def join_hyphens(text: Column, mode: str = "sane") -> Column:
    """De-hyphenation at line ends.

    ``sane`` joins "exam-\\nple" and turns a bare newline inside a sentence into a space.  ``parity``
    glues words across a bare newline and drops the hyphen only when the last character before it
    plus the next word form one of the listed words.
    """
    if mode == "sane":
        joined = F.regexp_replace(text, r"(\w)-\r?\n([a-z]\w*)", "$1$2")
        return F.regexp_replace(joined, r"(\w)\r?\n([a-z]\w*)", "$1 $2")
    # A hyphen is dropped for listed words, kept for others; a bare newline is removed.
    dropped = text
    for word in UNHYPHENATED_WORDS:
        dropped = F.regexp_replace(dropped, f"((?i:{word[0]}))-\\r?\\n({word[1:]})(?!\\w)", "$1$2")
    kept = F.regexp_replace(dropped, r"(\w)-\r?\n([a-z]\w*)", "$1-$2")
    return F.regexp_replace(kept, r"(\w)\r?\n([a-z]\w*)", "$1$2")


def clean_ocr_text(text: Column, mode: str = "sane") -> Column:
    """The ordered cleanup passes."""
    out = join_hyphens(text, mode)
    out = F.regexp_replace(out, "\r\n", "\n")
    out = F.regexp_replace(out, " {3,}", "  ")
    lines = F.filter(F.split(out, "\n"), lambda ln: ~strip(ln).rlike(PAGE_NUMBER_PATTERN))
    out = F.array_join(lines, "\n")
    out = reduce(lambda c, fix: F.regexp_replace(c, fix[0], fix[1]), OCR_WORD_FIXES, out)
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def text_quality(text: Column) -> Column:
    """0..1; full credit for 50-95 % alphanumerics and a mean word length of 3-8."""
    joined = F.regexp_replace(strip(text), r"\s+", " ")
    packed = F.length(F.replace(joined, F.lit(" "), F.lit("")))
    facts = F.struct(
        (F.length(F.regexp_replace(text, "[^a-zA-Z0-9]+", "")) / F.length(text)).alias("alnum"),
        (packed / (F.length(joined) - packed + 1)).alias("mean"),
    )

    def score(f: Column) -> Column:
        alnum, mean = f["alnum"], f["mean"]
        length_score = (
            F.when(mean < 3, mean / 3).when(mean > 8, F.greatest(F.lit(0.0), 1 - (mean - 8) / 10)).otherwise(1.0)
        )
        ratio_score = (
            F.when(alnum < 0.5, alnum / 0.5)
            .when(alnum > 0.95, F.greatest(F.lit(0.0), 1 - (alnum - 0.95) / 0.05))
            .otherwise(1.0)
        )
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio_score * length_score))

    blank = text.isNull() | (strip(text) == "")
    return F.when(blank, F.lit(0.0)).otherwise(bind(facts, score))


def merge_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """T4 (J8): recognised text replaces the page text unless it is blank.

    Of several results for one page the most confident that is not blank counts, then the greater text.
    """
    found = ocr.select("doc_id", "page_number", strip(F.col("text")).alias("_text"), F.col("confidence").alias("_conf"))
    found = one_per_key(found.withColumn("_full", F.coalesce(F.col("_text") != "", F.lit(False))), ["doc_id", "page_number"], ["_full", "_conf", "_text"])
    joined = pages.join(found, ["doc_id", "page_number"], "left")
    hit = F.coalesce(F.col("_text") != "", F.lit(False))
    text = F.when(hit, F.col("_text")).otherwise(F.col("text"))
    kept = [c for c in pages.columns if c not in ("text", "text_length", "word_count", "was_ocr", "ocr_confidence")]
    return joined.select(
        *kept,
        text.alias("text"),
        F.length(text).alias("text_length"),
        word_count(text).alias("word_count"),
        (hit | (F.coalesce("was_ocr", F.lit(False)) if "was_ocr" in pages.columns else F.lit(False))).alias("was_ocr"),
        F.when(hit, F.col("_conf")).otherwise(
            F.col("ocr_confidence") if "ocr_confidence" in pages.columns else F.lit(None).cast("double")
        ).alias("ocr_confidence"),
    )


def _segments(pages: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """Pages as arrays of lines, and the array of all their runs of lines (start_line, first, last, kept)."""
    numbered = pages.filter(F.length("text") >= MIN_PAGE_CHARS).select(*keys, F.split("text", "\n").alias("_lines"))
    numbered = compute_once(numbered, _trim=F.transform("_lines", strip))

    def describe(line: Column, i: Column) -> Column:
        trimmed = F.col("_trim")[i]
        lead = F.length(line) - F.length(F.ltrim(line, F.lit(WHITESPACE)))
        header = (
            F.length(trimmed).between(HEADER_MIN, HEADER_MAX)
            & trimmed.rlike(HEADER_PATTERN)
            & ~trimmed.rlike(NOT_HEADER_PATTERN)
        )
        before_stat = F.coalesce(F.get("_trim", i + 1).rlike(STAT_LINE_PATTERN), F.lit(False))
        return F.struct(
            F.length(trimmed).alias("chars"), F.length(line).alias("width"), lead.alias("lead"),
            (header | before_stat).alias("opens"),
        )

    numbered = compute_once(numbered, _marks=F.transform("_lines", describe))
    none = F.lit(-1)
    start = F.struct(
        F.lit(0).alias("i"), F.lit(1).alias("start_line"), none.alias("first"), none.alias("last"),
        F.lit(0).alias("size"), F.lit(0).alias("trail"),
        F.array().cast("array<struct<start_line:int,first:int,last:int,kept:boolean>>").alias("blocks"),
    )

    # A kept line is never blank, so a block's trimmed length is its joined length less the leading
    # blanks of its first line and the trailing blanks of its last line.
    def closed(acc: Column) -> Column:
        long = acc["size"] - acc["trail"] >= MIN_BLOCK_CHARS
        return F.concat(acc["blocks"], F.array(F.struct(
            acc["start_line"].alias("start_line"), acc["first"].alias("first"), acc["last"].alias("last"), long.alias("kept"))))

    def step(acc: Column, m: Column) -> Column:
        blank = m["chars"] == 0
        has = acc["first"] >= 0
        flush = has & F.when(blank, acc["size"] - acc["trail"] >= MIN_BLOCK_CHARS).otherwise(m["opens"])
        empty = flush | ~has
        grown = F.when(empty, m["width"] - m["lead"]).otherwise(acc["size"] + 1 + m["width"])
        kept_first = F.when(empty, none).otherwise(acc["first"])
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(flush, acc["i"] + 1).otherwise(acc["start_line"]).alias("start_line"),
            F.when(blank, kept_first).when(empty, acc["i"]).otherwise(acc["first"]).alias("first"),
            F.when(blank, acc["last"]).otherwise(acc["i"]).alias("last"),
            F.when(~blank, grown).when(empty, 0).otherwise(acc["size"]).alias("size"),
            F.when(~blank, m["width"] - m["lead"] - m["chars"]).when(empty, 0).otherwise(acc["trail"]).alias("trail"),
            F.when(flush, closed(acc)).otherwise(acc["blocks"]).alias("blocks"),
        )

    blocks = F.aggregate(
        "_marks", start, step, lambda acc: F.when(acc["first"] >= 0, closed(acc)).otherwise(acc["blocks"])
    )
    return numbered.select(*keys, "_lines", "_marks"), blocks


def _segment_text() -> Column:
    span = F.slice("_lines", F.col("_b.first") + 1, F.col("_b.last") - F.col("_b.first") + 1)
    return strip(F.array_join(F.filter(span, lambda ln: strip(ln) != ""), "\n"))


def segment_pages(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """T5: split each page into content blocks of at least 50 characters.

    A blank line closes the block only once it holds 50 trimmed characters; a header line, or a line
    followed by a stat line, closes any non-empty block; shorter blocks are left to ``segment_rejects``.  The rule is
    sequential, so it is one fold per page over line descriptors.  The state holds line numbers and
    lengths only; the text is cut out once per finished block.
    """
    keys = keys or ["doc_id", "page_number"]
    numbered, blocks = _segments(pages, keys)
    return explode_rows(numbered, F.filter(blocks, lambda b: b["kept"]), "_b", position="block_no").select(
        *keys, "block_no", F.col("_b.start_line").alias("start_line"), _segment_text().alias("text")
    )


def segment_rejects(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """T5: the text that ``segment_pages`` puts into no block: (keys, start_line, text, reason).

    The reason is SHORT_BLOCK, or SHORT_PAGE for a page under 20 characters.  Blocks and rejects together hold every line that
    is not blank, once; pages without any have neither.
    """
    keys = keys or ["doc_id", "page_number"]
    numbered, blocks = _segments(pages, keys)
    short = explode_rows(numbered, F.filter(blocks, lambda b: ~b["kept"]), "_b", position="_no").select(
        *keys, F.col("_b.start_line").alias("start_line"), _segment_text().alias("text"), F.lit("SHORT_BLOCK").alias("reason"))
    small = pages.filter((F.length("text") < MIN_PAGE_CHARS) & (strip(F.col("text")) != "")).select(
        *keys, F.lit(1).alias("start_line"), strip(F.col("text")).alias("text"), F.lit("SHORT_PAGE").alias("reason"))
    return short.unionByName(small)


def pdf_date(c: Column) -> Column:
    """"D:YYYYMMDDHHmmSS.." to an ISO time read as UTC; anything else is kept as it is."""
    digits = F.regexp_extract(c, r"^D:(\d{14})", 1)
    stamp = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'.000Z'"), c)


def doc_metadata(info: DataFrame) -> DataFrame:
    """Normalise document info (file_name, title, author, subject, creator, producer, creation_date, mod_date)."""
    texts = {c: blank_to_null(strip(F.col(c))) for c in ("title", "author", "subject", "creator", "producer")}
    out = info.withColumns(texts)
    bare = F.regexp_replace("file_name", r"(?i)\.pdf$", "")
    stem = strip(F.regexp_replace(bare, "[-_]", " "))
    book = F.when(
        (F.length("title") > 3) & (F.length("title") >= F.length(stem)), F.col("title")
    ).otherwise(title_case(stem))
    haystack = F.concat(F.coalesce("author", F.lit("")), F.lit(" "), F.coalesce("producer", F.lit("")))
    publisher = F.lit(UNKNOWN_PUBLISHER)
    for pattern, name in reversed(PUBLISHERS):
        publisher = F.when(haystack.rlike(pattern), name).otherwise(publisher)
    return out.withColumns({
        "creation_date": pdf_date(F.col("creation_date")),
        "mod_date": pdf_date(F.col("mod_date")),
        "guessed_source_book": book,
        "guessed_publisher": publisher,
    })

