"""Reading CSV, JSON and text files into entries, and entries into records.

An entry is (source_file, source_ref, content_type, data VARIANT, metadata).  Rows that cannot
become an entry are not lost: every reader also returns a table of issues.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contentkit.functions.scalars import blank_to_null, int_prefix, split_list, strip, to_number
from contentkit.functions.variants import as_map, get_text, scalar_to_variant, type_of
from contentkit.operators.extract import TextTemplate, extract_fields, has_no_keys, pick_template
from contentkit.operators.plan import compute_once, explode_rows
from contentkit.operators.skew import dim_join
from contentkit.records import DEFAULT_CATEGORY, RECORD_COLUMNS, RECORD_SCHEMA_VERSION, is_category, record_id

ENTRY_COLUMNS = ["source_file", "source_ref", "content_type", "data", "metadata"]
ISSUE_COLUMNS = "source_file string, source_ref string, level string, code string, message string"
METADATA_FIELDS = ("source_book", "publisher", "author", "page_number", "tags", "notes", "import_date", "schema_version")
# Metadata columns of a CSV (compared without "_" and spaces) and metadata keys of JSON.
CSV_METADATA = ["sourcebook", "publisher", "author", "pagenumber", "page", "tags", "notes"]
CSV_TYPE_COLUMNS = ["type", "contenttype"]
JSON_METADATA = ["sourceBook", "publisher", "author", "pageNumber", "tags", "notes", "importDate", "schemaVersion"]
#: Bytes above which a JSON array is split into its elements while it is parsed: one VARIANT has a size limit, a file has none.
SPLIT_BYTES = 16 << 20
EXTENSIONS = {"csv": "*.[cC][sS][vV]", "json": "*.[jJ][sS][oO][nN]", "txt": "*.[tT][xX][tT]"}


def _metadata(found: Mapping[str, Column], given: Mapping[str, object] | None, parity: bool = False) -> Column:
    """Metadata struct: values found in the file over those given by the caller.

    A blank found value falls back to the given one, except in parity mode.
    """
    given = given or {}
    types = {"page_number": "bigint", "tags": "array<string>"}
    out = []
    for name in METADATA_FIELDS:
        kind = types.get(name, "string")
        value = given.get(name)
        base = (F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)).cast(kind)
        hit = found.get(name)
        if hit is None:
            hit = F.lit(None).cast(kind)
        elif not parity and name in given:
            if kind == "string":
                hit = blank_to_null(hit)
            elif kind == "bigint":
                hit = F.nullif(hit, F.lit(0).cast("bigint"))
            else:
                hit = F.when(F.size(hit) > 0, hit)
        out.append(F.coalesce(hit, base).alias(name))
    return F.struct(*out)


def _issues(df: DataFrame, level: str, code: str, message: Column, ref: Column) -> DataFrame:
    return df.select(
        "source_file", ref.alias("source_ref"), F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"))


def read_entries_csv(
    spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", default_type: str = DEFAULT_CATEGORY,
    source_meta: Mapping[str, object] | None = None, multi_line: bool = True, max_columns: int = 64,
    blank_overrides: bool = False, glob: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Entries and issues of CSV files, each with its own header row.

    ``multi_line=False`` lets Spark split large files (cells must then not contain newlines).
    Header names are trimmed and lower-cased; a repeated name means its last column; short rows are
    padded and extra cells dropped.  A header wider than *max_columns* raises instead of losing cells.
    Blank lines do not count in the row reference.
    """
    schema = ", ".join(f"c{i} string" for i in range(max_columns + 1))
    reader = spark.read.schema(schema).options(
        header="false", multiLine=str(multi_line).lower(), quote='"', escape='"', sep=delimiter, mode="PERMISSIVE",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", emptyValue="", nullValue="\u0000")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    cells = F.array(*[F.col(f"c{i}") for i in range(max_columns + 1)])
    raw = reader.csv(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"), cells.alias("_cells"))

    # One row per (file, block): where its rows start.  The first row of the first block is the header.
    spans = raw.groupBy("source_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_start"))
    in_file = Window.partitionBy("source_file").orderBy("_block")
    spans = spans.select(
        "source_file", "_block", "_start",
        F.coalesce(F.sum("_n").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.first("_start").over(in_file.rowsBetween(Window.unboundedPreceding, 0)).alias("_head_seq")).persist()
    starts = spans.filter(F.col("_start") == F.col("_head_seq")).select("source_file", F.col("_start").alias("_seq"))
    heads = dim_join(raw, starts, ["source_file", "_seq"], spread="_seq", how="left_semi").select(
        "source_file", F.col("_cells").alias("_head"))
    blocks = spans.join(heads, "source_file")
    wide = F.raise_error(F.lit(f"CSV header has more than {max_columns} columns; raise max_columns")).cast("string")
    header = F.transform("_head", lambda h: F.lower(strip(h)))
    header = F.when(F.get("_head", F.lit(max_columns)).isNotNull(), F.array(wide)).otherwise(header)
    plain = F.transform("_names", lambda n: F.regexp_replace(n, r"[_\s]", ""))
    meta = F.transform(plain, lambda n: F.when(n == "page", "pagenumber").when(n.isin(CSV_METADATA), n))

    def last_only(names: Column) -> Column:
        return F.transform(names, lambda n, i: F.when(
            ~F.array_contains(F.array_compact(F.slice(names, i + 2, F.lit(max_columns + 1))), n), n))

    blocks = blocks.withColumn("_names", header).withColumn("_meta", last_only(meta)).withColumn(
        "_data", last_only(F.transform("_names", lambda n: F.when(n != "", n)))
    ).select("source_file", "_block", "_start", "_before", "_data", "_meta")
    rows = dim_join(raw, blocks, ["source_file", "_block"], spread="_seq").withColumn(
        "_row", F.col("_before") + F.col("_seq") - F.col("_start") + 1).filter(F.col("_row") > 1)

    def cell_map(names: str) -> Column:
        pairs = F.transform(names, lambda n, i: F.struct(
            n.alias("key"), strip(F.coalesce(F.get("_cells", i), F.lit(""))).alias("value")))
        return F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull()))

    rows = compute_once(rows, _by_name=cell_map("_data"), _by_meta=cell_map("_meta")).filter(
        F.exists(F.map_values("_by_name"), lambda v: v != ""))

    def cell(name: str) -> Column:
        return F.try_element_at("_by_meta", F.lit(name))

    kind = F.coalesce(F.try_element_at("_by_name", F.lit("type")), F.try_element_at("_by_name", F.lit("contenttype")), F.lit(""))
    is_data = lambda k, v: ~k.isin(CSV_TYPE_COLUMNS) & ~F.regexp_replace(k, r"[_\s]", "").isin(CSV_METADATA)
    data = F.to_variant_object(F.transform_values(F.map_filter("_by_name", is_data), lambda k, v: scalar_to_variant(v)))
    found = {
        "source_book": cell("sourcebook"), "publisher": cell("publisher"), "author": cell("author"), "notes": cell("notes"),
        "page_number": F.when(cell("pagenumber").isNotNull(), F.coalesce(int_prefix(cell("pagenumber")), F.lit(0))),
        "tags": F.when(cell("tags").isNotNull(), split_list(cell("tags"), ",")),
    }
    ref = F.concat(F.lit("row:"), F.col("_row").cast("string"))
    entries = rows.select(
        "source_file", ref.alias("source_ref"), F.coalesce(blank_to_null(kind), F.lit(default_type)).alias("content_type"),
        data.alias("data"), _metadata(found, source_meta, blank_overrides).alias("metadata"))
    unnamed = rows.filter(F.coalesce(F.try_element_at("_by_name", F.lit("name")), F.lit("")) == "")
    issues = _issues(unnamed, "warning", "MISSING_NAME", F.concat(
        F.lit("Row "), F.col("_row").cast("string"), F.lit(" has no 'name' column.")), ref)
    return entries, issues


def coerce_scalars(col: Column) -> Column:
    """Text cells to typed values."""
    return scalar_to_variant(col)


def read_entries_json(
    spark: SparkSession, path: str | Sequence[str], root_path: str | None = None, default_type: str = DEFAULT_CATEGORY,
    source_meta: Mapping[str, object] | None = None, lines: bool = False, glob: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """S3: entries and issues of JSON files; with *lines* each line is one document (and splits)."""
    texts = spark.read.text(path, wholetext=not lines, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("_text"))
    return parse_json_entries(texts, root_path, default_type, source_meta)


def parse_json_entries(
    texts: DataFrame, root_path: str | None = None, default_type: str = DEFAULT_CATEGORY,
    source_meta: Mapping[str, object] | None = None, text: str = "_text",
) -> tuple[DataFrame, DataFrame]:
    """S3 over a table of JSON texts (source_file and one text column).

    A large array (at the root or at *root_path*) is parsed element by element, so only an element has to fit into one
    VARIANT.  A large text that still has none is reported as ``JSON_TOO_LARGE`` if it is closed as it was opened.
    """
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    large = F.octet_length(text) > SPLIT_BYTES
    path_keys = root_path.split(".") if root_path else []
    outer = F.when(F.rlike(text, F.lit(r"\A\s*\[")), "[]").when(F.rlike(text, F.lit(r"\A\s*\{")), "{}").otherwise("")
    closed = F.when(F.rlike(F.right(text, F.lit(64)), F.lit(r"\]\s*\z")), "[]").when(
        F.rlike(F.right(text, F.lit(64)), F.lit(r"\}\s*\z")), "{}").otherwise("-")
    shape = "array<variant>"
    for key in reversed(path_keys):
        quoted = key.replace("`", "``")
        shape = f"struct<`{quoted}`:{shape}>"
    listed = F.from_json(text, shape)
    for key in path_keys:
        listed = listed.getField(key)
    split = F.when(large & (outer == closed) & (outer == ("{}" if path_keys else "[]")), listed)
    docs = compute_once(texts, _list=split)
    docs = compute_once(docs, _doc=F.when(F.col("_list").isNull() & ~blank, F.try_parse_json(text)))
    found_any = F.col("_doc").isNotNull() | F.col("_list").isNotNull()
    whole = F.col("_doc")
    if root_path:
        whole = F.try_variant_get("_doc", "$" + "".join(f'["{p}"]' for p in path_keys), "variant")
    docs = compute_once(docs, _root=whole)
    kind_of_root = F.when(F.col("_list").isNotNull(), "array").otherwise(type_of(F.col("_root")))

    def problem(level: str, code: str, message: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"))

    # Every text is parsed once: what is wrong with it as a whole goes along as one row without an item.
    docs = docs.withColumn("_kind", kind_of_root).withColumn("_problem", (
        F.when(blank, problem("error", "JSON_PARSE_ERROR", F.lit("Failed to parse JSON: empty input.")))
        .when(~found_any & large & (outer == closed), problem("error", "JSON_TOO_LARGE", F.lit(
            "JSON is malformed or holds a value that is too large; use an array of smaller elements or JSON lines.")))
        .when(~found_any, problem("error", "JSON_PARSE_ERROR", F.lit("Failed to parse JSON.")))
        .when(F.col("_list").isNull() & F.col("_root").isNull(), problem(
            "error", "JSON_ROOT_PATH_ERROR", F.lit(f"Root path '{root_path}' could not be resolved.")))
        .when(~F.coalesce(F.col("_kind").isin("array", "object"), F.lit(False)), problem(
            "error", "JSON_NO_ENTRIES", F.lit("JSON root is not an array or object.")))))
    listed = F.when(F.col("_problem").isNotNull(), F.array(F.lit(None).cast("variant"))).when(
        F.col("_list").isNotNull(), F.col("_list")).when(
        F.col("_kind") == "array", F.try_variant_get("_root", "$", "array<variant>")).otherwise(F.array("_root"))
    elements = explode_rows(docs, listed, "_item", position="_i").select("source_file", "_problem", "_i", "_item")
    ref = F.concat(F.lit("index:"), F.col("_i").cast("string"))
    is_object = F.coalesce(type_of(F.col("_item")) == "object", F.lit(False))
    objects = elements.filter(F.col("_problem").isNull() & is_object).withColumn("_map", as_map(F.col("_item")))

    def exact(key: str, kind: str) -> Column:
        return F.try_variant_get("_item", f"$.{key}", kind)

    type_value = F.coalesce(exact("type", "variant"), exact("contentType", "variant"))
    kind = F.when(type_of(type_value) == "string", blank_to_null(type_value.try_cast("string")))
    data = F.to_variant_object(F.map_filter("_map", lambda k, v: ~k.isin([*JSON_METADATA, "type", "contentType"])))
    found = {
        "source_book": exact("sourceBook", "string"), "publisher": exact("publisher", "string"), "author": exact("author", "string"),
        "page_number": exact("pageNumber", "double").cast("bigint"), "notes": exact("notes", "string"),
        "tags": exact("tags", "array<string>"), "import_date": exact("importDate", "string"),
        "schema_version": exact("schemaVersion", "string"),
    }
    entries = objects.select(
        "source_file", ref.alias("source_ref"), F.coalesce(kind, F.lit(default_type)).alias("content_type"),
        data.alias("data"), _metadata(found, source_meta).alias("metadata"))
    at = F.concat(F.lit("Entry at index "), F.col("_i").cast("string"))
    judged = compute_once(elements, _issue=F.when(F.col("_problem").isNotNull(), F.col("_problem")).when(
        ~is_object, problem("warning", "INVALID_ENTRY", F.concat(at, F.lit(" is not an object; skipping.")))).when(
        F.coalesce(exact("name", "string"), F.lit("")) == "",
        problem("warning", "MISSING_NAME", F.concat(at, F.lit(" has no 'name' field.")))))
    issues = judged.filter(F.col("_issue").isNotNull()).select(
        "source_file", F.when(F.col("_problem").isNull(), ref).alias("source_ref"), "_issue.level", "_issue.code", "_issue.message")
    return entries, issues


def read_text_blocks(
    texts: DataFrame, templates: Sequence[TextTemplate], template_id: str | None = None,
    category: str = DEFAULT_CATEGORY, source_meta: Mapping[str, object] | None = None, text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Blocks separated by blank lines, each extracted by a template.

    *texts* holds source_file and one text column.  A block nothing matches is reported, not kept.
    """
    chosen, notes = pick_template(templates, template_id, category)
    no_ref = F.lit(None).cast("string")
    empty = _issues(texts.filter(strip(F.coalesce(text, F.lit(""))) == ""), "error", "EMPTY_INPUT", F.lit("Text input is empty."), no_ref)
    for level, code, message in notes:
        empty = empty.unionByName(_issues(texts, level, code, F.lit(message), no_ref))
    if chosen is None:
        spark = texts.sparkSession
        shape = "source_file string, source_ref string, content_type string, data variant, metadata " + _metadata_type()
        return spark.createDataFrame([], shape), empty
    parts = F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda b: b != "")
    blocks = explode_rows(texts.select("source_file", text), parts, "_block", position="_i").drop(text)
    ref = F.concat(F.lit("block:"), F.col("_i").cast("string"))
    filled = extract_fields(blocks, chosen.rules, "_block", "data")
    lost = _issues(filled.filter(has_no_keys(F.col("data"))), "warning", "NO_DATA_EXTRACTED", F.concat(
        F.lit("Could not extract any data from block "), F.col("_i").cast("string"), F.lit(".")), ref)
    entries = filled.filter(~has_no_keys(F.col("data"))).select(
        "source_file", ref.alias("source_ref"), F.lit(chosen.category).alias("content_type"), "data",
        _metadata({}, source_meta).alias("metadata"))
    return entries, empty.unionByName(lost)


def _metadata_type() -> str:
    kinds = {"page_number": "bigint", "tags": "array<string>"}
    return "struct<" + ",".join(f"{n}:{kinds.get(n, 'string')}" for n in METADATA_FIELDS) + ">"


def read_by_extension(
    spark: SparkSession, folder: str, templates: Sequence[TextTemplate], default_type: str = DEFAULT_CATEGORY,
    source_meta: Mapping[str, object] | None = None, text_category: str | None = None,
    lines: bool = False, root_path: str | None = None, multi_line: bool = True, max_columns: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Every .csv, .json and .txt file of a folder through its reader; adds ``import_method``.

    *lines* and *root_path* go to the JSON reader, *multi_line* and *max_columns* to the CSV reader.
    """
    csv, csv_issues = read_entries_csv(
        spark, folder, default_type=default_type, source_meta=source_meta, glob=EXTENSIONS["csv"], multi_line=multi_line, max_columns=max_columns)
    js, js_issues = read_entries_json(
        spark, folder, root_path, default_type=default_type, source_meta=source_meta, glob=EXTENSIONS["json"], lines=lines)
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter=EXTENSIONS["txt"]).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    txt, txt_issues = read_text_blocks(texts, templates, category=text_category or default_type, source_meta=source_meta)
    entries = csv.withColumn("import_method", F.lit("csv")).unionByName(
        js.withColumn("import_method", F.lit("json"))).unionByName(txt.withColumn("import_method", F.lit("txt")))
    return entries, csv_issues.unionByName(js_issues).unionByName(txt_issues)


def entries_to_drafts(entries: DataFrame, global_meta: Mapping[str, object] | None = None) -> DataFrame:
    """S6, first half: drafts ready for validation; file metadata over the caller's."""
    given = global_meta or {}
    data = F.col("data")
    tags = given.get("tags", [])
    return entries.withColumns({
        "name": F.coalesce(F.try_variant_get(data, "$.name", "string"), F.try_variant_get(data, "$.Name", "string")),
        "category": F.coalesce(
            F.try_variant_get(data, "$.category", "string"), F.try_variant_get(data, "$.type", "string"), F.col("content_type")),
        "source_book": F.coalesce("metadata.source_book", F.lit(given.get("source_book"))),
        "publisher": F.coalesce("metadata.publisher", F.lit(given.get("publisher"))),
        "author": F.coalesce("metadata.author", F.lit(given.get("author"))),
        "page_number": F.coalesce(
            F.col("metadata.page_number").cast("double"), to_number(get_text(data, "pageNumber")),
            F.lit(given.get("page_number")).cast("double")),
        "tags": F.coalesce("metadata.tags", F.array(*[F.lit(t) for t in tags]).cast("array<string>")),
        "notes": F.coalesce("metadata.notes", F.lit(given.get("notes"))),
        "raw_content": data,
    })


def drafts_to_records(
    drafts: DataFrame, run_time: str, default_category: str = DEFAULT_CATEGORY, import_method: str | None = None
) -> DataFrame:
    """S6, second half: catalog records with deterministic ids; needs ``ord`` on the drafts."""
    method = F.lit(import_method) if import_method else F.col("import_method")
    category = F.when(is_category(F.col("category")), F.col("category")).otherwise(default_category)
    return drafts.select(
        F.col("ord"),
        record_id(F.coalesce("source_file", F.lit("")), F.coalesce("source_ref", F.lit("")), F.coalesce("name", F.lit(""))).alias("id"),
        F.coalesce("name", F.lit("")).alias("name"),
        category.alias("category"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("source_book", "publisher", "author")],
        F.coalesce(F.col("page_number").cast("bigint"), F.lit(0)).alias("page_number"),
        "tags",
        F.coalesce("notes", F.lit("")).alias("notes"),
        "raw_content",
        F.to_timestamp(F.lit(run_time)).alias("imported_date"),
        method.alias("import_method"),
        F.lit(RECORD_SCHEMA_VERSION).alias("schema_version"),
    ).select(*RECORD_COLUMNS)


def entries_to_records(
    entries: DataFrame, run_time: str, global_meta: Mapping[str, object] | None = None,
    import_method: str | None = None, default_category: str = DEFAULT_CATEGORY,
) -> DataFrame:
    """Entries straight to records.

    ``ord`` is the read order unless the entries already carry one; write the entries to a table
    first when they come out of a shuffle.
    """
    drafts = entries_to_drafts(entries, global_meta)
    if "ord" not in entries.columns:
        drafts = drafts.withColumn("ord", F.monotonically_increasing_id())
    return drafts_to_records(drafts, run_time, default_category, import_method)

