"""Filters, lookups, edits, facets and sorts over the catalog."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.functions.scalars import all_of
from contentkit.operators.skew import least
from contentkit.records import category_dim, name_key

SORT_FIELDS = {
    "name": "name",
    "category": "category",
    "sourceBook": "source_book",
    "publisher": "publisher",
    "importedDate": "imported_date",
    "contentType": "category",
    "subtype": "subtype",
}
FACET_FIELDS = {"publisher": "publisher", "sourceBook": "source_book", "importMethod": "import_method", "tags": "tags"}


@dataclass(frozen=True)
class CatalogFilter:
    """Conjunction of conditions; an empty condition is inactive."""

    search_text: str = ""
    categories: list[str] = field(default_factory=list)
    publishers: list[str] = field(default_factory=list)
    source_books: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    import_method: str = ""

    def conditions(self, search_columns: Column) -> list[Column]:
        found = []
        if self.search_text:
            found.append(search_columns)
        for column, wanted in (
            ("category", self.categories), ("publisher", self.publishers), ("source_book", self.source_books)
        ):
            if wanted:
                found.append(F.col(column).isin(list(wanted)))
        if self.tags:
            found.append(has_all_tags(self.tags))
        if self.import_method:
            found.append(F.col("import_method") == self.import_method)
        return found


def contains_text(c: Column, needle: str) -> Column:
    return F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))


def search_text(needle: str) -> Column:
    """case-insensitive substring over name, tags, notes and source book."""
    return (
        contains_text(F.col("name"), needle)
        | F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: contains_text(t, needle))
        | contains_text(F.col("notes"), needle)
        | contains_text(F.col("source_book"), needle)
    )


def has_all_tags(tags: list[str]) -> Column:
    """the record holds every tag, exact match."""
    return all_of(*[F.array_contains("tags", t) for t in tags])


def apply_filter(records: DataFrame, flt: CatalogFilter) -> DataFrame:
    """F1-F5 without the sort."""
    conds = flt.conditions(search_text(flt.search_text)) if flt else []
    return records.filter(all_of(*conds)) if conds else records


def catalog_query(
    records: DataFrame, flt: CatalogFilter | None = None, sort: str = "name", ascending: bool = True
) -> DataFrame:
    """filter, then sort (by name unless told otherwise)."""
    return sort_records(apply_filter(records, flt) if flt else records, sort, ascending)


def browse_filter(documents: DataFrame, flt: CatalogFilter) -> DataFrame:
    """published documents; the text search looks at the name only."""
    conds = CatalogFilter(
        flt.search_text, flt.categories, flt.publishers, flt.source_books, flt.tags
    ).conditions(contains_text(F.col("name"), flt.search_text))
    return documents.filter(all_of(*conds)) if conds else documents


def sort_records(df: DataFrame, field_name: str = "name", ascending: bool = True, tiebreak: str = "id") -> DataFrame:
    """O1, O2: locale-aware order of one text field with an id tiebreak."""
    column = F.col(SORT_FIELDS[field_name])
    if SORT_FIELDS[field_name] != "imported_date":
        column = F.collate(column, "UNICODE")
    return df.orderBy(column.asc() if ascending else column.desc(), F.col(tiebreak))


def sort_templates(templates: DataFrame) -> DataFrame:
    """O3: subtype, then name."""
    return templates.orderBy(F.collate("subtype", "UNICODE"), F.collate("name", "UNICODE"), F.col("uuid"))


def recent_runs(runs: DataFrame, k: int = 50, order: str = "ts", tiebreak: str = "run_id") -> DataFrame:
    """The *k* newest runs."""
    return runs.orderBy(F.col(order).desc(), F.col(tiebreak).desc()).limit(k)


def lookup_many(records: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """bulk get by id or by name; of equal names the first inserted record is returned.

    *keys* holds one column ``key``.  Names compare case-insensitively.
    """
    if by == "id":
        return records.join(keys.select(F.col("key").alias("id")).distinct(), "id", "left_semi")
    wanted = keys.select(F.lower("key").alias("_k")).distinct()
    first = (
        records.groupBy(name_key().alias("_k")).agg(F.min("ord").alias("ord")).join(wanted, "_k", "left_semi").select("ord")
    )
    return records.join(first, "ord", "left_semi")


def names_present(records: DataFrame, keys: DataFrame) -> DataFrame:
    """existence test by name for every row of *keys* (column ``key``)."""
    wanted = keys.select("key").distinct().withColumn("_k", F.lower("key"))
    have = records.select(name_key().alias("_k")).distinct().withColumn("present", F.lit(True))
    return wanted.join(have, "_k", "left").select("key", F.coalesce("present", F.lit(False)).alias("present"))


def value_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """F8: status or disposition filter; "all" keeps everything."""
    return df if value == "all" else df.filter(F.col(column) == value)


def failed_only(results: DataFrame, valid: str = "valid") -> DataFrame:
    """F8: only the rows that did not pass validation."""
    return results.filter(~F.col(valid))


def sparse_pages(pages: DataFrame, min_chars: int = 100) -> DataFrame:
    """pages with too little text."""
    return pages.filter(F.length("text") < min_chars)


def with_ids(records: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The records whose id is among *ids* (id); all of them if there are none."""
    if ids is None or ids.isEmpty():
        return records
    return records.join(ids.select("id").distinct(), "id", "left_semi")


def select_records(
    records: DataFrame, ids: DataFrame | None = None, categories: list[str] | None = None
) -> DataFrame:
    """optional id set (column ``id``) and optional categories; both must hold.

    An empty id set selects everything, as an empty list of categories does; whether it is empty is looked up when this is called.
    """
    out = with_ids(records, ids)
    return out.filter(F.col("category").isin(list(categories))) if categories else out


def update_notes_tags(records: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """replace notes and tags by id; also returns the edits with an unknown id.

    *edits*: id, notes, tags, and ``ord`` giving the order of edits (the last one wins).
    """
    last = edits.groupBy("id").agg(
        F.max_by("notes", "ord").alias("_notes"), F.max_by("tags", "ord").alias("_tags"), F.lit(True).alias("_edit")
    )
    joined = records.join(last, "id", "left")
    kept = [c for c in records.columns]
    out = joined.withColumn("notes", F.when(F.col("_edit"), F.col("_notes")).otherwise(F.col("notes"))).withColumn(
        "tags", F.when(F.col("_edit"), F.col("_tags")).otherwise(F.col("tags"))
    )
    return out.select(*kept), edits.join(records.select("id"), "id", "left_anti")


def delete_by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """drop records by id; unknown ids are ignored."""
    return records.join(ids.select("id"), "id", "left_anti")


def count_all(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"))


def count_by_category(records: DataFrame, keep_zero: bool = False) -> DataFrame:
    """A1: records per category in display order; empty categories are left out unless asked for."""
    counts = records.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    dim = category_dim(records.sparkSession)
    joined = dim.join(counts, "category", "left" if keep_zero else "inner")
    return joined.select("category", "label", F.coalesce("count", F.lit(0)).alias("count"), "display_order").orderBy(
        "display_order"
    )


def facet_values(records: DataFrame, field_name: str) -> DataFrame:
    """A2: distinct values in binary order; empty text is dropped, except for tags."""
    column = FACET_FIELDS[field_name]
    if field_name == "tags":
        values = records.select(F.explode("tags").alias("value"))
    else:
        values = records.select(F.col(column).alias("value")).filter(F.col("value") != "")
    return values.distinct().orderBy("value")


def facets(records: DataFrame) -> DataFrame:
    """A2 for all fields in one pass over the records."""
    pairs = F.concat(
        F.array(*[
            F.struct(F.lit(n).alias("facet"), F.col(c).alias("value"))
            for n, c in FACET_FIELDS.items() if n != "tags"
        ]),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                    lambda t: F.struct(F.lit("tags").alias("facet"), t.alias("value"))),
    )
    return (
        records.select(F.explode(pairs).alias("p"))
        .select("p.facet", "p.value")
        .filter((F.col("facet") == "tags") | (F.col("value") != ""))
        .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    )


def first_templates(templates: DataFrame) -> DataFrame:
    """The first registered template of each subtype."""
    return templates.groupBy("subtype").agg(
        *least("ord", *[c for c in templates.columns if c not in ("subtype", "ord")]), F.min("ord").alias("ord")
    )
