"""The catalog data model: categories, target collections and the record columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Category:
    """One content category and where its documents go."""

    name: str
    label: str
    document_type: str
    subtype: str
    pack: str
    has_schema: bool = True


# The categories in display order.
CATEGORIES: tuple[Category, ...] = (
    Category("weapon", "Weapon", "Item", "weapon", "weapons"),
    Category("armor", "Armor", "Item", "armor", "armor"),
    Category("equipment", "Equipment", "Item", "equipment", "equipment"),
    Category("augmentation", "Augmentation", "Item", "augmentation", "augmentations"),
    Category("feat", "Feat", "Item", "feat", "feats"),
    Category("spell", "Spell", "Item", "spell", "spells"),
    Category("race", "Species", "Item", "race", "species"),
    Category("theme", "Theme", "Item", "theme", "themes"),
    Category("class", "Class", "Item", "class", "classes"),
    Category("archetypeFeature", "Archetype", "Item", "archetypeFeature", "archetypes"),
    Category("vehicle", "Vehicle", "Actor", "vehicle", "vehicles"),
    Category("starship", "Starship", "Actor", "starship", "starships"),
    Category("npc", "NPC", "Actor", "npc2", "npcs"),
    Category("hazard", "Hazard", "Actor", "hazard", "hazards"),
    Category("journal", "Journal Entry", "JournalEntry", "journalEntry", "journals", has_schema=False),
)
CATEGORY_NAMES = [c.name for c in CATEGORIES]
CATEGORY = {c.name: c for c in CATEGORIES}
IMPORT_METHODS = ["json", "csv", "txt", "paste"]
RECORD_SCHEMA_VERSION = "2.0.0"
LINEAGE_SCHEMA_VERSION = "3.0.0"
METADATA_SCHEMA_VERSION = "1.0.0"
DEFAULT_CATEGORY = "equipment"

# A catalog row. ``ord`` is the insertion order; "first" always means least ``ord``.
RECORD_COLUMNS = [
    "ord", "id", "name", "category", "source_book", "publisher", "author", "page_number", "tags", "notes",
    "raw_content", "imported_date", "import_method", "schema_version",
]
ISSUE_TYPE = "array<struct<level:string,code:string,field:string,message:string>>"


def category_dim(spark: SparkSession) -> DataFrame:
    """The category dimension (15 rows, so joins broadcast it)."""
    schema = T.StructType([
        T.StructField("category", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("document_type", T.StringType(), False),
        T.StructField("subtype", T.StringType(), False),
        T.StructField("pack_id", T.StringType(), False),
        T.StructField("has_schema", T.BooleanType(), False),
        T.StructField("display_order", T.IntegerType(), False),
    ])
    rows = [(c.name, c.label, c.document_type, c.subtype, c.pack, c.has_schema, i) for i, c in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, schema)


def with_category_dim(records: DataFrame) -> DataFrame:
    """Attach label, document type, subtype and collection to each record."""
    dim = category_dim(records.sparkSession)
    return records.join(F.broadcast(dim), "category", "left")


def category_map(attribute: str) -> Column:
    """Literal map from category to one attribute, for use where a join is not wanted."""
    return F.create_map(*[x for c in CATEGORIES for x in (F.lit(c.name), F.lit(getattr(c, attribute)))])


def is_category(c: Column) -> Column:
    return F.coalesce(c.isin(CATEGORY_NAMES), F.lit(False))


def issue(level: str, code: str, field: str | None, message: Column | str) -> Column:
    """One validation issue."""
    return F.struct(
        F.lit(level).alias("level"),
        F.lit(code).alias("code"),
        F.lit(field).cast("string").alias("field"),
        (message if isinstance(message, Column) else F.lit(message)).alias("message"),
    )


def error(code: str, field: str | None, message: Column | str) -> Column:
    return issue("error", code, field, message)


def warning(code: str, field: str | None, message: Column | str) -> Column:
    return issue("warning", code, field, message)


def issues_of(issues: Column, level: str) -> Column:
    return F.filter(issues, lambda i: i["level"] == level)


def name_key(name: Column | str = "name") -> Column:
    """The merge key: lower-cased, untrimmed name."""
    return F.lower(name if isinstance(name, Column) else F.col(name))


def record_id(*parts: Column) -> Column:
    """Deterministic record id: the whole hash, so that ids stay unique in catalogs of any size."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
