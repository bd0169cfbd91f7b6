"""Browsing, sorting and faceting published documents."""

from pyspark.sql import functions as F

from contentkit.operators import catalog as C
from contentkit.operators.publish import collect_published

LINEAGE = "struct<sourceBook:string,publisher:string,tags:array<string>,importMethod:string,importDate:string>"


def documents(spark):
    rows = [
        ("1", "beta", "weapon", ("Core", "North", ["a", "b"], "json", "2024-01-01")),
        ("2", "Alpha", "armor", ("Core", "South", ["a"], "csv", "2024-01-02")),
        ("3", "émile", "armor", ("", "North", [], "json", "2024-01-03")),
        ("4", "zeta", "armor", None),
        ("5", "Beta", "npc", ("Core", "anvil", ["b"], "json", "2024-01-04")),
    ]
    made = spark.createDataFrame(rows, f"id string, name string, category string, lineage {LINEAGE}")
    return collect_published(made.withColumns({"pack_id": F.lit("p"), "document_type": F.lit("item")}))


def test_filters_reach_published_documents(spark):
    def ids(**wanted):
        return sorted(r.id for r in C.browse_filter(documents(spark), C.CatalogFilter(**wanted)).collect())

    assert ids() == ["1", "2", "3", "5"]
    assert ids(publishers=["North"]) == ["1", "3"] and ids(tags=["a", "b"]) == ["1"]
    assert ids(source_books=["Core"], categories=["armor"]) == ["2"] and ids(search_text="BETA") == ["1", "5"]


def test_published_documents_sort_in_order(spark):
    def ids(*how):
        return [r.id for r in C.sort_records(documents(spark), *how).collect()]

    assert ids("name", True) == ["2", "1", "5", "3"] and ids("name", False) == ["3", "5", "1", "2"]
    assert ids("publisher", True) == ["5", "1", "3", "2"]
    assert ids("importedDate", False) == ["5", "3", "2", "1"]


def test_published_documents_have_facets(spark):
    got = {(r.facet, r.value, r["count"]) for r in C.facets(documents(spark)).collect()}
    assert {("publisher", "North", 2), ("tags", "b", 2), ("sourceBook", "Core", 3), ("importMethod", "csv", 1)} <= got
    assert [r.value for r in C.facet_values(documents(spark), "publisher").collect()] == ["North", "South", "anvil"]


def test_an_empty_id_list_selects_everything(spark, tmp_path):
    from contentkit.operators.catalog import select_records
    from contentkit.plans.queries.base import part_records
    from contentkit.sources.exports import write_json
    records = part_records(spark, "/root/testdata/sf0.001")
    none, some = spark.createDataFrame([], "id string"), spark.createDataFrame([("p1",), ("p1",), ("zz",)], "id string")
    assert select_records(records, none).count() == select_records(records).count() == records.count()
    assert [r.id for r in select_records(records, some).collect()] == ["p1"]
    assert select_records(records, none, ["npc"]).count() == records.filter("category = 'npc'").count()
    write_json(records, str(tmp_path / "all"), none)
    assert spark.read.json(str(tmp_path / "all")).count() == records.count()
