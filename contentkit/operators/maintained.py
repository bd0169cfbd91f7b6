"""Facet counts that follow a bucketed catalog without counting it again (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentkit.operators.bucketed import BucketedCatalog, generations
from contentkit.operators.catalog import facets
from contentkit.records import category_dim

COUNTS = "facet string, value string, count bigint"


def all_counts(records: DataFrame) -> DataFrame:
    """(facet, value, count) of every facet field, and of the category."""
    own = records.groupBy(F.lit("category").alias("facet"), F.col("category").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return facets(records).unionByName(own)


class MaintainedFacets:
    """Counts per facet value, stored next to the generations of a catalog.

    Bringing them up to date reads the buckets that changed since, as they were (counted with a minus) and as they are, and adds
    the difference to the stored counts; a value that reaches zero goes.  Counts of a generation are complete with their
    marker, so a run that is killed leaves the old ones.
    """

    def __init__(self, catalog: BucketedCatalog):
        self.catalog, self.path = catalog, f"{catalog.root}/facets"

    def _stored(self, generation: int) -> DataFrame:
        return self.catalog.spark.read.schema(COUNTS).parquet(f"{self.path}/gen={generation}")

    def refresh(self) -> DataFrame:
        """The counts of the newest generation (none before the first)."""
        spark, newest = self.catalog.spark, self.catalog.generation()
        if newest is None:
            return spark.createDataFrame([], COUNTS)
        known = [g for g in generations(self.catalog.folder, self.path) if g <= newest]
        if known and known[-1] == newest:
            return self._stored(newest)
        if known:
            buckets = self.catalog.changed(known[-1], newest)
            signed = [(self.catalog.read(buckets, known[-1]), -1), (self.catalog.read(buckets, newest), 1)]
            parts = [self._stored(known[-1])] + [all_counts(rows).withColumn("count", F.col("count") * sign) for rows, sign in signed]
            total = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("facet", "value").agg(F.sum("count").alias("count"))
        else:
            total = all_counts(self.catalog.read(generation=newest))
        total.filter("count <> 0").select("facet", "value", "count").write.mode("overwrite").parquet(f"{self.path}/gen={newest}")
        return self._stored(newest)

    def by_category(self, keep_zero: bool = False) -> DataFrame:
        """A1 from the stored counts, in display order."""
        counts = self.refresh().filter("facet = 'category'").select(F.col("value").alias("category"), "count")
        dim = category_dim(self.catalog.spark)
        return dim.join(counts, "category", "left" if keep_zero else "inner").select(
            "category", "label", F.coalesce("count", F.lit(0)).alias("count"), "display_order").orderBy("display_order")
