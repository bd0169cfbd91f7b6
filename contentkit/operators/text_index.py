"""Text search over a bucketed catalog by trigrams (F2).

Every run of three characters of a record's name, tags, notes and source book has posting lists: the order numbers of the records that
hold it, as differences, in blocks of one bucket and 65,536 consecutive numbers.  So no list grows with a common trigram.  A search
intersects the lists of the needle's trigrams, reads only the buckets that hold a common record, and checks those
records with the condition of the plain search, which decides alone.  A needle under three characters is searched by a scan.

Lists are written for the buckets that a generation of the catalog rewrote, and hold as long as the bucket is that generation's.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.operators.bucketed import BucketedCatalog, generations
from contentkit.operators.catalog import search_text

#: Characters of a gram, and bits of the numbers of a block.
GRAM, BLOCK_BITS = 3, 16
POSTINGS = "gram string, bucket int, n int, steps array<bigint>, gen int, part int"


def _grams(value: Column) -> Column:
    """The runs of three characters of a lower-cased text."""
    chars = F.filter(F.split(F.lower(value), ""), lambda c: c != "")
    return F.transform(F.array(chars), lambda c: F.when(F.size(c) >= GRAM, F.transform(
        F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.concat(*[F.get(c, i + k) for k in range(GRAM)]))).otherwise(F.array().cast("array<string>")))[0]


def record_grams() -> Column:
    """The different trigrams of the searched fields of a record, none across two values."""
    values = F.concat(F.array("name", "notes", "source_book"), F.coalesce("tags", F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), _grams)))


def needle_grams(needle: str) -> list[str]:
    low = needle.lower()
    return sorted({low[k:k + GRAM] for k in range(len(low) - GRAM + 1)})


class TextIndex:
    """Posting lists next to a catalog, in *parts* folders by the checksum of the trigram; the number is fixed with the first refresh."""

    def __init__(self, catalog: BucketedCatalog, parts: int = 64):
        self.catalog, self.parts, self.path = catalog, parts, f"{catalog.root}/trigrams"

    def _postings(self, records: DataFrame) -> DataFrame:
        each = records.select(
            self.catalog.bucket_of(self.catalog.key).alias("bucket"), "ord", F.shiftright("ord", BLOCK_BITS).alias("block"),
            F.explode(record_grams()).alias("gram"))
        lists = each.groupBy("gram", "bucket", "block").agg(F.sort_array(F.collect_list("ord")).alias("ords"))
        steps = F.transform("ords", lambda x, i: x - F.when(i > 0, F.get("ords", i - 1)).otherwise(0))
        return lists.select("gram", "bucket", F.size("ords").alias("n"), steps.alias("steps"),
                            F.pmod(F.crc32("gram"), F.lit(self.parts)).cast("int").alias("part"))

    def refresh(self) -> list[int]:
        """Write the lists of all generations that the newest state uses and that have none yet; their numbers."""
        rows = [r for r in self.catalog.manifest().collect() if r.kind == "data"]
        missing = sorted({r.gens[0] for r in rows} - set(generations(self.catalog.folder, self.path)))
        for generation in missing:
            buckets = [r.part for r in rows if r.gens[0] == generation]
            lists = self._postings(self.catalog.read(buckets))
            lists.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/gen={generation}")
        return missing

    def candidates(self, needle: str) -> DataFrame:
        """(bucket, ord) of the records that hold all trigrams of a needle of three characters or more."""
        spark, grams = self.catalog.spark, needle_grams(needle)
        parts = sorted({zlib.crc32(g.encode()) % self.parts for g in grams})
        current = [(r.part, r.gens[0]) for r in self.catalog.manifest().collect() if r.kind == "data"]
        if not current:
            return spark.createDataFrame([], "bucket int, ord bigint")
        lists = spark.read.schema(POSTINGS).parquet(self.path).filter(F.col("part").isin(parts) & F.col("gram").isin(grams))
        # At most one row for each bucket, whose number is a parameter of the catalog.
        live = F.broadcast(spark.createDataFrame(current, "bucket int, gen int"))
        valid = lists.join(live, ["bucket", "gen"])
        sums = F.aggregate("steps", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))
        ords = F.when(F.col("n") == 1, F.col("steps")).otherwise(sums)
        return valid.select("bucket", F.explode(ords).alias("ord")).groupBy("bucket", "ord").agg(F.count(F.lit(1)).alias("k")).filter(
            F.col("k") == len(grams)).select("bucket", "ord")

    def search(self, needle: str) -> DataFrame:
        """the records that ``search_text`` finds, reading only the buckets of the candidates; refreshes the lists first."""
        self.refresh()
        whole = self.catalog.read()
        if whole is None or len(needle) < GRAM:
            return whole if whole is None or not needle else whole.filter(search_text(needle))
        found = self.candidates(needle)
        buckets = sorted(r.bucket for r in found.select("bucket").distinct().collect())
        records = self.catalog.read(buckets)
        return records.join(found.select("ord"), "ord", "left_semi").filter(search_text(needle)).select(*whole.columns)
