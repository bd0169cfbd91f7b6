"""A catalog kept on disk in buckets by name, merged copy-on-write (M1, M2).

A merge reads and rewrites only the buckets that hold a name of the batch and change.  One folder holds

* ``data/gen=<n>/bucket=<b>``: all records of a bucket as generation n left them;
* ``ids/gen=<n>/slot=<s>``: the ids that generation n added, by hash; a slot with many small files is written anew as one;
* ``manifest/gen=<n>``: for each bucket and slot the generations that make it up, its rows and its greatest order number.

A generation exists once its manifest is complete (the writer's ``_SUCCESS`` marker).  A run that is killed leaves files that no manifest
names, and its repetition overwrites just those; a generation that is complete is never computed again.  The manifest has one row for
each bucket and slot, so it stays as small as their number, which is a parameter of the catalog.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contentkit.operators.merge import apply_batch, judge_batch
from contentkit.records import RECORD_SCHEMA_VERSION

MANIFEST = "kind string, part int, gens array<bigint>, n bigint, top bigint"
#: Generations of small id files after which a slot is written anew as one.
ID_FILES = 8


@dataclass(frozen=True)
class Commit:
    """What a merge did: the generation, the buckets it rewrote, and one action row per batch row (None if it was done before)."""

    generation: int
    rewritten: list[int]
    actions: DataFrame | None


class Folder:
    """Existence, listing and removal in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def generations(folder: Folder, path: str) -> list[int]:
    """Numbers of the complete generations below *path*, ascending."""
    found = [int(name.split("=")[1]) for name in folder.names(path) if name.startswith("gen=")]
    return sorted(n for n in found if folder.exists(f"{path}/gen={n}/_SUCCESS"))


class BucketedCatalog:
    """Records (``ord``, ``id``, ``name`` and any payload) in *buckets* folders by the hash of the merge key.

    *key* is the merge key of a record, the lower-cased name by default.  The number of buckets is fixed with the first merge;
    choose it so that a bucket has a few hundred megabytes.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256, key: Column | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.key = F.lower(F.col("name")) if key is None else key
        self.folder = Folder(spark, root)

    def generation(self) -> int | None:
        done = generations(self.folder, f"{self.root}/manifest")
        return done[-1] if done else None

    def manifest(self, generation: int | None = None) -> DataFrame:
        """(kind, part, gens, n, top) of a generation, the newest by default."""
        at = self.generation() if generation is None else generation
        if at is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/gen={at}")

    def bucket_of(self, key: Column, parts: int | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts or self.buckets)).cast("int")

    def _parts(self, manifest: list, kind: str, wanted: set[int] | None) -> list[str]:
        name = {"data": "bucket", "ids": "slot"}[kind]
        return [f"{self.root}/{kind}/gen={g}/{name}={r.part}" for r in manifest if r.kind == kind and (wanted is None or r.part in wanted) for g in r.gens]

    def _read(self, paths: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _schema(self, generation: int) -> StructType:
        return self.spark.read.parquet(f"{self.root}/schema/gen={generation}").schema

    def read(self, buckets: list[int] | None = None, generation: int | None = None) -> DataFrame | None:
        """A generation (the newest by default), or some buckets of it; None before the first merge."""
        at = self.generation() if generation is None else generation
        if at is None:
            return None
        rows = self.manifest(at).collect()
        return self._read(self._parts(rows, "data", None if buckets is None else set(buckets)), self._schema(at))

    def lookup(self, names: DataFrame) -> DataFrame:
        """Records with one of the *names* (name), reading only their buckets."""
        keyed = names.select(self.key.alias("_key")).distinct()
        buckets = [r.b for r in keyed.select(self.bucket_of(F.col("_key")).alias("b")).distinct().collect()]
        records = self.read(buckets)
        return records.withColumn("_key", self.key).join(keyed, "_key", "left_semi").select(*records.columns)

    def load(self, records: DataFrame) -> Commit:
        """Put *records* as they are, repeated names included, into an empty folder as generation 0; a complete one is left as it is."""
        if self.generation() is not None:
            return Commit(0, [], None)
        every = list(range(self.buckets))
        rows = self._write_data(records, every, 0)
        rows += self._write_ids([], 0, None, [r[1] for r in rows], records.schema)
        self._commit(rows, records.schema, 0)
        return Commit(0, sorted(r[1] for r in rows if r[0] == "data"), None)

    def _commit(self, rows: list, schema: StructType, n: int) -> None:
        """The schema, then the manifest, whose completion makes the generation."""
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/schema/gen={n}")
        table = self.spark.createDataFrame([tuple(r) for r in rows], MANIFEST).coalesce(1).sortWithinPartitions("kind", "part")
        table.write.mode("overwrite").parquet(f"{self.root}/manifest/gen={n}")

    def merge(
        self, batch: DataFrame, overwrite: bool = False, generation: int | None = None,
        actions: tuple[str, str, str] = ("added", "overwritten", "skipped"), schema_version: str | None = RECORD_SCHEMA_VERSION, check_ids: bool = True,
        order: Column | None = None, convert: Callable[[DataFrame], DataFrame] | None = None, schema: StructType | None = None,
    ) -> Commit:
        """Merge *batch* as generation *generation* (one more than the newest by default), by the rules of ``merge_batch``.

        Where the catalog holds other columns than the batch, *convert* makes them of the rows that enter it, and *schema* says which they are.

        Touched buckets are those of the batch's names; of them only those with an added or replaced record are written.  Payloads of all
        other buckets are neither read nor shuffled, and added numbers continue from the manifest.  A generation that is complete
        already is left as it is: merging the same batch under the same number again changes nothing.
        """
        done = generations(self.folder, f"{self.root}/manifest")
        n = generation if generation is not None else (done[-1] + 1 if done else 0)
        if n in done:
            return Commit(n, [], None)
        before = [g for g in done if g < n]
        manifest = self.manifest(before[-1]).collect() if before else []
        schema = self._schema(before[-1]) if before else schema or batch.schema
        top = max((r.top for r in manifest if r.top is not None), default=-1)
        keys = {"_key": self.key}
        touched = {r.b for r in batch.select(self.bucket_of(self.key).alias("b")).distinct().collect()}
        catalog = self._read(self._parts(manifest, "data", touched), schema)
        slots = {r.s for r in batch.select(self.bucket_of(F.col("id")).alias("s")).distinct().collect()} if check_ids else set()
        known = self._read(self._parts(manifest, "ids", slots), StructType().add("id", "string"))
        verdict = judge_batch(catalog, batch, keys, order, check_ids, known)
        merged, judged = apply_batch(catalog, batch, verdict, keys, overwrite, actions, schema_version, F.lit(top + 1), convert)
        enters = verdict.filter(~F.col("_clash") & (F.col("_held").isNull() | F.lit(overwrite)))
        changed = sorted(r.b for r in enters.select(self.bucket_of(F.col("_key")).alias("b")).distinct().collect())
        rows = [r for r in manifest if r.kind == "data" and r.part not in changed]
        rows += self._write_data(merged, changed, n)
        rows += self._write_ids(manifest, n, top, changed, schema) if check_ids else [r for r in manifest if r.kind == "ids"]
        self._commit(rows, schema, n)
        return Commit(n, changed, judged)

    def _write_data(self, merged: DataFrame, changed: list[int], n: int) -> list[tuple]:
        """Write the changed buckets; their manifest rows, counted from what was written."""
        path = f"{self.root}/data/gen={n}"
        out = merged.withColumn("bucket", self.bucket_of(self.key)).filter(F.col("bucket").isin(changed))
        # Rebalancing gives a bucket its own files and splits one that has become large.
        out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        if not changed:
            return []
        written = self.spark.read.schema(StructType().add("ord", "long").add("bucket", "integer")).parquet(path)
        found = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("top")).collect()
        return [("data", r.bucket, [n], r.n, r.top) for r in found]

    def _write_ids(self, manifest: list, n: int, top: int | None, changed: list[int], schema: StructType) -> list[tuple]:
        """Write the ids of the added records (numbers beyond *top*, all if None) next to those of earlier generations."""
        path, old = f"{self.root}/ids/gen={n}", {r.part: r for r in manifest if r.kind == "ids"}
        paths = [f"{self.root}/data/gen={n}/bucket={b}" for b in changed if self.folder.exists(f"{self.root}/data/gen={n}/bucket={b}")]
        fresh = self._read(paths, schema).filter(F.lit(top is None) | (F.col("ord") > F.lit(top))).select("id").withColumn("slot", self.bucket_of(F.col("id")))
        full = {s for s, r in old.items() if len(r.gens) >= ID_FILES}
        again = self._read(self._parts(manifest, "ids", full), StructType().add("id", "string")).withColumn("slot", self.bucket_of(F.col("id")))
        fresh.unionByName(again).hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(path)
        counted = {}
        if any(name.startswith("slot=") for name in self.folder.names(path)):
            written = self.spark.read.schema(StructType().add("id", "string").add("slot", "integer")).parquet(path)
            counted = {r.slot: r["count"] for r in written.groupBy("slot").count().collect()}
        out = []
        for slot in sorted(counted.keys() | old.keys()):
            had = old.get(slot)
            if slot in full or had is None:
                out.append(("ids", slot, [n], counted[slot], None))
            elif slot in counted:
                out.append(("ids", slot, [*had.gens, n], had.n + counted[slot], None))
            else:
                out.append(tuple(had))
        return out

    def changed(self, since: int, until: int) -> list[int]:
        """Buckets whose files differ between two generations."""
        old, new = ({r.part: r.gens for r in self.manifest(g).collect() if r.kind == "data"} for g in (since, until))
        return sorted(b for b in old.keys() | new.keys() if old.get(b) != new.get(b))

    def vacuum(self) -> list[str]:
        """Remove the files that the newest generation does not use and older manifests; what was removed.

        Bring maintained counts up to date first: they compare the generation they know with the newest one.
        """
        at = self.generation()
        if at is None:
            return []
        rows = self.manifest(at).collect()
        used = set(self._parts(rows, "data", None)) | set(self._parts(rows, "ids", None))
        removed = []
        for kind in ("data", "ids"):
            for gen in self.folder.names(f"{self.root}/{kind}"):
                if gen.startswith("gen=") and int(gen[4:]) <= at:
                    for part in self.folder.names(f"{self.root}/{kind}/{gen}"):
                        if "=" in part and f"{self.root}/{kind}/{gen}/{part}" not in used:
                            removed.append(f"{kind}/{gen}/{part}")
        for kind in ("manifest", "schema"):
            removed += [f"{kind}/{gen}" for gen in self.folder.names(f"{self.root}/{kind}") if gen.startswith("gen=") and int(gen[4:]) < at]
        for path in removed:
            self.folder.remove(f"{self.root}/{path}")
        return removed
