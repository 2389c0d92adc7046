"""A store of items that batches are merged into without shuffling what is stored.

A store is a base and deltas. The base is a table bucketed and sorted by fingerprint, of as many buckets as its rows
ask for: a merge exchanges the batch alone, and each task reads one bucket and writes it anew. A delta is a batch as
it came, a small file beside the base; reading folds the deltas into the base by the rules of ``merge_items``, and
compacting writes the next base. Base and deltas never change once written: a log names those that are in force, so
a reader sees a whole state, whichever writer is at work, and a writer that dies leaves the last state as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.dedup import keep_last
from quillspark.operators.merge import merge_items

#: Rows of a bucket, about, and deltas after which the next append compacts.
BUCKET_ROWS, MOST_DELTAS = 2_000_000, 8
_LOG = "version long, base string, buckets int, deltas array<string>"


class ItemStore:
    """Items by fingerprint at ``root``, in the shape of ``schema`` (first_seen_at and last_seen_at among it).

    One writer at a time; any number of readers. Bases are tables of the session's catalog over files in ``root``; a
    session that does not know one yet declares it. What the log no longer names can be removed once no reader uses it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, *, key: str = "fingerprint", bucket_rows: int = BUCKET_ROWS, most_deltas: int = MOST_DELTAS):
        self.spark, self.root, self.schema, self.key, self.bucket_rows, self.most_deltas = spark, root, schema, key, bucket_rows, most_deltas

    def create(self, items: DataFrame) -> None:
        """The first base. Of equal fingerprints, which a store does not hold, any one stays."""
        self._write_base(items.select(self.schema.names).dropDuplicates([self.key]), 0, max(1, -(-items.count() // self.bucket_rows)))

    def state(self):
        """The last row of the log: version, base, buckets, deltas."""
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/log").orderBy(F.col("version").desc()).first()

    def base(self, state=None) -> DataFrame:
        """The bucketed table of the base, without the deltas."""
        s = state or self.state()
        name = f"store_{s['base'].replace('-', '')}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {s['buckets']} BUCKETS LOCATION '{self.root}/base-{s['base']}'")
        return self.spark.table(name)

    def read(self) -> DataFrame:
        """All items: the base with its deltas folded in."""
        s = self.state()
        if not s["deltas"]:
            return self.base(s)
        return self._merged(self.base(s), self._folded(s["deltas"]), s["buckets"]).drop("action").select(self.schema.names)

    def merge(self, batch: DataFrame, now: Column) -> DataFrame:
        """Merge a batch (with seq, as ``merge_items`` takes it) and any deltas into the next base; (inserted, updated) rows of the batch."""
        s = self.state()
        merged = self._merged(self.read() if s["deltas"] else self.base(s), batch, s["buckets"], now)
        version = self._write_base(merged, s["version"] + 1, s["buckets"], extra=("action",))
        actions = self.spark.read.schema("action string").parquet(f"{self.root}/base-{version}")
        return actions.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"))

    def append(self, batch: DataFrame, now: Column) -> None:
        """Write a batch as a delta: of equal fingerprints the last by seq. After ``most_deltas`` of them the next base is made."""
        s = self.state()
        name = uuid.uuid4().hex
        last = batch.withColumn("__k", F.row_number().over(Window.partitionBy(self.key).orderBy(F.col("seq").desc()))).filter("__k = 1")
        given = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        last.select(*given).withColumn("__now", now).withColumn("__batch", F.lit(s["version"] + 1).cast("long")).write.parquet(f"{self.root}/delta-{name}")
        self._log(s["version"] + 1, s["base"], s["buckets"], [*s["deltas"], name])
        if len(s["deltas"]) + 1 >= self.most_deltas:
            self.compact()

    def compact(self) -> None:
        """The deltas become part of the next base, whose buckets are as many as its rows ask for."""
        s, rows = self.state(), self.read()
        if s["deltas"]:
            held = self.base(s).count()
            self._write_base(rows, s["version"] + 1, max(s["buckets"], -(-held // self.bucket_rows)))

    def _folded(self, deltas: list[str]) -> DataFrame:
        """Deltas as one batch: what a fingerprint brought first or last, as each column of a merge asks for it.

        The result has __first and __last, when it was first and last seen.
        """
        kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in self.schema)[2:]
        rows = self.spark.read.schema(f"{kinds}, __now timestamp, __batch long").parquet(*[f"{self.root}/delta-{d}" for d in deltas])
        own = [c for c in self.schema.names if c not in (self.key, "first_seen_at", "last_seen_at")]
        first, last = (lambda c: F.min_by(F.struct(c), "__batch")[c]), (lambda c: F.max_by(F.struct(c), "__batch")[c])
        # A blank summary or link stands where nothing else came; a later date wins unless it is null.
        filled = lambda c, ok: F.coalesce(F.max_by(F.when(ok, F.col(c)), F.when(ok, F.col("__batch"))), last(c))
        how = {"summary": lambda c: filled(c, F.coalesce(F.col(c), F.lit("")) != ""), "link": lambda c: filled(c, F.coalesce(F.col(c), F.lit("")) != ""), "date": lambda c: filled(c, F.col(c).isNotNull()), "source_tab": last, "category": last}
        return rows.groupBy(self.key).agg(*[how.get(c, first)(c).alias(c) for c in own], F.min("__now").alias("__first"), F.max("__now").alias("__last"))

    def _merged(self, stored: DataFrame, batch: DataFrame, buckets: int, now: Column | None = None) -> DataFrame:
        if now is not None:
            # Of equal fingerprints the last goes on alone: the others are dropped where they were read, not in a bucket's task.
            return merge_items(stored, keep_last(batch, self.key, "seq").repartition(buckets, self.key), now, key=self.key)
        folded = batch.withColumn("seq", F.lit(0)).repartition(buckets, self.key)
        seen = folded.select(F.col(self.key).alias("__k"), "__first", "__last")
        out = merge_items(stored, folded.drop("__first", "__last"), F.lit(None).cast("timestamp"), key=self.key)
        joined = out.join(seen, F.col(self.key) == F.col("__k"), "left")
        return joined.withColumns({"first_seen_at": F.coalesce("first_seen_at", "__first"), "last_seen_at": F.when(F.col("action") == "kept", F.col("last_seen_at")).otherwise(F.col("__last"))}).drop("__k", "__first", "__last")

    def _write_base(self, rows: DataFrame, version: int, buckets: int, extra: tuple[str, ...] = ()) -> str:
        name = uuid.uuid4().hex
        made = rows.select(*self.schema.names, *extra).repartition(buckets, self.key) if version == 0 else rows.select(*self.schema.names, *extra)
        staged = f"staged_{name}"
        made.write.bucketBy(buckets, self.key).sortBy(self.key).option("path", f"{self.root}/base-{name}").saveAsTable(staged)
        self.spark.sql(f"DROP TABLE {staged}")  # the files stay; the log makes them the base
        self._log(version, name, buckets, [])
        return name

    def _log(self, version: int, base: str, buckets: int, deltas: list[str]) -> None:
        self.spark.createDataFrame([(version, base, buckets, deltas)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
