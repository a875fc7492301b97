"""Keyed state in versions: buckets of base files, deltas of batches, merge on read, and a manifest that switches in one step.

A batch costs what it holds: it is written as a delta and named by the next manifest, and only then do readers see it. A
batch that is killed leaves files that no manifest names. Compaction rewrites the buckets that deltas touch, and no other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.files import Files

_BUCKET, _GONE, _AGE = "_bucket", "_gone", "_age"


class VersionedTable:
    """Rows by key, of which the highest version holds; of equal versions the batch that was applied last, and of one
    batch's the greatest row.

    One writer at a time; readers need no lock. ``buckets`` is fixed with the first batch. A row that a batch removes is
    forgotten with the next compaction, so a removed key must not come again with an older version.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], version: str, buckets: int = 16, deltas: int = 8):
        self.spark, self.folder, self.schema, self.keys, self.version = spark, folder, schema, list(keys), version
        self.buckets, self.deltas = buckets, deltas
        self.files = Files(spark, folder)
        self._shape = f"{schema}, {_GONE} BOOLEAN, {_BUCKET} INT"

    def manifest(self, number: int | None = None) -> dict:
        """The named manifest, or the last one."""
        names = self.files.names("manifests")
        if not names:
            return {"number": 0, "base": {}, "deltas": [], "streams": {}, "buckets": self.buckets}
        return json.loads(self.files.read(f"manifests/{names[-1] if number is None else f'{number:012d}.json'}"))

    def _switch(self, old: dict, **new) -> dict:
        made = old | new | {"number": old["number"] + 1}
        self.files.publish(f"manifests/{made['number']:012d}.json", json.dumps(made))
        return made

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{name}")
        return name

    def _latest(self, rows: DataFrame, order: Column) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, _BUCKET, _AGE)]
        # Maps and variants have no order.
        ties = [c for c, kind in rows.dtypes if c in rest and "map<" not in kind and "variant" not in kind]
        best = rows.groupBy(*self.keys, _BUCKET).agg(F.max_by(F.struct(*rest), F.struct(order, *ties)).alias("_b"))
        return best.select(*self.keys, "_b.*", _BUCKET)

    def _merged(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        read = lambda paths: self.spark.read.schema(self._shape).option("basePath", f"{self.folder}/{paths[0].split('/')[0]}").parquet(*[f"{self.folder}/{p}" for p in paths])
        by_write: dict[str, list[str]] = {}
        for bucket, name in manifest["base"].items():
            if only is None or bucket in only:
                by_write.setdefault(name, []).append(f"{name}/{_BUCKET}={bucket}")
        parts = [read(paths).withColumn(_AGE, F.lit(0)) for paths in by_write.values()]
        parts += [read([name]).withColumn(_AGE, F.lit(k + 1)) for k, name in enumerate(manifest["deltas"])]
        if not parts:
            return self.spark.createDataFrame([], self._shape)
        rows = reduce(DataFrame.unionByName, parts)
        return self._latest(rows, F.struct(self.version, _AGE)).where(~F.col(_GONE)) if manifest["deltas"] else rows.drop(_AGE)

    def snapshot(self, number: int | None = None) -> DataFrame:
        """The rows as the last manifest, or the named one, has them."""
        return self._merged(self.manifest(number)).drop(_GONE, _BUCKET)

    def apply(self, batch: DataFrame, stream: str, number: int, gone: Column | None = None) -> bool:
        """Apply batch ``number`` of a stream, once: a number that isn't higher than the stream's last one changes nothing.

        ``gone``: rows that remove their key.
        """
        held = self.manifest()
        if held["streams"].get(stream, -1) >= number:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(held["buckets"])).cast("int").alias(_BUCKET)
        shaped = batch.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], self.schema).schema], F.coalesce(gone, F.lit(False)).alias(_GONE) if gone is not None else F.lit(False).alias(_GONE), bucket)
        delta = self._write(self._latest(shaped, F.col(self.version)), "delta")
        held = self._switch(held, deltas=[*held["deltas"], delta], streams=held["streams"] | {stream: number})
        if len(held["deltas"]) >= self.deltas:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge the deltas into the base files of the buckets they touch."""
        held = self.manifest()
        touched = {n.partition("=")[2] for d in held["deltas"] for n in self.files.names(d) if n.startswith(_BUCKET)}
        if not touched:
            return
        name = self._write(self._merged(held, touched), "base")
        present = {n.partition("=")[2] for n in self.files.names(name) if n.startswith(_BUCKET)}
        base = {b: n for b, n in held["base"].items() if b not in touched} | dict.fromkeys(sorted(present), name)
        self._switch(held, base=base, deltas=[])

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the last ``keep``, and files that none of these names."""
        names = self.files.names("manifests")
        last = [json.loads(self.files.read(f"manifests/{n}")) for n in names[-keep:]]
        named = {x for m in last for x in (*m["base"].values(), *m["deltas"])}
        for name in names[:-keep]:
            self.files.delete(f"manifests/{name}")
        for name in self.files.names():
            if name.startswith(("base-", "delta-")) and name not in named:
                self.files.delete(name)
