"""Tables of rows by key that change by parts: copy-on-write of key buckets, under a manifest per version.

    path/data/batch=<n>/bucket=<b>/...   the rows of a bucket, as a batch left them
    path/manifest/version=<n>            which batch holds each bucket's rows; complete once Spark has committed it

A change writes the buckets that its keys fall into, then a manifest that names them; buckets without a change
keep the files they have. A version is read by its manifest, so readers see a batch whole or not at all. A batch that is
run again starts from the version before it and replaces only its own files.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.userlog import latest_per_key
from ..session import cut_lineage

#: Marks rows that a deletion left behind: they keep older rows of their key out.
GONE = "__gone"


class KeyedTable:
    """The latest row per key, by ``order``. Of rows of one key and equal order the one already there stays."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        """A table that has been written, with the keys, order and buckets it was made with."""
        made = cls(spark, path, [], [])
        head = spark.read.parquet(f"{made.path}/manifest/version={made.versions()[-1]}").first()
        return cls(spark, path, list(head["keys"]), list(head["order"]), head["buckets"])

    # --- versions -------------------------------------------------------------------------------

    def _store(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        Path, store = self.spark._jvm.org.apache.hadoop.fs.Path, self._store()
        folder = Path(f"{self.path}/manifest")
        if not store.exists(folder):
            return []
        named = [e.getPath() for e in store.listStatus(folder) if e.getPath().getName().startswith("version=")]
        return sorted(int(p.getName().removeprefix("version=")) for p in named if store.exists(Path(p, "_SUCCESS")))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Batch that holds each bucket's rows; buckets without rows are not named."""
        found = self.versions()
        if not found:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/version={found[-1] if version is None else version}").collect()  # a row per bucket
        return {r["bucket"]: r["batch"] for r in rows if r["bucket"] >= 0}

    def _schema(self, version: int) -> StructType:
        return StructType.fromJson(json.loads(self.spark.read.parquet(f"{self.path}/manifest/version={version}").first()["schema"]))

    def _commit(self, version: int, held: dict[int, int], schema: StructType) -> None:
        rows = [(-1, -1, self.keys, self.order, self.buckets, schema.json())] + [(b, n, self.keys, self.order, self.buckets, schema.json()) for b, n in sorted(held.items())]
        names = "bucket int, batch bigint, keys array<string>, order array<string>, buckets int, schema string"
        self.spark.createDataFrame(rows, names).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    # --- reading --------------------------------------------------------------------------------

    def _rows(self, version: int | None, only: list[int] | None = None) -> DataFrame | None:
        found = self.versions() if version is None else [version]
        if not found:
            return None
        held, schema = self.manifest(found[-1]), self._schema(found[-1])
        folders = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in held.items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; deleted ones are left out."""
        rows = self._rows(version)
        if rows is None:
            raise FileNotFoundError(f"no finished version in {self.path}")
        return rows.where(~F.col(GONE)).drop(GONE)

    # --- changing -------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _change(self, rows: DataFrame, batch: int | None) -> list[int]:
        """Merge rows, with the mark of deletion, into their buckets; gives the buckets written."""
        older = [v for v in self.versions() if batch is None or v < batch]
        batch = (older[-1] + 1 if older else 0) if batch is None else batch
        base = older[-1] if older else None
        marked = cut_lineage(rows.withColumn("bucket", self._bucket()))  # read twice, computed once
        touched = sorted(r["bucket"] for r in marked.select("bucket").distinct().collect())  # one number per bucket
        held = self.manifest(base) if older else {}
        if touched:
            known = self._rows(base, touched) if older else None
            both = marked.withColumn("__new", F.lit(1))
            if known is not None:
                both = both.unionByName(known.withColumn("bucket", self._bucket()).withColumn("__new", F.lit(0)), allowMissingColumns=True)
            # the last by order; of equal ones the row already there
            last = latest_per_key(both.withColumn("__old", -F.col("__new")), self.keys, [*self.order, "__old"]).drop("__new", "__old")
            schema = last.drop("bucket").schema
            last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
            held = {**held, **dict.fromkeys(touched, batch)}
        else:
            schema = self._schema(base) if older else rows.schema
        self._commit(batch, held, schema)
        self.vacuum()
        return touched

    def upsert(self, rows: DataFrame, batch: int | None = None) -> list[int]:
        """Put rows in by key; a row older than what is there changes nothing."""
        return self._change(rows.withColumn(GONE, F.lit(False)), batch)

    def delete(self, rows: DataFrame, batch: int | None = None) -> list[int]:
        """Delete by key: ``rows`` has the keys and the order of the deletion; later rows of a key bring it back."""
        return self._change(rows.select(*self.keys, *self.order).withColumn(GONE, F.lit(True)), batch)

    def update(self, changes: DataFrame, on: list[str], values: dict[str, Column], batch: int | None = None) -> list[int]:
        """Change the rows that meet ``changes`` on the given columns, one row of it each; only their buckets are written.

        ``values`` are columns over both. Keys and order stay as they are.
        """
        met = self.read().join(changes, on)
        columns = [c for c in self.read().columns]
        changed = met.withColumns(values).select(*columns).withColumn(GONE, F.lit(False))
        return self._replace(changed, batch)

    def _replace(self, rows: DataFrame, batch: int | None) -> list[int]:
        """As _change, but a row takes the place of the one of its key and equal order."""
        found = self.versions()
        batch = found[-1] + 1 if batch is None else batch
        base = [v for v in found if v < batch][-1]
        marked = cut_lineage(rows.withColumn("bucket", self._bucket()))  # read twice, computed once
        touched = sorted(r["bucket"] for r in marked.select("bucket").distinct().collect())
        held = self.manifest(base)
        if touched:
            known = self._rows(base, touched).withColumn("bucket", self._bucket()).withColumn("__new", F.lit(0))
            both = marked.withColumn("__new", F.lit(1)).unionByName(known)
            last = latest_per_key(both, self.keys, [*self.order, "__new"]).drop("__new")
            last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
            held |= dict.fromkeys(touched, batch)
        self._commit(batch, held, self._schema(base))
        self.vacuum()
        return touched

    def vacuum(self, keep: int = 2) -> None:
        """Drop manifests but the newest ones, and the batches' buckets that none of these names."""
        Path, store, found = self.spark._jvm.org.apache.hadoop.fs.Path, self._store(), self.versions()
        if len(found) <= keep:
            return
        used = {(n, b) for v in found[-keep:] for b, n in self.manifest(v).items()}
        dropped = {(n, b) for v in found[:-keep] for b, n in self.manifest(v).items()} - used
        for n, b in dropped:
            store.delete(Path(f"{self.path}/data/batch={n}/bucket={b}"), True)
        for v in found[:-keep]:
            store.delete(Path(f"{self.path}/manifest/version={v}"), True)
