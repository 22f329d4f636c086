"""A keyed table that batches are merged into: copy-on-write buckets of Parquet and a manifest a commit."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


@dataclass(frozen=True)
class KeyedStore:
    """Rows with one row a ``key``, under ``path``, a folder that all executors reach.

    ``data/<commit>/bucket=``: the buckets (by a hash of the key) that a
    commit wrote. ``commits/<number>-<commit>.json``: for each bucket the commit
    that wrote it last; it is renamed into place when all data is there, so a
    commit is seen whole or not at all, and one that was cut off is
    written over when it is tried again. ``rejected/<commit>``: rows that a
    commit did not take. One writer at a time: of two, the second to
    finish fails, as its number is taken.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    buckets: int = BUCKETS

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def manifests(self) -> list[str]:
        """Names of the manifests, oldest first."""
        fs, at = self._fs(), self._at("commits")
        return sorted(n for n in (s.getPath().getName() for s in (fs.listStatus(at) if fs.exists(at) else [])) if n.endswith(".json"))

    def _latest(self) -> dict:
        names = self.manifests()
        if not names:
            return {"number": 0, "schema": None, "buckets": {}}
        stream = self._fs().open(self._at("commits", names[-1]))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @staticmethod
    def _name(commit: str) -> str:
        return hashlib.sha256(commit.encode()).hexdigest()[:16]

    def committed(self, commit: str) -> bool:
        return any(n.endswith(f"-{self._name(commit)}.json") for n in self.manifests())

    def read(self) -> DataFrame | None:
        """All rows as the last commit left them; None before the first."""
        m = self._latest()
        return None if m["schema"] is None else self._rows(m, m["buckets"])

    def _rows(self, m: dict, buckets) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        at = [f"{self.path}/data/{m['buckets'][b]}/bucket={b}" for b in buckets if b in m["buckets"]]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, commit: str, order: str | None = None, keep: tuple[str, ...] = (), valid: Column | None = None) -> int:
        """Merge a batch; how many rows were rejected. A commit whose name is known changes nothing.

        Of rows with one key the one with the largest ``order`` counts (then
        the largest by its values). A value that is not null replaces what was there,
        but in ``keep`` (as a time of creation) what was there stays. Rows with
        a null in the key, or for which ``valid`` is not true, are rejected and
        do not stop the others. Only buckets with a changed key are read and
        written. The columns are those of the first commit; others are dropped,
        missing ones are null.
        """
        if self.committed(commit):
            return 0
        m = self._latest()
        schema = StructType.fromJson(m["schema"]) if m["schema"] else rows.schema
        if "bucket" in schema.names:
            raise ValueError("the store's folders use the name bucket")
        ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
        for k in self.key:
            ok = ok & F.col(k).isNotNull()
        name = self._name(commit)
        rows.where(~ok).write.mode("overwrite").parquet(f"{self.path}/rejected/{name}")
        there = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        values = [f.name for f in schema if f.name not in self.key]
        at = F.col(order) if order else F.lit(0)
        best = F.max_by("row", F.struct("at", F.xxhash64(F.to_json("row"))))
        new = rows.where(ok).select(*there, at.alias("_at")).select(*self.key, F.struct(*(values or [F.lit(0).alias("_")])).alias("row"), F.col("_at").alias("at")).groupBy(*self.key).agg(best.alias("new"))
        new = new.withColumn("bucket", self._bucket())
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        old = self._rows({**m, "schema": schema.jsonValue()}, [str(b) for b in touched])
        old = old.select(*self.key, F.struct(*(values or [F.lit(0).alias("_")])).alias("old"))
        both = new.drop("bucket").join(old, list(self.key), "full_outer")
        merged = [F.coalesce(*[F.col(f"{side}.{v}") for side in (("old", "new") if v in keep else ("new", "old"))]).alias(v) for v in values]
        out = both.select(*self.key, *merged).select(*[f.name for f in schema])
        self._commit(m, name, out, touched, schema)
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/rejected/{name}").count()

    def delete(self, keys: DataFrame, commit: str) -> None:
        """Remove the rows with these keys; only their buckets are written."""
        m = self._latest()
        if self.committed(commit) or m["schema"] is None:
            return
        gone = keys.select(*self.key).distinct()
        touched = sorted(r["b"] for r in gone.select(self._bucket().alias("b")).distinct().collect())
        left = self._rows(m, [str(b) for b in touched]).join(gone, list(self.key), "left_anti")
        self._commit(m, self._name(commit), left, touched, StructType.fromJson(m["schema"]))

    def _commit(self, m: dict, name: str, rows: DataFrame, touched: list[int], schema: StructType) -> None:
        fs = self._fs()
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        now = {b: c for b, c in m["buckets"].items() if int(b) not in touched}
        now |= {str(b): name for b in touched if fs.exists(self._at("data", name, f"bucket={b}"))}  # one that lost all its rows has no folder
        text = json.dumps({"number": m["number"] + 1, "schema": schema.jsonValue(), "buckets": now})
        made, final = self._at("commits", f"_{name}"), self._at("commits", f"{m['number'] + 1:08d}-{name}.json")
        stream = fs.create(made, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        taken = [n for n in self.manifests() if n.startswith(f"{m['number'] + 1:08d}-")]
        if taken or not fs.rename(made, final):
            raise RuntimeError(f"another writer has made commit {m['number'] + 1}: read again and repeat")

    def rejected(self, commit: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rejected/{self._name(commit)}")

    def vacuum(self) -> None:
        """Remove data that the last commit does not name; readers of older states fail after that."""
        fs, used = self._fs(), self._latest()["buckets"]
        at = self._at("data")
        for c in fs.listStatus(at) if fs.exists(at) else []:
            for b in fs.listStatus(c.getPath()):
                name = b.getPath().getName()
                if name.startswith("bucket=") and used.get(name[7:]) != c.getPath().getName():
                    fs.delete(b.getPath(), True)
