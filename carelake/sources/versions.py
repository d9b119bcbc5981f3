"""A chunk index that rows are added to, replaced in and removed from by id, in versions.

Data folders are written once and never changed. A version is a manifest that names one base folder and the folders of changes
after it, in order; it is a file that appears by renaming, so a reader sees a whole version or the one before, and a second writer
of the same version fails. A row of the latest change of its id counts, and a removed id has none. Compaction writes what a reader
sees as a new base. Older versions stay readable; folders that no version names any more are left to the folder's owner.

Reading leaves the base where it is: only ids of the changes are looked up in it, and Spark ships them if they are small.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedIndex:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    def _fs(self):
        return self._fs_path(self.path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/manifests")
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def _manifest(self, version: int) -> dict:
        stream = self._fs().open(self._fs_path(f"{self.path}/manifests/v{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> int:
        jvm = self.spark._jvm
        draft = self._fs_path(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        # without an option, renaming to a file that exists fails
        files.rename(self._fs().makeQualified(draft), self._fs().makeQualified(self._fs_path(f"{self.path}/manifests/v{version:012d}")), options)
        return version

    def _write(self, rows: DataFrame, kind: str) -> str:
        folder = f"data/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _next(self, expected: int | None) -> tuple[int, dict]:
        known = self.versions()
        last = known[-1] if known else 0
        if expected is not None and expected != last:
            raise RuntimeError(f"the index is at version {last}, not {expected}")
        return last, self._manifest(last) if last else {"base": None, "changes": []}

    def rebuild(self, rows: DataFrame) -> int:
        """A version that holds exactly these rows; of rows with one id one stays, the smallest."""
        last, _ = self._next(None)
        names = [c for c in rows.columns if c != self.key]
        one = rows.groupBy(self.key).agg(F.min(F.struct(*names)).alias("_r")).select(self.key, "_r.*").select(*rows.columns)
        return self._commit(last + 1, {"base": self._write(one, "base"), "changes": []})

    def upsert(self, rows: DataFrame, expected: int | None = None) -> int:
        """Add rows, and replace those whose id is in the index. ``expected`` refuses if the index has moved on."""
        return self._change(rows.withColumn("_gone", F.lit(False)), expected)

    def remove(self, ids: DataFrame, expected: int | None = None) -> int:
        """Remove the rows with these ids; ids that are not in the index do nothing."""
        return self._change(ids.select(self.key).withColumn("_gone", F.lit(True)), expected)

    def _change(self, rows: DataFrame, expected: int | None) -> int:
        last, manifest = self._next(expected)
        if not last:
            raise RuntimeError("build the index first")
        names = [c for c in rows.columns if c != self.key]
        one = rows.groupBy(self.key).agg(F.min(F.struct(*names)).alias("_r")).select(self.key, "_r.*")
        folder = self._write(one, "change")
        return self._commit(last + 1, {"base": manifest["base"], "changes": [*manifest["changes"], folder]})

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"version {version} of {self.path}" if known else f"no index in {self.path}")
        manifest = self._manifest(version or known[-1])
        base = self.spark.read.parquet(f"{self.path}/{manifest['base']}")
        if not manifest["changes"]:
            return base
        parts = [self.spark.read.parquet(f"{self.path}/{f}").withColumn("_order", F.lit(i)) for i, f in enumerate(manifest["changes"])]
        changes = parts[0]
        for p in parts[1:]:
            changes = changes.unionByName(p, allowMissingColumns=True)
        if len(parts) > 1:
            last = Window.partitionBy(self.key).orderBy(F.desc("_order"))
            changes = changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        kept = base.join(changes.select(self.key), self.key, "left_anti")
        more = changes.where(~F.col("_gone")).drop("_gone", "_order")
        return kept.unionByName(more, allowMissingColumns=True).select(*base.columns)

    def compact(self, expected: int | None = None) -> int:
        """The latest version with a base of its own and no changes."""
        last, manifest = self._next(expected)
        if not last:
            raise RuntimeError("build the index first")
        return self._commit(last + 1, {"base": self._write(self.read(last), "base"), "changes": []})
