"""Tables as immutable Parquet snapshots: a commit writes new versions, then one manifest.

Plain Parquet has no MERGE, so an update is a new version of the table. A manifest is a small file
that names the current version, and its folders, of every table; the latest one counts. It appears
whole or not at all, and for all tables at once, so readers never see some tables of a commit without
the others; of two writers that build on the same manifest, one fails. Rolling back is a manifest
that names an earlier version.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .schemas import conformed


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local one in local mode
    (tests), and an error on a cluster, whose machines don't share local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialized(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage. instead_of: an earlier
    such table, as of a loop's last round, that nothing needs any more: its files go."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _path(spark, path, lambda fs, p: fs.deleteOnExit(p))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if instead_of is not None and is_materialized(instead_of):
        _path(spark, instead_of._scratch, lambda fs, p: fs.delete(p, True))
    return out


def is_materialized(df: DataFrame) -> bool:
    return getattr(df, "_scratch", None) is not None


def _path(spark: SparkSession, path: str, use):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return use(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


class Store:
    """Versions of named tables below a root path, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self._known: dict[str, dict[str, dict]] = {}  # manifests never change

    def _manifests(self) -> list[dict[str, dict]]:
        """All manifests, oldest first: {table: {"version": ..., "folders": [...]}}."""

        def names(fs, at):
            return sorted(n for s in fs.listStatus(at) if (n := s.getPath().getName()).isdigit()) if fs.exists(at) else []

        def text(fs, at):
            source = fs.open(at)
            try:
                return bytes(source.readAllBytes()).decode()
            finally:
                source.close()

        found = _path(self.spark, f"{self.root}/_manifests", names)
        for n in found:
            if n not in self._known:
                self._known[n] = json.loads(_path(self.spark, f"{self.root}/_manifests/{n}", text))
        return [self._known[n] for n in found]

    def versions(self, table: str) -> list[str]:
        """A table's versions in the order in which they became current."""
        out: list[str] = []
        for m in self._manifests():
            if table in m and out[-1:] != [m[table]["version"]]:
                out.append(m[table]["version"])
        return out

    def version(self, table: str) -> str | None:
        found = self.versions(table)
        return found[-1] if found else None

    def read(self, table: str) -> DataFrame:
        known = self._manifests()
        folders = known[-1].get(table, {"folders": []})["folders"] if known else []
        if not folders:
            return self.spark.createDataFrame([], self.schemas[table])
        return conformed(self.spark.read.parquet(*(f"{self.root}/{table}/{f}" for f in folders)), self.schemas[table])

    def commit(self, changes: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> dict[str, str]:
        """Writes new versions of all tables; they become current together."""
        known, written = self._manifests(), {}
        for table, df in changes.items():
            written[table] = uuid.uuid4().hex
            conformed(df, self.schemas[table]).write.partitionBy(*(partition_by or {}).get(table, [])).parquet(f"{self.root}/{table}/{written[table]}")
        self._publish(known, {t: {"version": v, "folders": [v]} for t, v in written.items()})
        return written

    def append(self, table: str, rows: DataFrame, token: str) -> bool:
        """A version with the rows added, which alone are written. A token is appended once: when the
        same work runs again, nothing changes and False is returned."""
        known = self._manifests()
        if any(m.get(table, {}).get("version") == token for m in known):
            return False
        before = known[-1].get(table, {"folders": []})["folders"] if known else []
        conformed(rows, self.schemas[table]).write.mode("overwrite").parquet(f"{self.root}/{table}/{token}")
        self._publish(known, {table: {"version": token, "folders": [*before, token]}})
        return True

    def _publish(self, known: list[dict[str, dict]], changes: dict[str, dict]) -> None:
        """The next manifest after the known ones: written aside, then renamed, which fails if
        another writer was first."""
        body = json.dumps((known[-1] if known else {}) | changes).encode()
        aside = f"{self.root}/_manifests/_{uuid.uuid4().hex}"

        def write(fs, at):
            out = fs.create(at, False)
            out.write(bytearray(body))
            out.close()

        _path(self.spark, aside, write)
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs
        source, target = hadoop.Path(aside), hadoop.Path(f"{self.root}/_manifests/{len(known):010d}")
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(source.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, none)
        except Exception as e:
            _path(self.spark, aside, lambda fs, at: fs.delete(at, False))
            if "FileAlreadyExistsException" in str(e):
                raise RuntimeError("another writer committed first; read again and repeat") from None
            raise

    def roll_back(self, table: str, version: str) -> None:
        known = self._manifests()
        self._publish(known, {table: next(m[table] for m in known if m.get(table, {}).get("version") == version)})
