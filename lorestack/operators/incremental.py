"""Processing only new or changed records.

Method: the target is the state. Output rows carry the key and version of the source row they were made from; a run
anti-joins the source against them, works on what is left and publishes the new target version atomically. A run that
breaks off has published nothing, so the next run sees the same work again, neither more nor less.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestack.session import lookup_join
from lorestack.sources.tables import current_rows, table


def not_yet_done(source: DataFrame, state: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of source whose key the state doesn't hold in this version or a later one.

    The state is reduced to the greatest version of each key first, so repeats in it do no harm. Keys compare null-safe;
    a null version in source is never done, a null version in the state is ignored.
    """
    held = state.filter(F.col(version).isNotNull()).groupBy(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)]).agg(F.max(version).alias("_done"))
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
    condition = F.col("_done") >= F.col(version)
    for c in same:
        condition = condition & c
    return source.join(held, condition, "left_anti")


class ConcurrentPublish(RuntimeError):
    """Another run published the same target version first."""


class VersionedTarget:
    """A table in a shared folder that grows by atomically published versions.

    data/<uuid>/ holds the rows of one run; versions/<n>.json lists the folders that make up version n and is created
    exclusively. Folders that no version lists (of broken runs) are never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: object):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, parts)]))

    def version(self) -> int:
        """The latest published version, 0 before the first."""
        folder = self._at("versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        for n in sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True):
            if self.content(n) is not None:
                return n
        return 0

    def content(self, version: int) -> list[str] | None:
        """The folders of a version; None if its file was not written to its end."""
        stream = self._fs.open(self._at("versions", f"{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"]
        except ValueError:
            return None
        finally:
            stream.close()

    def folders(self, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        return self.content(version) or [] if version else []

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (default: the latest); None before the first."""
        folders = self.folders(version)
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else None

    def pending(self, source: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
        target = self.read()
        return source if target is None else not_yet_done(source, target, keys, version)

    def run(self, source: DataFrame, keys: Sequence[str], version: str, work: Callable[[DataFrame], DataFrame]) -> int:
        """Works on what is new or changed and publishes it; returns the version that then holds.

        `work` must keep the key and version columns. When nothing is pending no version is published.
        """
        before = self.version()
        folder = uuid.uuid4().hex
        out = work(self.pending(source, keys, version))
        missing = {*keys, version} - set(out.columns)
        if missing:
            raise ValueError(f"the work dropped {sorted(missing)}, which are the state")
        out.write.parquet(f"{self.path}/data/{folder}")
        if self.spark.read.parquet(f"{self.path}/data/{folder}").isEmpty():
            return before
        return self.publish([*self.folders(before), folder], before + 1)

    def publish(self, folders: list[str], version: int) -> int:
        """Makes `folders` the content of `version`, in one step or not at all.

        The version file is created exclusively under its final name, with its whole content in the one write that ends in
        close(); of two publishers the file system lets one through. (Renaming over a draft would not do: local file
        systems replace the target, and object stores copy.) A publisher that dies before close() leaves an unreadable
        file, which counts as no version and is put aside by the next one."""
        folder = self._at("versions")
        self._fs.mkdirs(folder)
        final = self._at("versions", f"{version}.json")
        if self._fs.exists(final) and self.content(version) is None and self._stale(final):
            self._fs.rename(final, self._at("versions", f".{version}.{uuid.uuid4().hex}.broken"))
        try:
            stream = self._fs.create(final, False)
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise ConcurrentPublish(f"version {version} of {self.path} is already there") from e
            raise
        stream.write(bytearray(json.dumps({"version": version, "folders": folders}).encode()))
        stream.close()
        return version

    def _stale(self, path, seconds: int = 600) -> bool:
        return self._jvm.java.lang.System.currentTimeMillis() - self._fs.getFileStatus(path).getModificationTime() > seconds * 1000

    def compact(self, keys: Sequence[str], version: str) -> int:
        """Publishes the latest row of each key as one folder: reading then lists one folder instead of all of the past.
        Older versions stay readable, as their folders do."""
        before = self.version()
        rows = self.read(before)
        if rows is None or len(self.folders(before)) < 2:
            return before
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("_r")).select("_r.*")
        folder = uuid.uuid4().hex
        newest.write.parquet(f"{self.path}/data/{folder}")
        return self.publish([folder], before + 1)


def due_objects(objects: DataFrame, peers: DataFrame, receipts: DataFrame) -> DataFrame:
    """(peer_id, object_id, head_version) of the objects that a peer's next pull must bring.

    An object is due for each peer of its current row's workspace if its greatest version first landed after the
    peer's last_pulled (any time if null, and not at the same microsecond) and the peer has committed neither that
    version nor a later one. Repeated deliveries and receipts count once; receipts of other objects or peers are
    ignored; objects without a workspace, and workspaces without a peer, give nothing.
    """
    heads = current_rows(objects, "workspace_id", "head_version", "ingested_at").withColumnRenamed("id", "object_id")
    asking = peers.select(F.col("id").alias("peer_id"), "workspace_id", "last_pulled").distinct()
    offered = lookup_join(heads.filter("workspace_id is not null"), asking, ["workspace_id"], spread=F.col("object_id"))
    offered = offered.filter(F.col("last_pulled").isNull() | (F.col("ingested_at") > F.col("last_pulled")))
    held = receipts.filter(F.col("status") == "committed").select("peer_id", "object_id", F.col("version").alias("head_version"))
    return not_yet_done(offered.select("peer_id", "object_id", "head_version"), held, ["peer_id", "object_id"], "head_version")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return due_objects(*[table(spark, folder, n) for n in ("knowledge_object", "sync_peer", "sync_receipt")])


def p6_by_peer(spark: SparkSession, folder: str) -> DataFrame:
    """Due objects and their greatest version for each peer that has any."""
    return p6_found(spark, folder).groupBy("peer_id").agg(F.count("*").alias("due"), F.max("head_version").alias("max_version"))


_SQL = """
WITH head AS (
  SELECT id, arg_min(workspace_id, (-head_version, ingested_at)) AS workspace_id, max(head_version) AS head_version,
    min(struct_pack(v := -head_version, at := ingested_at)).at AS landed
  FROM knowledge_object GROUP BY id),
done AS (SELECT peer_id, object_id, max(version) AS version FROM sync_receipt WHERE status = 'committed' GROUP BY 1, 2),
due AS (
  SELECT p.id AS peer_id, h.id AS object_id, h.head_version
  FROM (SELECT DISTINCT id, workspace_id, last_pulled FROM sync_peer) p JOIN head h USING (workspace_id)
  WHERE (p.last_pulled IS NULL OR h.landed > p.last_pulled)
    AND NOT EXISTS (SELECT 1 FROM done d WHERE d.peer_id = p.id AND d.object_id = h.id AND d.version >= h.head_version))
"""
SQL = {
    "p6_found": _SQL + "SELECT peer_id, object_id, head_version FROM due",
    "p6_by_peer": _SQL + "SELECT peer_id, count(*) AS due, max(head_version) AS max_version FROM due GROUP BY peer_id",
}
QUERIES = {"p6_found": p6_found, "p6_by_peer": p6_by_peer}
