"""Opening, reading and publishing element tables and their indexes.

A published dataset is a folder of immutable versions and a manifest that names the current one.  A version is written
completely before the manifest is replaced by a rename, so readers see all tables of one version or all of another.
Readers keep the version they opened.

A version has all rows, or it is a delta: the ids of the elements that it replaces, and their new rows in each table.  The
manifest lists the deltas on top of the last full version; a row counts if no later delta names its element.  After
``MAX_DELTAS`` of them a full version is written again.  All paths may be on any file system that Hadoop knows.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold import tables as T
from terrafold.files import Files
from terrafold.operators import indexes
from terrafold.scratch import Scratch

ELEMENT_TABLES = ("locations", "nodes", "ways", "relations")
ALL_TABLES = (*ELEMENT_TABLES, *indexes.COLUMNS)
#: Table -> the type of the elements whose rows it has, and the column of their id.
OWNER = {
    "locations": ("node", "id"), "nodes": ("node", "id"), "ways": ("way", "id"), "relations": ("relation", "id"), "cell_node": ("node", "node_id"),
    "node_way": ("way", "way_id"), "node_relation": ("relation", "relation_id"), "way_relation": ("relation", "relation_id"), "relation_relation": ("relation", "parent_id"),
}
SEQNUM, TIMESTAMP, FILENAME = "osmosis_replication_sequence_number", "osmosis_replication_timestamp", "import_filename"
MANIFEST = "_CURRENT.json"
#: Deltas on a full version until the next full version.
MAX_DELTAS = 16


def merged(base: DataFrame, deltas: list[tuple[DataFrame, DataFrame]], name: str) -> DataFrame:
    """A table of a full version and its deltas ``(touched ids, new rows)``, oldest first.

    touched: ``type, id``.  Rows know their layer and meet the last layer that names their element, in one join.
    """
    kind, key = OWNER[name]
    if not deltas:
        return base
    rows, last = base.withColumn("__layer", F.lit(0)), None
    for i, (touched, new) in enumerate(deltas, 1):
        rows = rows.unionByName(new.select(*base.columns).withColumn("__layer", F.lit(i)))
        ids = touched.where(F.col("type") == kind).select(F.col("id").alias(key), F.lit(i).alias("__last"))
        last = ids if last is None else last.unionByName(ids)
    last = last.groupBy(key).agg(F.max("__last").alias("__last"))
    return rows.join(last, key, "left").where("__last is null or __layer >= __last").select(*base.columns)


@dataclass
class OsmDataset:
    """Nine tables of one version and its metadata."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    metadata: dict[str, str] = field(default_factory=dict)
    version: int | None = None

    @staticmethod
    def from_raw(spark: SparkSession, folder: str, settled: tuple[str, ...] = ()) -> OsmDataset:
        """From element tables with repeated and older rows; the indexes follow from the current rows, lazily.

        settled: element tables whose current rows are written once, for work that reads them several times.
        """
        el = {n: getattr(T, f"current_{n}")(spark, folder) for n in ELEMENT_TABLES}
        if settled:
            scratch = Scratch(spark)
            el |= {n: scratch.save(el[n])[0] for n in settled}
        return OsmDataset.from_elements(spark, el)

    @staticmethod
    def from_elements(spark: SparkSession, el: dict[str, DataFrame], metadata: dict[str, str] | None = None) -> OsmDataset:
        ix = {n: indexes.build(n, el["locations"], el["ways"], el["relations"]) for n in indexes.COLUMNS}
        return OsmDataset(spark, {**el, **ix}, metadata or {})

    @staticmethod
    def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
        """What a version consists of: ``version, full, deltas, tables, metadata``."""
        files = Files(spark)
        m = json.loads(files.read(f"{root}/{MANIFEST}"))
        if version is not None and version != m["version"]:
            m = json.loads(files.read(f"{root}/v{version}/metadata.json"))
        return m

    @staticmethod
    def open(spark: SparkSession, root: str, version: int | None = None) -> OsmDataset:
        """The current version of a published dataset, or a given one."""
        m = OsmDataset.manifest(spark, root, version)
        read = lambda v, n: spark.read.parquet(f"{root}/v{v}/{n}")
        touched = {v: read(v, "touched") for v in m["deltas"]}
        tables = {n: merged(read(m["full"], n), [(touched[v], read(v, n)) for v in m["deltas"]], n) for n in m["tables"]}
        return OsmDataset(spark, tables, m["metadata"], m["version"])

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def get_metadata(self, key: str) -> str:
        """An absent key gives an empty text."""
        return self.metadata.get(key, "")

    def stats(self) -> DataFrame:
        """``table_name, n`` of the nine tables."""
        parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in self.tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def publish(self, root: str, partitions: int | None = None) -> int:
        """Write a new full version and make it current.

        Tables are range-partitioned and sorted by their first column, so that a lookup or a cell range reads only the row
        groups whose bounds hold it.
        """
        number = next_version(self.spark, root)
        for name, df in self.tables.items():
            _write(df, f"{root}/v{number}/{name}", partitions)
        return make_current(self.spark, root, {"version": number, "full": number, "deltas": [], "tables": list(self.tables), "metadata": self.metadata})

    def publish_delta(self, root: str, touched: DataFrame, new: dict[str, DataFrame], metadata: dict[str, str]) -> int:
        """Write a version that replaces the elements ``type, id`` by their new rows, and make it current.

        What is written grows with the number of these elements, not with the dataset.
        """
        m = OsmDataset.manifest(self.spark, root)
        if m["version"] != self.version:
            raise Busy(f"{root} is at version {m['version']}, not at {self.version}")
        number = next_version(self.spark, root)
        for name, df in {**{n: new[n] for n in m["tables"]}, "touched": touched}.items():
            df.coalesce(1 + len(df.columns) // 9).write.parquet(f"{root}/v{number}/{name}")
        m |= {"version": number, "deltas": [*m["deltas"], number], "metadata": {**self.metadata, **metadata}}
        make_current(self.spark, root, m)
        if len(m["deltas"]) >= MAX_DELTAS:
            return OsmDataset.open(self.spark, root).publish(root)
        return number


def _write(df: DataFrame, path: str, partitions: int | None) -> None:
    key = df.columns[0]
    spread = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    spread.sortWithinPartitions(key).write.parquet(path)


def next_version(spark: SparkSession, root: str) -> int:
    files = Files(spark)
    files.makedirs(root)
    return max((int(n[1:]) for n in files.names(root) if n[:1] == "v" and n[1:].isdigit()), default=0) + 1


def make_current(spark: SparkSession, root: str, manifest: dict) -> int:
    text = json.dumps({**manifest, "written": int(time.time())})
    files = Files(spark)
    files.write(f"{root}/v{manifest['version']}/metadata.json", text)
    files.replace(f"{root}/{MANIFEST}", text)
    return manifest["version"]


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete the versions that none of the newest ``keep`` versions is made of; readers that pinned one lose it."""
    files = Files(spark)
    there = sorted(int(n[1:]) for n in files.names(root) if n[:1] == "v" and n[1:].isdigit())
    whole = [v for v in there if files.exists(f"{root}/v{v}/metadata.json")]
    current = OsmDataset.manifest(spark, root)["version"]
    used: set[int] = {v for v in there if v > current}  # perhaps being written
    for v in {*[v for v in whole if v <= current][-max(1, keep) :], current}:
        m = OsmDataset.manifest(spark, root, v)
        used |= {v, m["full"], *m["deltas"]}
    gone = [v for v in there if v not in used]
    for v in gone:
        files.delete(f"{root}/v{v}")
    return gone


class Busy(RuntimeError):
    """Another writer is at work."""


@contextlib.contextmanager
def writer_lock(root: str, spark: SparkSession | None = None) -> Iterator[None]:
    """At most one writer of a dataset; raises Busy if there is one.

    On the local disk the lock ends with its process.  On other file systems it is a file that is created only if it
    doesn't exist; that of a writer that was killed must be deleted by hand, and Busy tells where it is.
    """
    if "://" in root and not root.startswith("file://"):
        files, path = Files(spark or SparkSession.active()), f"{root}/.lock"
        files.makedirs(root)
        try:
            files.write(path, f"{os.uname().nodename} {os.getpid()} {int(time.time())}", new=True)
        except Exception as e:
            raise Busy(path) from e
        try:
            yield
        finally:
            files.delete(path)
        return
    import fcntl

    root = root.removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, ".lock"), "w") as f:
        try:
            fcntl.lockf(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise Busy(root) from e
        try:
            yield
        finally:
            fcntl.lockf(f, fcntl.LOCK_UN)
