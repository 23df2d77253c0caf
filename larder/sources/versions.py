"""Versioned datasets: numbered manifests name the data folders of each version, the highest one is current.

A dataset lies below a base folder. Data are written to a folder of their own, which no reader knows of; then one small
manifest file, written aside and renamed to its number, makes them the current version. The rename refuses a number that is
taken, so of two writers who started from one version the second gets a ``VersionConflict`` and nothing of the first is
lost (atomic on HDFS; a local file system checks and renames). Readers resolve the base folder through the manifests and keep
reading the folders of the version they started with; older versions are backups until ``prune`` deletes them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larder.sources.tables import file_system, new_version_path, write_parquet

_FOLDER = "_manifests"


class VersionConflict(RuntimeError):
    """Another writer has published a version since the one that this writer started from."""


@dataclass(frozen=True)
class Version:
    """One published state. ``folders`` are paths below the base, by part ('' for a dataset that is one part)."""

    number: int
    parent: int
    folders: dict[str, list[str]]
    schema: str
    info: dict = field(default_factory=dict)

    def paths(self, base: str, parts: list[str] | None = None) -> list[str]:
        return [f"{base.rstrip('/')}/{f}" for part in (self.folders if parts is None else parts)
                for f in self.folders.get(part, [])]


def _manifests(base: str) -> str:
    return f"{base.rstrip('/')}/{_FOLDER}"


def history(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions that are kept, ascending."""
    fs, folder = file_system(spark, _manifests(base))
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, base: str, number: int | None = None) -> Version | None:
    """The version of that number, or the current one; None where nothing has been published."""
    known = history(spark, base)
    if number is None:
        if not known:
            return None
        number = known[-1]
    if number not in known:
        raise FileNotFoundError(f"{base} has no version {number}; kept: {known}")
    fs, path = file_system(spark, f"{_manifests(base)}/{number:020d}.json")
    stream = fs.open(path)
    try:
        return Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def publish(spark: SparkSession, base: str, folders: dict[str, list[str]], schema: T.StructType, expected: int,
            info: dict | None = None) -> Version:
    """Make ``folders`` the version after ``expected`` (0: none yet), or raise ``VersionConflict``."""
    new = Version(expected + 1, expected, folders, schema.json(), info or {})
    known = history(spark, base)
    if (known[-1] if known else 0) != expected:
        raise VersionConflict(f"{base} is at version {known[-1] if known else 0}, not {expected}")
    folder = _manifests(base)
    fs, aside = file_system(spark, f"{folder}/.{new.number:020d}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(asdict(new)).encode()))
    finally:
        out.close()
    _, final = file_system(spark, f"{folder}/{new.number:020d}.json")
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(aside).toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(aside), fs.makeQualified(final), none)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise VersionConflict(f"{base} has got version {new.number} from another writer") from None
        raise
    return new


def read_version(spark: SparkSession, base: str, number: int | None = None, parts: list[str] | None = None) -> DataFrame:
    """The dataset at ``base``: its current version, or the one of that number; of a dataset in parts, all or the named ones."""
    found = version(spark, base, number)
    if found is None:
        raise FileNotFoundError(f"{base} has no published version")
    schema, paths = T.StructType.fromJson(json.loads(found.schema)), found.paths(base, parts)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace_dataset(df: DataFrame, base: str, codec: str = "zstd", expected: int | None = None, keep: int | None = None) -> str:
    """Write ``df`` as the next version of the dataset at ``base`` and make it current; returns its folder.

    ``df`` may read the version that is replaced, which stays in place as the backup. The new version follows the one that
    was current when the call began, or ``expected``; a writer who was overtaken gets a ``VersionConflict``, and what it
    wrote is deleted. ``keep`` deletes all but that many latest versions.
    """
    spark = df.sparkSession
    if expected is None:
        known = history(spark, base)
        expected = known[-1] if known else 0
    path = write_parquet(df, new_version_path(base), codec)
    try:
        publish(spark, base, {"": [path.rsplit("/", 1)[1]]}, df.schema, expected)
    except VersionConflict:
        fs, own = file_system(spark, path)
        fs.delete(own, True)
        raise
    if keep is not None:
        prune(spark, base, keep)
    return path


def prune(spark: SparkSession, base: str, keep: int) -> list[int]:
    """Delete all but the ``keep`` latest versions, and the data folders that none of those names; returns the numbers deleted.
    A reader still at a deleted version fails, so keep as many as readers may be behind."""
    if keep < 1:
        raise ValueError("the current version has to stay")
    known = history(spark, base)
    old = known[:-keep]
    held = {f for n in known[-keep:] for part in version(spark, base, n).folders.values() for f in part}
    for n in old:
        gone = {f for part in version(spark, base, n).folders.values() for f in part} - held
        fs, path = file_system(spark, f"{_manifests(base)}/{n:020d}.json")
        fs.delete(path, False)  # first the name, then what it names
        for f in gone:
            fs.delete(file_system(spark, f"{base.rstrip('/')}/{f}")[1], True)
    return old
