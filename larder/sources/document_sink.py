"""A sink that sends documents in commits of a fixed size and accounts for every row: success, failed or skipped.

Collections take documents in commits (50 rows when publishing, 400 when patching tags), and a commit goes through whole or not
at all. ``commit_documents`` numbers the rows by key into commits, deals whole commits to tasks and writes them with a Python
data source. A task checks a commit before it sends it: one document that cannot be stored fails the commit, whose rows are
written down with the reason, and the next commit goes on. Rows that are not in the target are skipped and counted.

Each task writes its commits to a file of its own attempt. When all tasks are done the driver writes the outcome with the names of
the files that count, so files of lost or repeated attempts are never read, and a job that failed leaves no outcome and no file
of the tasks that had finished. The folder must be one that driver and executors share, of a kind that Arrow's file systems open.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from larder.operators.ordering import fixed_size_groups

# tasks unpickle the sink, and executors need no copy of this library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Commit sizes of publishing and of tag patches, and the largest document that a collection stores
PUBLISH_COMMIT, PATCH_COMMIT, MAX_DOCUMENT_BYTES = 50, 400, 1 << 20
_COUNTS = ("total", "success", "failed", "skipped", "commits", "failed_commits")


@dataclass
class TaskOutcome(WriterCommitMessage):
    """What became of a task's rows; at most two file names go to the driver."""

    counts: dict
    files: list
    failed_files: list


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class CommitWriter(DataSourceArrowWriter):
    """Rows (chunk, id, document, known) sorted by chunk; a chunk is a commit."""

    def __init__(self, path: str, job: str, max_bytes: int):
        self.path, self.job, self.max_bytes = path.rstrip("/"), job, max_bytes

    def problem(self, doc_id: str | None, document: str) -> str | None:
        """Why a document cannot be stored."""
        if not doc_id:
            return "id is required"
        size = len(document.encode())
        return f"document of {size} bytes exceeds {self.max_bytes}" if size > self.max_bytes else None

    def write(self, iterator: Iterator) -> TaskOutcome:
        context = TaskContext.get()
        name = f"{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}.json"
        system, folder = _open(self.path)
        counts, out = dict.fromkeys(_COUNTS, 0), {}

        def line(kind: str, row: dict) -> None:
            if kind not in out:
                system.create_dir(f"{folder}/{kind}", recursive=True)
                out[kind] = system.open_output_stream(f"{folder}/{kind}/{name}")
            out[kind].write((json.dumps(row) + "\n").encode())

        def commit(chunk: int, rows: list) -> None:
            known = [(i, d) for i, d, k in rows if k]
            counts["total"] += len(rows)
            counts["skipped"] += len(rows) - len(known)
            if not known:
                return
            problems = [(i, why) for i, d in known if (why := self.problem(i, d))]
            counts["commits"] += 1
            if problems:
                counts["failed_commits"] += 1
                counts["failed"] += len(known)
                reason = f"{problems[0][0]}: {problems[0][1]}"
                for i, _ in known:
                    line("failed", {"chunk": chunk, "id": i, "error": reason})
                return
            for i, d in known:
                line("commits", {"chunk": chunk, "id": i, "document": d})
            counts["success"] += len(known)

        chunk, rows = None, []
        for batch in iterator:
            for c, *row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if c != chunk and rows:
                    commit(chunk, rows)
                    rows = []
                chunk = c
                rows.append(row)
        if rows:
            commit(chunk, rows)
        for stream in out.values():
            stream.close()
        return TaskOutcome(counts, *([name] if kind in out else [] for kind in ("commits", "failed")))

    def commit(self, messages: list) -> None:
        """All tasks are done: publish the outcome, by one file."""
        done = [m for m in messages if m]
        outcome = {c: sum(m.counts[c] for m in done) for c in _COUNTS}
        outcome |= {"files": [f for m in done for f in m.files], "failed_files": [f for m in done for f in m.failed_files]}
        system, folder = _open(self.path)
        system.create_dir(f"{folder}/outcomes", recursive=True)
        with system.open_output_stream(f"{folder}/outcomes/.{self.job}") as out:
            out.write(json.dumps(outcome).encode())
        system.move(f"{folder}/outcomes/.{self.job}", f"{folder}/outcomes/{self.job}.json")

    def abort(self, messages: list) -> None:
        """The job failed: what finished tasks wrote is deleted."""
        system, folder = _open(self.path)
        for m in messages:
            for kind, names in (("commits", m.files), ("failed", m.failed_files)) if m else ():
                for name in names:
                    system.delete_file(f"{folder}/{kind}/{name}")


class CommitSink(DataSource):
    """``df.write.format("recipe_commits")`` of rows (chunk, id, document, known); options path, job and maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "recipe_commits"

    def writer(self, schema, overwrite: bool) -> CommitWriter:
        # option names arrive in lower case
        return CommitWriter(self.options["path"], self.options["job"], int(self.options["maxbytes"]))


@dataclass
class Outcome:
    """Counts of a finished job, and its rows."""

    total: int
    success: int
    failed: int
    skipped: int
    commits: int
    failed_commits: int
    stored: DataFrame
    failures: DataFrame


def _lines(spark: SparkSession, folder: str, names: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json([f"{folder}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def commit_documents(docs: DataFrame, path: str, size: int = PUBLISH_COMMIT, key: str = "id", existing: DataFrame | None = None,
                     max_bytes: int = MAX_DOCUMENT_BYTES) -> Outcome:
    """Send ``docs`` in commits of ``size`` rows in key order to the folder ``path``. With ``existing`` (a table of ids) rows whose
    key is not among them are skipped, as in a patch; they keep their place in a commit and are not sent."""
    if size < 1:
        raise ValueError("a commit holds one row at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("id"), F.to_json(F.struct(*docs.columns)).alias("document"))
    if existing is not None:
        there = existing.select(F.col(existing.columns[0]).cast("string").alias("_k")).distinct()
        rows = rows.join(there, F.col("id") == F.col("_k"), "left").select("id", "document", F.col("_k").isNotNull().alias("known"))
    else:
        rows = rows.withColumn("known", F.lit(True))
    chunks = fixed_size_groups(rows, "id", size).select(F.col("group").cast("long").alias("chunk"), "id", "document", "known", "idx")
    spark.dataSource.register(CommitSink)
    job = uuid.uuid4().hex
    (chunks.repartition("chunk").sortWithinPartitions("chunk", "idx").drop("idx").write.format("recipe_commits").mode("append")
     .option("path", path).option("job", job).option("maxBytes", str(max_bytes)).save())
    done = json.loads(spark.read.text(f"{path}/outcomes/{job}.json", wholetext=True).first()[0])
    return Outcome(*(done[c] for c in _COUNTS),
                   _lines(spark, f"{path}/commits", done["files"], "chunk long, id string, document string"),
                   _lines(spark, f"{path}/failed", done["failed_files"], "chunk long, id string, error string"))
