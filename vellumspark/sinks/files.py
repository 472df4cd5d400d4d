"""Binary rows written as files of their own: fonts, pictures; under a commit protocol.

A task writes to a staging folder of its own attempt, under the names its files will have, and lists those names beside it.
Only once every task has ended do the files of the attempts that Spark counts move to their places; an attempt that failed,
or that a faster copy of its task overtook, leaves nothing, and if a task cannot end nothing appears at all. Names stay in
tables, files are moved and read by tasks: the driver holds what attempts there are, and no list of files. If a move
cannot be done, the files that have moved stay and the others go.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.session import scratch_dir

#: Where attempts write below the folder, and how many files move at a time.
STAGING, MOVES = "_staging", 16
#: Names that an attempt holds before it lists them, files that a task moves or reads, and bytes of files that leave together.
HELD, DEALT, AT_ONCE = 1 << 12, 1 << 14, 1 << 24
#: An attempt's list.
LISTED = "name string, attempt string"


def checked_name(name: str) -> str:
    """``name`` if it stays inside its folder: parts joined by "/", none of them empty, "." or "..", none beginning with the staging folder's name."""
    if any(part in ("", ".", "..") for part in name.split("/")) or "\\" in name or "\0" in name or name.startswith(STAGING):
        raise ValueError(f"not a name for a file below the folder: {name!r}")
    return name


def staged(folder: str, job: str) -> tuple:
    """(file system, the folder's path in it, the path of the job's staging folder)."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    return store, root, f"{root}/{STAGING}-{job}"


def moved(folder: str, job: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of the listed files, once they have moved from their attempts' folders to their places; a file that an earlier run moved stays there."""
    from concurrent.futures import ThreadPoolExecutor

    from pyarrow import fs

    store, root, top = staged(folder, job)
    made: set[str] = set()

    def move(name: str, attempt: str) -> None:
        source, to = f"{top}/{attempt}/{name}", f"{root}/{name}"
        if (place := to.rpartition("/")[0]) not in made:
            store.create_dir(place, recursive=True)
            made.add(place)
        try:
            store.move(source, to)
        except OSError:
            if [f.type for f in store.get_file_info([source, to])] != [fs.FileType.NotFound, fs.FileType.File]:
                raise

    with ThreadPoolExecutor(MOVES) as pool:
        for batch in batches:
            list(pool.map(move, batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield batch.select(["name"])


def clean(folder: str, job: str) -> None:
    """Remove the job's staging folder."""
    from pyarrow import fs

    store, _, top = staged(folder, job)
    if store.get_file_info(top).type == fs.FileType.Directory:
        store.delete_dir(top)


def file_source() -> type:
    """The data source "named_files" of rows (name, data). The classes are made here so that they travel whole to where they run.

    With the option ``job``, the files stay in that job's staging folder, and the lists of the attempts that count are in
    its folder "counted"; ``moved`` does the rest. Without it they move at the commit.
    """
    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    check, stage, move, remove, most = checked_name, staged, moved, clean, HELD

    class Done(WriterCommitMessage):
        def __init__(self, attempt: str, n: int):
            self.attempt, self.n = attempt, n

    class Files(DataSourceWriter):
        def __init__(self, folder: str, job: str | None):
            self.folder, self.job, self.later = folder, job or uuid.uuid4().hex, job is not None

        def write(self, iterator: Iterator) -> Done:
            from pyarrow import parquet

            store, _, top = stage(self.folder, self.job)
            attempt, n, made, held = uuid.uuid4().hex, 0, set(), []
            store.create_dir(f"{top}/lists", recursive=True)
            with parquet.ParquetWriter(f"{top}/lists/{attempt}.parquet", pa.schema([("name", pa.string()), ("attempt", pa.string())]), filesystem=store) as lists:

                def list_held() -> None:
                    lists.write_batch(pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([attempt] * len(held), pa.string())], ["name", "attempt"]))
                    held.clear()

                for row in iterator:
                    path = f"{top}/{attempt}/{check(row[0])}"
                    if (place := path.rpartition("/")[0]) not in made:
                        store.create_dir(place, recursive=True)
                        made.add(place)
                    with store.open_output_stream(path) as out:
                        out.write(bytes(row[1]))
                    held.append(row[0])
                    n += 1
                    if len(held) == most:
                        list_held()
                list_held()
            return Done(attempt, n)

        def commit(self, messages: list) -> None:
            from pyarrow import parquet

            store, _, top = stage(self.folder, self.job)
            store.create_dir(f"{top}/counted", recursive=True)
            for message in messages:
                if message and message.n:
                    store.move(f"{top}/lists/{message.attempt}.parquet", to := f"{top}/counted/{message.attempt}.parquet")
                    if not self.later:
                        with store.open_input_file(to) as names:
                            for _ in move(self.folder, self.job, parquet.ParquetFile(names).iter_batches(most)):
                                pass
            if not self.later:
                remove(self.folder, self.job)

        def abort(self, messages: list) -> None:
            remove(self.folder, self.job)

    class NamedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "named_files"

        def schema(self) -> str:
            return "name string, data binary"

        def writer(self, schema, overwrite: bool) -> Files:
            return Files(self.options["path"], self.options.get("job"))

    return NamedFiles


def _dealt(names: DataFrame) -> DataFrame:
    """``names`` dealt to tasks that have some thousands of them each, however small the table is."""
    return names.repartition(max(names.sparkSession.sparkContext.defaultParallelism, -(-names.count() // DEALT)), "name")


def write_files(df: DataFrame, folder: str, name: Column, data: Column) -> DataFrame:
    """Write ``data`` of each row to ``folder``/``name``; (name): the names of the files written, kept as a table in the shared scratch folder.

    ``folder`` is a URI that all executors reach; names may hold folders but never leave it. Rows with a null name or
    null data write nothing, and of rows with one name the one with the least digest is written. A
    file is complete under its own name or absent; one that stood there before is replaced.
    """
    spark, job, kept = df.sparkSession, uuid.uuid4().hex, scratch_dir(df.sparkSession)
    rows = df.select(name.alias("name"), data.alias("data")).where("name is not null and data is not null")
    once = rows.groupBy("name").agg(F.min_by("data", F.sha2("data", 256)).alias("data"))
    spark.dataSource.register(file_source())
    once.write.format("named_files").option("path", folder).option("job", job).mode("append").save()
    try:
        lists = spark.read.schema(LISTED).parquet(f"{folder.rstrip('/')}/{STAGING}-{job}/counted")
        _dealt(lists).mapInArrow(lambda batches: moved(folder, job, batches), "name string").write.parquet(kept)
    finally:
        clean(folder, job)
    return spark.read.schema("name string").parquet(kept)


def read_files(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """(name, content) of the files under ``folder`` that are not empty; names are relative to it.

    With ``names`` (name), as ``write_files`` gives them, tasks read those files and nothing is listed; without, Spark
    lists the folder, and its driver holds an entry for each file.
    """
    if names is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        return files.select(F.regexp_replace("path", f"^.*{folder.rstrip('/').rpartition('/')[2]}/", "").alias("name"), "content")

    most = AT_ONCE

    def read(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            found, size = [], 0
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{checked_name(name)}") as file:
                    if content := file.read():
                        found.append((name, content))
                        size += len(content)
                if size >= most:
                    yield _contents(found)
                    found, size = [], 0
            yield _contents(found)

    return _dealt(names.select("name")).mapInArrow(read, "name string, content binary")


def _contents(found: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], ["name", "content"])
