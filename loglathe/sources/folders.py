"""Folders of files to folders of files: one output for each input, and a marker once all are there.

Lines go to their outputs in blocks, so that one large file is written by many tasks: its first LINES
lines are ``<name>.classified.jsonl``, the next ones ``<name>.classified.part-00001.jsonl``, and so on,
so that outputs in the order of their names are in that of the lines.  A
Python data source writes them: tasks write under names of their own attempt, and only when all have
ended well does the driver move what they tell it they wrote, and then write the marker.  A failed run
takes away what it wrote and leaves no marker; running again gives the same bytes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.literals import parsed, strip
from ..operators.records import canonical_json
from .lines import choose_domain, raw_events
from .numbering import file_name, numbered_lines
from .shared import stored

#: Lines of an input that one output holds.
LINES = 1_000_000
#: The marker's name (fixed value).
DONE = "_DONE"


def output_name(name: str, block: int = 0) -> str:
    """``<base>.classified.jsonl``: the name without .jsonl, or the whole name of another file."""
    base = re.sub(r"\.jsonl$", "", name) + ".classified"
    return f"{base}.part-{block:05}.jsonl" if block else f"{base}.jsonl"


@dataclass
class Written(WriterCommitMessage):
    """Outputs of one task: (where it is, what it is to be called)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class InputFiles(DataSource):
    """Writes rows (source_file, block, value) that come in order, each (source_file, block) within one
    partition, to one file for each; rows without a value make an empty file."""

    @classmethod
    def name(cls) -> str:
        return "classified_files"

    def schema(self) -> str:
        return "source_file string, block bigint, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("marker", DONE))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, marker: str):
        self.path, self.marker, self.run = path, marker, uuid.uuid4().hex
        self.unmark()

    def unmark(self) -> None:
        """A marker speaks of a whole run only: it goes before anything is written."""
        files, root = self.files()
        files.create_dir(root, recursive=True)
        if files.get_file_info(f"{root}/{self.marker}").is_file:
            files.delete_file(f"{root}/{self.marker}")

    def files(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path)

    def staging(self, root: str) -> str:
        return f"{root}/.staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = self.files()
        folder = f"{self.staging(root)}/{TaskContext.get().taskAttemptId()}"
        out, done, key = None, Written(), None
        try:
            for batch in iterator:
                names, blocks, values = (batch.column(c).to_pylist() for c in ("source_file", "block", "value"))
                for *at, value in zip(names, blocks, values, strict=True):
                    if at != key:
                        if out:
                            out.close()
                        else:
                            files.create_dir(folder, recursive=True)
                        key, staged = at, f"{folder}/{len(done.files)}"
                        out = files.open_output_stream(staged)
                        done.files.append((staged, f"{root}/{output_name(*at)}"))
                    if value is not None:
                        out.write(value.encode() + b"\n")
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self.files()
        for message in messages:
            for staged, final in message.files if message else ():
                files.move(staged, final)
        self.clear(files, root)
        with files.open_output_stream(f"{root}/{self.marker}"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*self.files())

    def clear(self, files, root: str) -> None:
        from pyarrow.fs import FileType

        if files.get_file_info(self.staging(root)).type == FileType.Directory:
            files.delete_dir(self.staging(root))


def write_outputs(rows: DataFrame, path: str, name: str = "value", lines: int = LINES, inputs: DataFrame | None = None) -> None:
    """Text rows (source_file, line, name) to one output for each source_file, in the order of line; inputs
    (source_file): files that have an output even if no row is theirs.  path: a folder that driver and
    executors reach."""
    spark = rows.sparkSession
    spark.dataSource.register(InputFiles)
    _Writer(path, DONE)  # Spark makes the writer only once the rows are worked out; the marker goes before
    block = F.floor(F.col("line") / lines).alias("block")
    # a file's first block may have no row left: it is written all the same
    heads = (inputs if inputs is not None else rows).select("source_file").distinct().select("source_file", F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("line"), F.lit(None).cast("string").alias("value"))
    every = rows.select("source_file", block, F.col("line").cast("long").alias("line"), F.col(name).alias("value")).unionByName(heads)
    dealt = every.repartition("source_file", "block").sortWithinPartitions("source_file", "block", "line")
    dealt.select("source_file", "block", "value").write.format("classified_files").mode("append").save(path)


def formats(rows: DataFrame, probe: int = 50) -> DataFrame:
    """Rows (source_file, format) of rows (source_file, _seq, given): ``raw`` or ``json`` by the first of a
    file's first rows that tells (``@message``, or ``timestamp`` and ``meta``), else by any ``@message``,
    else json."""
    has = lambda k: F.map_contains_key("given", F.lit(k))
    kind = F.when(has("@message"), "raw").when(has("timestamp") & has("meta"), "json")
    first = rows.groupBy("source_file").agg(F.min(F.when(kind.isNotNull(), F.struct("_seq", kind.alias("kind")))).alias("first"), F.bool_or(has("@message")).alias("any"))
    first = stored(first, "formats")
    # rows before the first that tells, no more of them than there are up to it
    before = rows.select("source_file", "_seq").join(F.broadcast(first.select("source_file", "first")), "source_file").where(F.col("_seq") < F.col("first._seq")).groupBy("source_file").agg(F.count("*").alias("before"))
    told = first.join(before, "source_file", "left")
    return told.select("source_file", F.when(F.coalesce("before", F.lit(0)) < probe, F.col("first.kind")).otherwise(F.when(F.col("any"), "raw")).alias("format")).na.fill("json", ["format"])


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (source_file): the files of a folder as Spark lists them, empty ones as well."""
    paths = spark.createDataFrame([(x,) for x in spark.read.text(path).inputFiles()], "path string")
    return paths.select(file_name(F.regexp_extract("path", "([^/]*)$", 1)).alias("source_file"))


def classify_folder(spark: SparkSession, path: str, out: str, domain: str | None = None, validate: bool = True, lines: int = LINES) -> None:
    """Labels the lines of every JSONL file of a folder, in the order of names, and writes one output for
    each with a marker at last.

    A line that isn't JSON is left out; a file is raw or holds records, as its first lines tell, and is
    of the domain given, or of the one that its name hints at, or else each line finds its own.
    Names that start with _ or . are left out.
    """
    from ..plans.pipeline import Options, classify_lines, classify_records

    names = stored(input_files(spark, path), "names")
    found = numbered_lines(spark, path).withColumn("value", strip(F.col("value"))).where("value <> ''")
    found = found.withColumn("given", parsed(F.col("value"))).where(F.col("given").isNotNull())
    told = formats(found)
    hints = {}
    for r in stored(told, "told").collect():  # a row for each file
        hints.setdefault((r["format"], choose_domain(domain, r["source_file"])[0]), []).append(r["source_file"])
    done = None
    for (form, hint), files in sorted(hints.items(), key=str):
        some, options = found.where(F.col("source_file").isin(files)), Options(domain=hint, validate=validate)
        labelled = classify_lines(raw_events(some), options) if form == "raw" else classify_records(some.drop("given"), options)
        labelled = labelled.select("source_file", "line", canonical_json(F.col("record")).alias("value"))
        done = labelled if done is None else done.unionByName(labelled)
    if done is None:
        done = found.select("source_file", "line", "value").limit(0)
    write_outputs(done, out, lines=lines, inputs=names)


