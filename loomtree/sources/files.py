"""A run's state directory: text and JSON files read as frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtree.operators.lines import text_lines
from loomtree.sources.tables import latest

SNAPSHOT = "doc STRING, next_start_line BIGINT, next_chunk_id INT, sections_completed INT"


@dataclass(frozen=True)
class StateDir:
    """Locations below one root, which may be any file system that Spark reads."""

    root: str

    def at(self, *parts: str) -> str:
        return "/".join((self.root.rstrip("/"), *parts))

    @property
    def raw(self) -> str:
        return self.at("raw")

    @property
    def clean(self) -> str:
        return self.at("clean")

    @property
    def logs(self) -> str:
        return self.at("logs")

    @property
    def failures(self) -> str:
        return self.at("failures")

    @property
    def tree(self) -> str:
        return self.at("tree")

    @property
    def snapshot(self) -> str:
        return self.at("state")

    @property
    def memory(self) -> str:
        return self.at("memory.md")

    @property
    def final(self) -> str:
        return self.at("final")

    @property
    def commits(self) -> str:
        return self.at("commits")

    @property
    def lines(self) -> str:
        return self.at("lines")

    @property
    def documents(self) -> str:
        return self.at("documents")


def read_table(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """A table of the state directory, empty if it was never written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(form).load(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, line_no, line) of raw files, doc being the path."""
    return text_lines(read_text(spark, path), "path", None, "text", as_file=True).drop("chunk")


def read_json(spark: SparkSession, path: str, schema: str, *, one_a_file: bool = True) -> DataFrame:
    """JSON documents, one a file or, else, one a line."""
    return spark.read.schema(schema).json(path, multiLine=one_a_file)


def read_snapshot(spark: SparkSession, state: StateDir) -> DataFrame:
    """The saved cursors of each document; sections_completed may be missing in old files, the other two must be there."""
    rows = read_table(spark, state.snapshot, SNAPSHOT + ", written_at TIMESTAMP", "json")
    need = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"snapshot without {c}"))).otherwise(F.col(c)).alias(c) for c in ("next_start_line", "next_chunk_id")]
    return latest(rows, "doc").select("doc", *need, F.coalesce("sections_completed", F.lit(0)).alias("sections_completed"))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, run_id, tree_json) of tree files, numbered in path order, as the tree operators take them."""
    rows = read_text(spark, path)
    return rows.select(F.xxhash64("path").alias("tree_id"), F.lit(None).cast("bigint").alias("run_id"), F.col("text").alias("tree_json"))


def read_memory(spark: SparkSession, state: StateDir) -> str:
    """The memory text, '' if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(state.memory)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return ""
    return read_text(spark, state.memory).first().text
