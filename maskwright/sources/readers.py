"""Corpora from files: one row per file with path, extension, kind and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import extension, kind_label
from ..rules import CODE_KINDS, DOCUMENT_KINDS
from .formats import csv_line, csv_text, html_text, json_layout, json_valid, mail_text, universal_newlines, xml_error, xml_outline


def read_files(spark: SparkSession, paths, recursive: bool = True) -> DataFrame:
    """SRC-1 / SRC-2: whole files as valid UTF-8, wrong bytes replaced."""
    files = spark.read.option("recursiveFileLookup", recursive).text(paths, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(
        path.alias("path"), extension(path).alias("ext"), F.make_valid_utf8("value").alias("raw")
    )


def document_text(ext: Column, raw: Column) -> Column:
    """SRC-8: the reader of each extension; unknown ones are plain text."""
    return (
        F.when(ext == "eml", mail_text(raw))
        .when(ext == "csv", csv_text(raw))
        .when(ext == "html", html_text(universal_newlines(raw)))
        .when(ext == "json", json_layout(raw))
        .when(ext == "xml", xml_outline(universal_newlines(raw)))
        .otherwise(universal_newlines(raw))
    )


def with_document_text(files: DataFrame, ext: str = "ext", raw: str = "raw") -> DataFrame:
    """Adds ``kind``, ``text`` and ``error``; a file that cannot be read has a NULL text."""
    e, r = F.col(ext), F.col(raw)
    return (
        files.withColumn("kind", kind_label(e, DOCUMENT_KINDS))
        .withColumn("text", document_text(e, r))
        .withColumn("error", F.when((e == "json") & ~json_valid(r), F.lit("invalid JSON")).when(
            e == "xml", xml_error(universal_newlines(r))
        ))
        .withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
    )


def read_documents(spark: SparkSession, paths) -> DataFrame:
    return with_document_text(read_files(spark, paths)).drop("raw")


def read_code(spark: SparkSession, paths) -> DataFrame:
    """SRC-2: source files; files of unknown kinds are scanned too."""
    files = read_files(spark, paths)
    return files.select(
        "path", "ext", kind_label(F.col("ext"), CODE_KINDS).alias("kind"),
        F.col("ext").isin(*CODE_KINDS).alias("known"), universal_newlines(F.col("raw")).alias("text"),
    )


def table_lines(df: DataFrame, columns: list[str], into: str = "text") -> DataFrame:
    """SRC-3 for tables and splittable CSV: each record becomes a pipe-joined line."""
    return df.withColumn(into, csv_line(F.array(*[F.col(c).cast("string") for c in columns])))


def read_csv_lines(spark: SparkSession, paths) -> DataFrame:
    """SRC-3 for large CSV files: lines are split over tasks, the header is a line too.

    Every line is a record with as many cells as it has; a blank one gives an empty
    text.  Files whose quoted cells hold line ends are for ``records.read_csv_records``.
    """
    lines = spark.read.text(paths)
    return lines.select(F.col("_metadata.file_path").alias("path"), csv_text(F.col("value")).alias("text"))


def read_scanner_reports(spark: SparkSession, paths) -> DataFrame:
    """VUL-21: JSON report files of an outside code scanner, one report per file."""
    from ..operators.report import EXTERNAL_SCHEMA

    return spark.read.schema(EXTERNAL_SCHEMA).option("multiLine", True).json(paths).select(
        F.col("_metadata.file_path").alias("path"), "results"
    )
