"""Folders as tables: documents, notes, chat logs and file times, through the binaryFile source."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T

DOCUMENT_SUFFIXES = (".txt", ".md", ".pdf", ".docx", ".xlsx")


def _roots(spark: SparkSession, folder: str) -> list[str]:
    """The folder and all folders below whose names begin with _ or . : Spark's listing skips those unless they are named."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    top = fs_path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    roots, todo = [folder], [top]
    while todo:
        for entry in fs.listStatus(todo.pop()):
            if entry.isDirectory():
                todo.append(entry.getPath())
                if entry.getPath().getName()[0] in "_.":
                    roots.append(entry.getPath().toString())
    return roots


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(path, rel_path, name, ext, mtime, size, content) of all files below a folder. Columns that a query doesn't use aren't read: file times need no contents.

    Files whose own names begin with _ or . are left out, as Spark's listing does; folders of such names are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_roots(spark, folder))
    path = F.expr("url_decode(replace(regexp_replace(path, '^file:/*', '/'), '+', '%2B'))")
    rel = F.regexp_replace(F.expr(f"substring(p, length('{folder.rstrip('/').replace(chr(39), chr(92) + chr(39))}') + 2)"), "^/+", "")
    df = raw.withColumn("p", path).select(F.col("p").alias("path"), rel.alias("rel_path"), T.basename(F.col("p")).alias("name"), T.suffix(F.col("p")).alias("ext"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), F.col("length").alias("size"), "content")
    return df.where(F.col("ext").isin(*suffixes)) if suffixes else df


def decoded(content: Column) -> Column:
    """UTF-8 with a replacement character for each malformed part."""
    return F.make_valid_utf8(content.cast("string"))


def _optional(name: str):
    try:
        return __import__(name)
    except ImportError:
        return None


def _extract(ext: str, raw: bytes) -> str:
    """The text of a PDF, DOCX or XLSX file. Without its library a PDF gives its raw text, the others nothing."""
    if ext == ".pdf":
        if lib := _optional("pypdf"):
            return "\n".join(page.extract_text() or "" for page in lib.PdfReader(io.BytesIO(raw)).pages)
        return raw.decode("utf-8", "replace")
    if ext == ".docx":
        lib = _optional("docx")
        return "\n".join(p.text for p in lib.Document(io.BytesIO(raw)).paragraphs) if lib else ""
    if ext == ".xlsx" and (lib := _optional("openpyxl")):
        book = lib.load_workbook(io.BytesIO(raw), read_only=True, data_only=True)
        return "\n".join(" ".join(str(c) for c in row if c is not None) for sheet in book.worksheets for row in sheet.iter_rows(values_only=True))
    return ""


def _office(ext: pd.Series, content: pd.Series) -> pd.Series:
    def one(e: str, raw: bytes | None) -> str | None:
        try:
            return _extract(e, raw or b"")
        except Exception:  # a broken file is a row without text, not a failed job
            return None

    return pd.Series([one(e, raw) for e, raw in zip(ext, content)], dtype=object)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rel_path, name, ext, mtime, size, content, error): texts of all supported documents.

    Text and Markdown are decoded in the JVM; only the other formats go through Python. A
    file that can't be parsed has empty content and error set.
    """
    files = scan(spark, folder, DOCUMENT_SUFFIXES)
    plain = F.col("ext").isin(".txt", ".md")
    office = files.where(~plain).withColumn("_text", F.pandas_udf(_office, "string")("ext", "content"))
    both = files.where(plain).withColumn("_text", decoded(F.col("content"))).unionByName(office)
    return both.select("path", "rel_path", "name", "ext", "mtime", "size", F.coalesce("_text", F.lit("")).alias("content"), F.col("_text").isNull().alias("error"))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, (".md",)).withColumn("content", decoded(F.col("content")))


def read_chat_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line_num, line) of all lines of .jsonl files that aren't blank; numbers from 1."""
    lines = scan(spark, folder, (".jsonl",)).select("path", F.posexplode(F.split(decoded(F.col("content")), r"\r\n|\n|\r")).alias("at", "line"))
    return lines.where(~T.is_blank(F.col("line"))).select("path", (F.col("at") + 1).alias("line_num"), "line")


def file_times(spark: SparkSession, folder: str) -> DataFrame:
    """(asset_id, rel_path, category, updated_at) of all files; no content is read."""
    return scan(spark, folder).select(F.concat(F.lit("file:"), "rel_path").alias("asset_id"), "rel_path", T.path_category(F.col("rel_path")).alias("category"), F.col("mtime").alias("updated_at"))


def expected_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected (path) with found, size and content: the input of the file rules."""
    return expected.join(found.select("path", "size", "content", F.lit(True).alias("_there")), "path", "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def chunks_from_lists(spark: SparkSession, contents: list[str | None], ids: list[str] | None = None, metadatas: list[dict | None] | None = None) -> DataFrame:
    """In-memory lists as chunks; missing ids become chunk_0, chunk_1, ..."""
    ids = ids or [f"chunk_{i}" for i in range(len(contents))]
    metadatas = metadatas or [{} for _ in contents]
    rows = [(i, c, x, None if m is None else {k: None if v is None else str(v) for k, v in m.items()}) for i, (c, x, m) in enumerate(zip(ids, contents, metadatas))]
    return spark.createDataFrame(rows, "ordinal long, chunk_id string, content string, metadata map<string,string>")


def read_chunks(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A chunk store: Parquet with ordinal, chunk_id, content, metadata and, if any, embedding."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
