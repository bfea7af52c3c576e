"""Files of a folder: scan, catalog rows, extraction by MIME type, and the tables of an index."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import core as C
from quarry.operators import chunkers as K
from quarry.operators import tables as T
from quarry.sources import office

SCANNED = "path string, modificationTime timestamp, length long, content binary"
PIECE = "file_id string, chunk_index int, kind string, heading string, depth int, sheet string, page_start int, page_end int, line_start int, line_end int, byte_start long, byte_end long, content string"
FIELDS = [f.split() for f in PIECE.split(", ")]


def scan(spark: SparkSession, root: str, custom: tuple[str, ...] = (), ignore_hidden: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the regular files below ``root`` that aren't excluded.

    A missing root gives no rows. Parts of the root itself exclude nothing. The content is read only
    where it is used.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], SCANNED)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    below = F.substr(F.col("path"), F.lit(len(fs.makeQualified(path).toString().rstrip("/")) + 2))
    return found.select("path", "modificationTime", "length", "content").filter(~C.excluded(below, custom, ignore_hidden))


def share(rows: DataFrame, percent: float) -> DataFrame:
    """The first ceil(n * percent / 100) rows by path; percent is 100 at most."""
    return rows.orderBy("path").limit(math.ceil(rows.count() * min(percent, 100) / 100))


def catalog(scanned: DataFrame) -> DataFrame:
    """Catalog rows of scanned files, with their bytes and, where they are UTF-8, their text."""
    path = C.clean_path(F.col("path"))
    rows = scanned.select(F.sha2(path, 256).alias("file_id"), path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    rows = rows.withColumn("filename", C.filename(F.col("path"))).withColumn("extension", C.extension(F.col("path"))).withColumn("mime_type", C.mime_type(F.col("extension")))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = rows.withColumn("content_hash", F.sha2("content", 256)).withColumn("text", text)
    # spreadsheets, word-processor files and PDF are read as bytes; all else must be text
    failed = F.col("content").isNotNull() & F.col("text").isNull() & ~F.coalesce(F.col("extension").isin("xlsx", "docx", "pdf"), F.lit(False))
    status = F.struct(F.when(failed, "Failed").otherwise("Indexed").alias("kind"), F.when(failed, "not UTF-8").alias("reason"))
    return rows.withColumn("status", status)


def file_events(changes: DataFrame, at: Column) -> DataFrame:
    """(event_id, file_id, event_type, ts, source): what a scan's changes (path, change) tell, for ``catalog.record_event``."""
    kind = F.when(F.col("change") == "new", "created").otherwise(F.col("change"))
    rows = changes.filter("change <> 'unchanged'").select(F.sha2("path", 256).alias("file_id"), kind.alias("event_type"), at.alias("ts"))
    return rows.select(F.sha2(F.concat_ws("#", "file_id", "event_type", F.unix_micros("ts").cast("string")), 256).alias("event_id"), "*", F.lit("scan").alias("source"))


def snapshot_changes(spark: SparkSession, root: str, known: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    """A watch step: the changes (path, change), deletes too, between a folder now and the catalog (path, content_hash) known.

    The file source of a stream never tells of deleted files; this is to be called by a trigger.
    """
    return T.changes(known.select("path", "content_hash"), catalog(scan(spark, root, custom)).select("path", "content_hash")).filter("change <> 'unchanged'")


def _pieces(reader: Callable[[bytes], Iterator[dict]]) -> Callable[[DataFrame], DataFrame]:
    """An extractor (files -> chunks) from a function of one file's bytes."""

    def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        for batch in some:
            for file_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [{"file_id": file_id, "chunk_index": i, **x} for i, x in enumerate(reader(data.as_py() or b""))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind[t]) for n, t in FIELDS], names=[n for n, _ in FIELDS])

    return lambda files: files.select("file_id", "content").mapInArrow(batches, PIECE)


def _of_text(chunker: Callable[[DataFrame], DataFrame], kind: str) -> Callable[[DataFrame], DataFrame]:
    def extract(files: DataFrame) -> DataFrame:
        found = chunker(files.filter("text is not null"))
        return found.select(*[(F.col(n) if n in found.columns else F.lit(kind if n == "kind" else None)).cast("bigint" if t == "long" else t).alias(n) for n, t in FIELDS])

    return extract


def _markdown(files: DataFrame) -> DataFrame:
    return K.markdown_sections(files)


class Registry:
    """Extractors in order of precedence: the first whose test holds gets a file; others get text windows."""

    def __init__(self) -> None:
        mime, ext = F.col("mime_type"), F.col("extension")
        self.known: list[tuple[Column, Callable[[DataFrame], DataFrame]]] = [
            (ext.isin("xlsx"), _pieces(office.spreadsheet)),
            (ext.isin("docx"), _pieces(office.word_document)),
            ((mime == "application/pdf") | (ext == "pdf"), _pieces(office.pdf)),
            (ext.isin("md", "markdown"), _of_text(_markdown, "Section")),
            (ext.isin("jsonl", "ndjson"), _of_text(K.json_lines, "JsonObject")),
            (ext.isin("json"), _pieces(office.json_document)),
        ]

    def register(self, test: Column, extract: Callable[[DataFrame], DataFrame]) -> None:
        """``extract``: files (file_id, path, content, text, ...) -> the columns of PIECE. Comes before the others."""
        self.known.insert(0, (test, extract))

    def chunks(self, files: DataFrame) -> DataFrame:
        """Chunks of all files; each branch reads only the files that are its own."""
        branches, taken = [], F.lit(False)
        for test, extract in self.known:
            test = F.coalesce(test, F.lit(False))
            branches.append(extract(files.filter(test & ~taken)))
            taken = taken | test
        branches.append(_of_text(K.text_windows, "TextParagraph")(files.filter(~taken)))
        return K.finish(reduce(DataFrame.unionByName, branches))


def index(scanned: DataFrame, known: DataFrame | None = None, chunks: DataFrame | None = None, registry: Registry | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, changes) after a scan.

    ``known`` (file_id, path, content_hash) and ``chunks`` are of the index before; only new and modified
    files are extracted, and chunks of modified and deleted files go.
    """
    files = catalog(scanned)
    if known is None:
        known = files.select("file_id", "path", "content_hash").limit(0)
    moved = T.changes(known, files.select("path", "content_hash"))
    todo = files.join(moved.filter("change in ('new', 'modified')").select("path"), "path", "left_semi")
    made = (registry or Registry()).chunks(todo)
    if chunks is not None:
        gone = moved.filter("change in ('modified', 'deleted')").select(F.sha2("path", 256).alias("file_id"))
        made = T.without_files(chunks, gone).select(*made.columns).unionByName(made)
    return files.drop("content", "text"), made, moved


def by_file(table: DataFrame, file_id: str) -> DataFrame:
    return table.filter(F.col("file_id") == file_id)


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows written for a key, the last."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")
