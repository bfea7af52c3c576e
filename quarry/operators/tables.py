"""Catalog upkeep, range reads, profiles, graph neighbourhoods and the change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import core as C


def files_of(documents: DataFrame) -> DataFrame:
    """Catalog rows of a (doc_id, text, lang, source) table, with the text."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id"), F.lit(".txt"))
    rows = documents.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("file_id"), path.alias("path"), "doc_id", "text")
    rows = rows.withColumn("filename", C.filename(F.col("path"))).withColumn("extension", C.extension(F.col("path"))).withColumn("mime_type", C.mime_type(F.col("extension")))
    modified = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return rows.withColumn("size_bytes", F.octet_length("text").cast("long")).withColumn("content_hash", F.sha2("text", 256)).withColumn("modified_at", modified)


def overlapping(chunks: DataFrame, low: int, high: int, what: str = "line") -> DataFrame:
    """Chunks that touch a range of lines, pages or bytes, ends included."""
    return chunks.filter((F.col(f"{what}_start") <= high) & (F.col(f"{what}_end") >= low))


def open_range(chunks: DataFrame, low: int, high: int) -> DataFrame:
    """Per file the chunks that touch a range of lines, as one text."""
    found = overlapping(chunks, low, high).groupBy("file_id").agg(
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("own"))
    return found.select("file_id", "line_start", "line_end", F.array_join("own.content", "\n").alias("content"), F.array_join(F.transform("own.chunk_index", lambda i: i.cast("string")), ",").alias("chunks"))


def profile(files: DataFrame, chunks: DataFrame) -> DataFrame:
    own = chunks.groupBy("file_id").agg(F.count("*").alias("chunk_count"), F.max("line_end").alias("line_count"), F.sum("token_count").alias("tokens"))
    return files.select("file_id", "path", "size_bytes", "mime_type").join(own, "file_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def related(edges: DataFrame, entities: DataFrame, centre: str, kind: str | None = None) -> DataFrame:
    """(direction, relation_id, other_id, other_name, relation_type) of one entity's edges.

    A loop is an outgoing edge only.
    """
    own = edges.filter((F.col("source_id") == centre) | (F.col("target_id") == centre))
    if kind:
        own = own.filter(F.lower("relation_type") == kind.lower())
    out = F.col("source_id") == centre
    own = own.select(F.when(out, "outgoing").otherwise("incoming").alias("direction"), "relation_id", F.when(out, F.col("target_id")).otherwise(F.col("source_id")).alias("other_id"), "relation_type")
    return own.join(entities.select(F.col("entity_id").alias("other_id"), F.col("name").alias("other_name")), "other_id", "left")


def neighbourhood(edges: DataFrame, entities: DataFrame, start: str, depth: int) -> DataFrame:
    """(entity_id, depth): entities reached over outgoing edges, the nearest depth first found.

    Targets without an entity row are passed through and not reported.
    """
    reached = entities.filter(F.col("entity_id") == start).select("entity_id", F.lit(0).alias("depth"))
    edge = edges.select("source_id", "target_id").distinct()
    frontier = reached
    for d in range(1, depth + 1):
        step = frontier.join(edge, frontier["entity_id"] == edge["source_id"]).select(F.col("target_id").alias("entity_id")).distinct()
        frontier = step.join(reached, "entity_id", "left_anti").select("entity_id", F.lit(d).alias("depth"))
        reached = reached.unionByName(frontier)
    return reached.join(entities.select("entity_id"), "entity_id", "left_semi")


def to_dot(edges: DataFrame) -> DataFrame:
    """(line): the edges as GraphViz statements, in order."""
    return edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', "source_id", "target_id", "relation_type").alias("line")).orderBy("line")


def changes(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, change) of two (path, content_hash) tables: new, modified, unchanged or deleted."""
    a, b = known.select("path", F.col("content_hash").alias("was")), scanned.select("path", F.col("content_hash").alias("now"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("modified")
    return both.select("path", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key; columns ``keep`` stay as they were."""
    was = old.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
    fresh = new.join(was, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(fresh)


def without_files(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose file isn't deleted."""
    return table.join(gone.select("file_id"), "file_id", "left_anti")


def orphaned(entities: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities stay when their file goes, with a null file_id."""
    flagged = entities.join(gone.select("file_id", F.lit(True).alias("_gone")), "file_id", "left")
    return flagged.withColumn("file_id", F.when(F.col("_gone").isNull(), F.col("file_id"))).drop("_gone")


def recent(events: DataFrame, key: str, n: int = 10) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def change_feed(rows: DataFrame, key: str, state: Column, order: tuple[str, ...]) -> DataFrame:
    """Rows whose state differs from the key's last one: created first, modified after."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("_state", state).withColumn("_was", F.lag("_state").over(w))
    return rows.filter(~F.col("_state").eqNullSafe(F.col("_was"))).withColumn("change", F.when(F.col("_was").isNull(), "created").otherwise("modified")).drop("_state", "_was")
