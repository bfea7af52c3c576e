"""Operators over the whole catalog: counts, reports, outlines, entities of headings, graph upkeep, events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import values as V
from quarry.operators import chunkers as K


def counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(files, chunks): one row."""
    return files.agg(F.count("*").alias("files")).crossJoin(chunks.agg(F.count("*").alias("chunks")))


def scan_report(changes: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """(scanned, changed, unchanged, denied) of a scan's (path, change); deleted paths were not scanned."""
    n = lambda *kinds: F.count(F.when(F.col("change").isin(*kinds), 1))
    own = changes.agg(n("new", "modified", "unchanged").alias("scanned"), n("new", "modified").alias("changed"), n("unchanged").alias("unchanged"))
    return own.crossJoin(denied.agg(F.count("*").alias("denied"))) if denied is not None else own.withColumn("denied", F.lit(0).cast("long"))


def has_vectors(files: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """The files with a vector of the model."""
    return files.join(vectors.filter(F.col("model_name") == model).select("file_id"), "file_id", "left_semi")


def latest_nodes(nodes: DataFrame, key: str, order: str) -> DataFrame:
    """Of nodes written several times the last; partial aggregates, so a node written often is no hot task."""
    own = nodes.groupBy(key).agg(F.max_by(F.struct(*nodes.columns), order).alias("last"))
    return own.select("last.*")


def merged_edges(stored: DataFrame, fresh: DataFrame, key: str = "relation_id") -> DataFrame:
    """Stored edges and those of the fresh ones that aren't among them."""
    return stored.unionByName(fresh.join(stored.select(key), key, "left_anti").select(*stored.columns))


def connections(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, outgoing, incoming, total) of every entity; a loop is outgoing only."""
    out = edges.select(F.col("source_id").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    in_ = edges.filter("source_id <> target_id").select(F.col("target_id").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    sums = out.unionByName(in_).groupBy("entity_id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    own = entities.select("entity_id").join(sums, "entity_id", "left")
    return own.select("entity_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("outgoing", "incoming")]).withColumn("total", F.col("outgoing") + F.col("incoming"))


def centre(entities: DataFrame, files: DataFrame, entity_id: str | None = None, file_id: str | None = None, path: str | None = None) -> DataFrame:
    """(entity_id): the entity named, else the first of the file, else the first of the file at the path."""
    if entity_id:
        return entities.filter(F.col("entity_id") == entity_id).select("entity_id")
    own = entities.filter(F.col("file_id") == file_id) if file_id else entities.join(files.filter(F.col("path") == path).select("file_id"), "file_id", "left_semi")
    return own.orderBy("created_at", "ordinal", "entity_id").limit(1).select("entity_id")


def dot_graph(entities: DataFrame, edges: DataFrame, name: str = "G") -> DataFrame:
    """(place, line): a whole GraphViz file: head, nodes, edges, end."""
    quoted = lambda c: F.replace(F.col(c), F.lit('"'), F.lit('\\"'))
    nodes = entities.select(F.lit(1).alias("place"), F.format_string('  "%s" [label="%s"];', quoted("entity_id"), quoted("name")).alias("line"))
    links = edges.select(F.lit(2).alias("place"), F.format_string('  "%s" -> "%s" [label="%s"];', quoted("source_id"), quoted("target_id"), quoted("relation_type")).alias("line"))
    spark = entities.sparkSession
    ends = spark.range(1).select(F.lit(0).alias("place"), F.lit(f"digraph {name} {{").alias("line")).unionByName(spark.range(1).select(F.lit(3).alias("place"), F.lit("}").alias("line")))
    return nodes.unionByName(links).unionByName(ends).orderBy("place", "line")


def document_entities(files: DataFrame) -> DataFrame:
    """(entity_id, name, entity_type, file_id): one for each Markdown, JSON, spreadsheet, word-processor or PDF file."""
    mime = F.col("mime_type")
    kinds = V.is_markdown(mime) | V.is_json(mime) | V.is_spreadsheet(mime) | V.is_word_document(mime) | V.is_pdf(mime)
    return files.filter(kinds).select(F.sha2(F.concat(F.lit("Document#"), "file_id"), 256).alias("entity_id"), F.col("filename").alias("name"), F.lit("Document").alias("entity_type"), "file_id")


def heading_entities(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_id, name, entity_type, file_id, depth, ordinal) of Markdown headings, and Contains edges
    (source_id, target_id) to each from the nearest heading above of smaller depth, or from the document."""
    key = lambda pos: F.sha2(F.concat_ws("#", F.lit("Heading"), "file_id", F.col(pos).cast("string")), 256)
    rows = K.heading_edges(files)
    entities = rows.select(key("pos").alias("entity_id"), F.col("title").alias("name"), F.lit("Heading").alias("entity_type"), "file_id", "depth", F.col("pos").alias("ordinal"))
    parent = F.when(F.col("parent_pos").isNull(), F.sha2(F.concat(F.lit("Document#"), "file_id"), 256)).otherwise(key("parent_pos"))
    return entities, rows.select(parent.alias("source_id"), key("pos").alias("target_id"), F.lit("Contains").alias("relation_type"))


def outline(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(file_id, outline array<string>): of a spreadsheet its sheets and headings, of a document its headings, of code ``Type: name``.

    In the entities' order; files of other kinds have null. ``entities``: (file_id, name, entity_type, sheet, ordinal).
    """
    mime = F.col("mime_type")
    sheet, code = V.is_spreadsheet(mime), mime.rlike(r"^(application|text)/(x-.*|javascript|typescript|jsx)$")
    document = V.is_markdown(mime) | V.is_word_document(mime) | V.is_pdf(mime)
    kind = F.when(sheet, "sheet").when(document, "document").when(code, "code")
    heading = F.col("entity_type") == "Heading"
    item = F.when((F.col("kind") == "sheet") & (heading | F.col("sheet").isNotNull()), F.col("name")).when((F.col("kind") == "document") & heading, F.col("name")).when(F.col("kind") == "code", F.concat("entity_type", F.lit(": "), "name"))
    rows = files.select("file_id", kind.alias("kind"))
    own = rows.filter("kind is not null").join(entities, "file_id").withColumn("item", item).filter("item is not null")
    lists = own.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "item"))).alias("items"))
    return rows.join(lists, "file_id", "left").select("file_id", F.when(F.col("kind").isNotNull(), F.coalesce("items.item", F.array().cast("array<string>"))).alias("outline"))


def numbered(hits: DataFrame, score: str = "score", *ids: str) -> DataFrame:
    """Result rows with ``ordinal``, from 0, best first. For lists of results, which are short."""
    return hits.withColumn("ordinal", F.row_number().over(Window.orderBy(F.col(score).desc(), *(ids or ("file_id",)))) - 1)


def record_event(table: str, events: DataFrame) -> None:
    """Append events to a table's files; nothing that is there is read."""
    events.write.mode("append").parquet(table)


def merge_filters(flat: dict, nested: dict | None) -> dict:
    """Filter arguments: a nested value wins over a flat one, empty lists and texts that are no time are left out."""
    times, out = ("modified_after", "modified_before"), {}
    for name, value in {**flat, **{k: v for k, v in (nested or {}).items() if v is not None}}.items():
        if name in times:
            try:
                value = datetime.fromisoformat(value)
            except (TypeError, ValueError):
                continue
        if value is not None and value != []:
            out[name] = value
    return out


def between(column: Column, low, high) -> Column:
    """A test with open ends: null bounds don't bind."""
    test = F.lit(True)
    if low is not None:
        test = test & (column >= F.lit(low))
    return test & (column <= F.lit(high)) if high is not None else test
