"""Row generators: text windows, Markdown sections, JSON lines. Built-ins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_lines(text: Column) -> Column:
    """Lines without their ends; a final empty one is none."""
    own = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(F.element_at(own, -1) == "", F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))).otherwise(own)


def finish(chunks: DataFrame) -> DataFrame:
    """Identity, hash and token count of chunks that have their content."""
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("#", "file_id", F.col("chunk_index").cast("string")), 256)).withColumn("token_count", F.floor(F.octet_length("content") / 4).cast("long")).withColumn("content_hash", F.sha2("content", 256))


def text_windows(files: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(file_id, text) -> chunks of whole lines of about ``size`` bytes that overlap by some lines.

    One pass over the lengths of a file's lines finds the cuts; no line is copied until then.
    """
    carry = max(min(overlap, size // 2) // 60, 1)
    size = max(size, 100)
    rows = files.select("file_id", text_lines(F.col("text")).alias("lines"))
    n = F.size("lines")
    zero = F.struct(F.lit(1).alias("start"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, length):
        line, held = acc["line"] + 1, acc["held"] + length + 1
        cut = (held >= size) | (line == n)
        back = F.least(F.lit(carry), line - acc["start"] + 1)
        start = F.when(cut, line - back + 1).otherwise(acc["start"])
        kept = F.aggregate(F.slice(F.col("lines"), F.greatest(line - back + 1, F.lit(1)), back), F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 1)
        out = F.when(cut, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), line.alias("end"))))).otherwise(acc["out"])
        return F.struct(start.alias("start"), line.alias("line"), F.when(cut, kept).otherwise(held).alias("held"), out.alias("out"))

    cuts = F.aggregate(F.transform("lines", lambda x: F.octet_length(x).cast("long")), zero, step, lambda acc: acc["out"])
    rows = rows.select("file_id", "lines", F.posexplode(cuts).alias("chunk_index", "cut"))
    content = F.array_join(F.slice("lines", F.col("cut.start"), F.col("cut.end") - F.col("cut.start") + 1), "\n")
    rows = rows.select("file_id", "chunk_index", F.col("cut.start").alias("line_start"), F.col("cut.end").alias("line_end"), content.alias("content"))
    before = Window.partitionBy("file_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("content")).over(before), F.lit(0)).cast("long")
    return finish(rows.withColumn("byte_start", start).withColumn("byte_end", start + F.octet_length("content")))


def _numbered(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))


def markdown_headings(files: DataFrame) -> DataFrame:
    """(file_id, pos, depth, title): lines that begin with #, whatever stands around them."""
    rows = _numbered(files).withColumn("trimmed", F.trim("line")).filter(F.col("trimmed").startswith("#"))
    return rows.select("file_id", "pos", F.length(F.regexp_extract("trimmed", "^#+", 0)).alias("depth"), F.trim(F.regexp_replace("trimmed", "^#+", "")).alias("title"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """Sections with a body: heading, depth, line range and the body's text."""
    rows = _numbered(files).withColumn("trimmed", F.trim("line"))
    order = Window.partitionBy("file_id").orderBy("pos")
    head = F.col("trimmed").startswith("#")
    rows = rows.withColumn("head", head).withColumn("section", F.sum(head.cast("int")).over(order))
    body = F.struct("pos", "line")
    own = rows.groupBy("file_id", "section").agg(
        F.coalesce(F.max(F.when(F.col("head"), F.trim(F.regexp_replace("trimmed", "^#+", "")))), F.lit("Preamble")).alias("heading"),
        F.coalesce(F.max(F.when(F.col("head"), F.length(F.regexp_extract("trimmed", "^#+", 0)))), F.lit(1)).alias("depth"),
        (F.min("pos") + 1).alias("line_start"), (F.max("pos") + 1).alias("line_end"),
        F.sort_array(F.collect_list(F.when(~F.col("head"), body))).alias("body"),
    ).filter(F.size("body") > 0)
    own = own.withColumn("content", F.array_join(F.col("body.line"), "\n")).withColumn("chunk_index", F.row_number().over(Window.partitionBy("file_id").orderBy("section")) - 1)
    return finish(own.drop("body", "section"))


def heading_edges(files: DataFrame) -> DataFrame:
    """(file_id, pos, depth, title, parent_pos): the nearest heading before of smaller depth; null: the document.

    One running value for each depth that occurs in the table (one small action finds them), so any depth is right.
    """
    rows = markdown_headings(files)
    depths = sorted(r[0] for r in rows.select("depth").distinct().collect())
    order = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    of = F.array(*[F.last(F.when(F.col("depth") < d, F.col("pos")), ignorenulls=True).over(order) for d in depths] or [F.lit(None).cast("int")])
    at = F.array_position(F.array(*[F.lit(d) for d in depths] or [F.lit(0)]), F.col("depth")).cast("int")
    return rows.withColumn("parent_pos", F.get(of, at - 1))


def json_lines(files: DataFrame) -> DataFrame:
    """One chunk for each line that isn't blank; its index is the line's number."""
    order = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = _numbered(files).withColumn("byte_start", F.coalesce(F.sum(F.octet_length("line") + 1).over(order), F.lit(0)).cast("long"))
    rows = rows.withColumn("content", F.trim("line")).filter("content <> ''")
    rows = rows.select("file_id", F.col("pos").alias("chunk_index"), "byte_start", (F.col("byte_start") + F.octet_length("content")).alias("byte_end"), (F.col("pos") + 1).alias("line_start"), (F.col("pos") + 1).alias("line_end"), "content")
    return finish(rows)
