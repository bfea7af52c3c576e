"""Opening files at a place, evidence of search hits, snippets and lookups by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import core as C

#: What a range without an end takes in after its start.
MORE_LINES, MORE_BYTES = 100, 4096


def uri(file_id: Column, kind: str, low: Column, high: Column | None = None, scheme: str = "quarry") -> Column:
    """Address of lines, pages or bytes low-high, or of one chunk."""
    return F.concat(F.lit(f"{scheme}://file/"), file_id, F.lit(f"/{kind}/"), low.cast("string"), *([F.lit("-"), high.cast("string")] if high is not None else []))


def open_at(chunks: DataFrame, chunk_index: int | None = None, pages: tuple | None = None, lines: tuple | None = None, bytes_: tuple | None = None, scheme: str = "quarry") -> DataFrame:
    """(file_id, how, uri, content) for each file with chunks: what the first of these that finds something gives.

    A chunk by number, chunks touching pages, lines, bytes (ends included; an end may be None), the first chunk.
    """
    own = Window.partitionBy("file_id")
    touches = lambda what, low, high: (F.col(f"{what}_start") <= high) & (F.col(f"{what}_end") >= low)
    tests = [("chunk", F.col("chunk_index") == chunk_index)] if chunk_index is not None else []
    for kind, what, at, more in (("pages", "page", pages, 0), ("lines", "line", lines, MORE_LINES), ("bytes", "byte", bytes_, MORE_BYTES)):
        if at:
            tests.append((kind, touches(what, at[0], at[0] + more if at[1] is None else at[1])))
    rows = chunks.withColumn("_first", F.min("chunk_index").over(own))
    level = F.when(F.lit(False), F.lit(0))
    for i, (_, test) in enumerate(tests):
        level = level.when(test, F.lit(i))
    rows = rows.withColumn("_level", level.when(F.col("chunk_index") == F.col("_first"), F.lit(len(tests)))).withColumn("_best", F.min("_level").over(own)).filter("_level = _best")
    ends = [e for what in ("page", "line", "byte") for e in (F.min(f"{what}_start").alias(f"_{what}_low"), F.max(f"{what}_end").alias(f"_{what}_high"))]
    found = rows.groupBy("file_id", "_level").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))).alias("_own"), *ends)
    how = F.element_at(F.array(*[F.lit(k) for k, _ in tests], F.lit("chunk")), F.col("_level") + 1)
    address = uri(F.col("file_id"), "chunk", F.get("_own.chunk_id", F.lit(0)), scheme=scheme)
    for kind, what in (("pages", "page"), ("lines", "line"), ("bytes", "byte")):
        address = F.when(how == kind, uri(F.col("file_id"), kind, F.col(f"_{what}_low"), F.col(f"_{what}_high"), scheme)).otherwise(address)
    return found.select("file_id", how.alias("how"), address.alias("uri"), F.array_join("_own.content", "\n").alias("content"))


def evidence(hits: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (file_id, chunk_id, filename, path, snippet) with what their chunk and file say of them.

    A hit without a known chunk has its snippet as content and the snippet's bytes as range; a hit
    without a known file keeps its own name and path.
    """
    c = chunks.select("chunk_id", *[F.col(n).alias(f"_{n}") for n in ("byte_start", "byte_end", "line_start", "line_end", "page_start", "page_end", "content")])
    f = files.select("file_id", F.col("filename").alias("_filename"), F.col("path").alias("_path"))
    both = hits.join(c, "chunk_id", "left").join(f, "file_id", "left")
    name = F.coalesce("_filename", "filename")
    return both.select(
        "file_id", "chunk_id", name.alias("filename"), F.coalesce("_path", "path").alias("path"), "snippet",
        F.coalesce("_byte_start", F.lit(0)).cast("long").alias("byte_start"), F.coalesce("_byte_end", F.octet_length("snippet")).cast("long").alias("byte_end"),
        *[F.col(f"_{n}").alias(n) for n in ("line_start", "line_end", "page_start", "page_end")],
        F.coalesce("_content", "snippet").alias("content"), C.locator(name, F.col("_line_start"), F.col("_line_end"), F.col("_page_start"), F.col("_page_end")).alias("locator"))


def snippet(text: Column, words: list[str], window: int = 32, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """``window`` words of the text from a little before the first that begins with one of ``words``, those marked.

    Null where no word does. An ellipsis stands for what is left out on either side.
    """
    words = [w.lower() for w in words]
    all_ = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{IsAlphabetic}\p{N}]+", "")

    def hit(w: Column) -> Column:
        found = F.lit(False)
        for x in words:
            found = found | bare(w).startswith(x)
        return found

    at = F.array_position(F.transform(all_, hit), True)
    start = F.greatest(at - window // 4, F.lit(1)).cast("int")
    part = F.array_join(F.transform(F.slice(all_, start, window), lambda w: F.when(hit(w), F.concat(F.lit(opening), w, F.lit(closing))).otherwise(w)), " ")
    before, after = F.when(start > 1, "…").otherwise(""), F.when(F.size(all_) >= start + window, "…").otherwise("")
    return F.when(at > 0, F.concat(before, part, after))


def entities_named(entities: DataFrame, part: str, limit: int = 20) -> DataFrame:
    """The first entities by name, then id, whose name has ``part`` in it, whatever the case."""
    return entities.filter(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy("name", "entity_id").limit(limit)


def file_context(files: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """A file's row beside each of its chunks, in order."""
    return files.filter(F.col("path") == path.replace("\\", "/")).join(chunks, "file_id").orderBy("chunk_index")
