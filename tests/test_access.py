"""Opening, evidence and snippets on a few rows."""

from pyspark.sql import functions as F

from quarry.operators import access

CHUNKS = "chunk_id string, file_id string, chunk_index int, page_start int, page_end int, line_start int, line_end int, byte_start long, byte_end long, content string"
ROWS = [("a0", "a", 0, None, None, 1, 10, 0, 99, "one"), ("a1", "a", 1, None, None, 11, 20, 99, 180, "two"), ("b0", "b", 0, 3, 3, 1, 5, 0, 40, "page three"), ("b1", "b", 1, 4, 4, 6, 9, 40, 80, "page four")]


def test_open_at(spark):
    chunks = spark.createDataFrame(ROWS, CHUNKS)
    got = lambda **k: {r.file_id: (r.how, r.uri, r.content) for r in access.open_at(chunks, **k).collect()}
    assert got() == {"a": ("chunk", "quarry://file/a/chunk/a0", "one"), "b": ("chunk", "quarry://file/b/chunk/b0", "page three")}
    assert got(pages=(4, None), lines=(15, None)) == {"a": ("lines", "quarry://file/a/lines/11-20", "two"), "b": ("pages", "quarry://file/b/pages/4-4", "page four")}
    assert got(chunk_index=1, pages=(3, 3))["b"][2] == "page four"
    assert got(chunk_index=9, bytes_=(90, None))["a"][:2] == ("bytes", "quarry://file/a/bytes/0-180")
    assert access.open_at(chunks.limit(0)).count() == 0


def test_evidence(spark):
    chunks = spark.createDataFrame(ROWS, CHUNKS)
    files = spark.createDataFrame([("a", "a.txt", "d/a.txt")], "file_id string, filename string, path string")
    hits = spark.createDataFrame([("a", "a1", "x", "x", "s"), ("z", None, "z.md", "z.md", "some")], "file_id string, chunk_id string, filename string, path string, snippet string")
    got = {r.file_id: r for r in access.evidence(hits, files, chunks).collect()}
    assert (got["a"].path, got["a"].content, got["a"].line_start) == ("d/a.txt", "two", 11)
    assert (got["z"].path, got["z"].content, got["z"].byte_end, got["z"].line_start) == ("z.md", "some", 4, None)


def test_snippet_and_context(spark):
    text = " ".join(f"w{i}" for i in range(30)) + " Needle, end"
    rows = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "(Needles)")], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", access.snippet(F.col("t"), ["needle"], 8).alias("s")).collect()}
    assert got == {1: "…w28 w29 <mark>Needle,</mark> end", 2: None, 3: None, 4: "<mark>(Needles)</mark>"}
    files = spark.createDataFrame([("a", "d/a.txt")], "file_id string, path string")
    assert [r.chunk_id for r in access.file_context(files, spark.createDataFrame(ROWS, CHUNKS), "d\\a.txt").collect()] == ["a0", "a1"]
