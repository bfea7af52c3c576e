"""Scan, extraction and incremental index of a small folder; the change stream; hashed vectors."""

import io
import zipfile
import zlib

from pyspark.sql import functions as F

from quarry.operators import embed
from quarry.sources import files as S
from quarry.sources import office
from quarry.streaming import feed


def pack(**members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def sheet(rows: int) -> bytes:
    body = "".join(f'<row><c r="A{i}" t="inlineStr"><is><t>{"name" if i == 1 else f"n{i}"}</t></is></c><c r="C{i}"><v>{i}.125</v></c></row>' for i in range(1, rows + 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


DOCX = '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
PDF = b"%PDF\nstream\n" + zlib.compress(rb"BT (first \(one\)) Tj 0 -1 Td (second) Tj <414243> Tj ET") + b"\nendstream\n"


def test_readers():
    groups = list(office.spreadsheet(sheet(60)))
    assert [(g["line_start"], g["line_end"]) for g in groups] == [(2, 51), (52, 60)]
    assert groups[0]["content"].splitlines()[:3] == ["| name | Col2 | 1.12 |", "| --- | --- | --- |", "| n2 |  | 2.12 |"]
    assert len(list(office.spreadsheet(sheet(1)))) == 1
    assert list(office.word_document(pack(word__document_xml=DOCX))) == [{"kind": "Section", "content": "one\n\n| x |\n| --- |", "heading": "Head", "depth": 2, "line_start": 1, "line_end": 4}]
    assert [p["content"] for p in office.pdf(PDF)] == ["first (one)\nsecondABC"]
    assert len(list(office.pdf(b""))) == 1
    assert [x["content"] for x in office.json_document(b'{"b": 1, "a": [2]}')] == ['"a": [\n  2\n]', '"b": 1']
    assert [x["content"] for x in office.json_document(b"[1, 2]")] == ["1", "2"]
    assert [x["kind"] for x in office.json_document(b"{")] == ["TextParagraph"]
    assert not list(office.spreadsheet(b"broken")) and not list(office.word_document(b""))


def test_index(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "left.txt").write_text("out")
    (tmp_path / ".hidden").write_text("out")
    for name, data in {"a.txt": b"plain\ntext\n", "b.md": b"# T\nbody\n", "c.xlsx": sheet(3), "d.docx": pack(word__document_xml=DOCX), "e.pdf": PDF, "f.json": b'{"k": 1}', "g.jsonl": b'{"a":1}\n\n{"a":2}\n', "h.txt": b"\xff\xfe"}.items():
        (tmp_path / name).write_bytes(data)
    files, chunks, moved = S.index(S.scan(spark, str(tmp_path)))
    assert sorted(r.filename for r in files.collect()) == ["a.txt", "b.md", "c.xlsx", "d.docx", "e.pdf", "f.json", "g.jsonl", "h.txt"]
    got = {r.filename: r.n for r in chunks.join(files, "file_id").groupBy("filename").agg(F.count("*").alias("n")).collect()}
    assert got == {"a.txt": 1, "b.md": 1, "c.xlsx": 1, "d.docx": 1, "e.pdf": 1, "f.json": 1, "g.jsonl": 2}
    assert {r.filename: r.status.reason for r in files.filter("status.kind = 'Failed'").collect()} == {"h.txt": "not UTF-8"}
    assert S.scan(spark, str(tmp_path / "missing")).count() == 0
    assert S.share(files, 30).count() == 3
    was = spark.createDataFrame(files.select("file_id", "path", "content_hash").collect())
    held = spark.createDataFrame(chunks.collect(), chunks.schema)
    (tmp_path / "a.txt").write_bytes(b"other\n")
    (tmp_path / "b.md").unlink()
    _, after, moved = S.index(S.scan(spark, str(tmp_path)), was, held)
    assert {r["change"]: r["count"] for r in moved.groupBy("change").count().collect()} == {"modified": 1, "deleted": 1, "unchanged": 6}
    said = [r.content for r in after.collect()]
    assert len(said) == 7 and "other" in said and "plain\ntext" not in said
    own = S.Registry()
    own.register(F.col("extension") == "txt", S._pieces(lambda data: iter([{"kind": "Own", "content": "mine"}])))
    assert [r.content for r in own.chunks(S.catalog(S.scan(spark, str(tmp_path)))).filter("kind = 'Own'").collect()] == ["mine", "mine"]


def test_change_stream(spark, tmp_path):
    source, schema = tmp_path / "in", "path string, op string, content_hash string, ts timestamp"
    rows = [("p", "upsert", "1", 1), ("p", "upsert", "1", 2), ("p", "upsert", "2", 3), ("p", "remove", None, 4), ("p", "upsert", "2", 5), ("q", "remove", None, 1)]
    spark.createDataFrame([(a, b, c, t) for a, b, c, t in rows], "path string, op string, content_hash string, t long").select("path", "op", "content_hash", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(str(source))
    stream = feed.change_stream(spark.readStream.schema(schema).parquet(str(source)))
    q = stream.writeStream.format("memory").queryName("told").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert [(r.path, r.change) for r in spark.table("told").orderBy("ts").collect()] == [("p", "created"), ("p", "modified"), ("p", "deleted"), ("p", "created")]
    seen = []
    q = feed.follow(feed.change_stream(spark.readStream.schema(schema).parquet(str(source))), str(tmp_path / "c2"), lambda up, gone: seen.append((up.count(), gone.count())), once=True)
    q.awaitTermination(60)
    assert seen[0] == (1, 0)


def test_hashed(spark):
    got = {r.i: r.vector for r in embed.hashed(spark.createDataFrame([(1, "one two two"), (2, ""), (3, None)], "i int, content string"), 16).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and not any(got[2]) and not any(got[3])


def test_snapshot_changes_and_events(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("b")
    files = S.catalog(S.scan(spark, str(tmp_path)))
    known = spark.createDataFrame([(r.path, r.content_hash) for r in files.select("path", "content_hash").collect()], "path string, content_hash string")
    (tmp_path / "a.txt").unlink()
    (tmp_path / "i.txt").write_text("new")
    now = S.snapshot_changes(spark, str(tmp_path), known)
    assert sorted((r.path[-5:], r.change) for r in now.collect()) == [("a.txt", "deleted"), ("i.txt", "new")]
    events = S.file_events(now, F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted(r.event_type for r in events) == ["created", "deleted"] and len({r.event_id for r in events}) == 2
