from datetime import datetime

from pyspark.sql import functions as F

from quarry.functions import values as V
from quarry.operators import catalog as O
from quarry.operators import chunkers as K
from quarry.operators import embed as E
from quarry.operators import search as S
from quarry.operators.postings import Postings


def test_headings_of_any_depth(spark):
    text = "\n".join(f"{'#' * d} d{d}\nx" for d in (15, 16, 17, 18, 2, 40))
    files = spark.createDataFrame([("f", text), ("g", "no heading"), ("h", None)], "file_id string, text string")
    got = [(r.pos, r.parent_pos) for r in K.heading_edges(files).orderBy("pos").collect()]
    assert got == [(0, None), (2, 0), (4, 2), (6, 4), (8, None), (10, 8)]
    assert K.heading_edges(files.filter("file_id = 'g'")).count() == 0


def test_postings_are_upserted_by_file(spark, tmp_path):
    rows = [("a", "alpha beta beta"), ("b", "beta gamma"), ("c", None), ("d", "gamma delta")]
    frame = lambda r: spark.createDataFrame(r, "file_id string, text string")
    index = Postings(spark, str(tmp_path / "index")).build(frame(rows))
    assert index.search("beta gamma").collect() == S.lexical_search(frame(rows), "beta gamma").collect()
    after = [("b", "delta delta"), ("e", "beta"), rows[0], rows[2]]
    index.update(frame(after[:2]), spark.createDataFrame([("d",)], "file_id string"))
    again = Postings(spark, str(tmp_path / "index"))
    assert again.search("beta delta").collect() == S.lexical_search(frame(after), "beta delta").collect()
    assert again.lookup([]).count() == 0 and again.search("").count() == 0
    assert "PushedFilters: [In(term" in again.lookup(["beta", "delta"])._jdf.queryExecution().toString()


def test_embedder_is_called_in_batches_and_halved(spark):
    def embedder(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i == 7 else "x" * i) for i in range(40)], "i int, content string").repartition(1)
    got = {r.i: r.vector for r in E.embedded(rows, embedder, "lengths", instruction="q: ").collect()}
    assert got[7] is None and all(got[i] == [i + 3.0, 1.0] for i in range(40) if i != 7)


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([("a b a",), ("a b a",), (None,), ("!",)], "content string")
    a, b, none, empty = (r.vector for r in E.hashed(rows, 16).collect())
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-5 and set(none) == set(empty) == {0.0}


def test_values(spark):
    r = spark.range(1).select(
        V.json_or_empty(F.lit("{x")).alias("a"), V.json_or_empty(F.lit(None).cast("string")).alias("b"), V.json_or_empty(F.lit("[1]")).alias("c"),
        V.from_rfc3339(F.lit("2024-05-01T10:00:00+02:00")).alias("t"), V.from_rfc3339(F.lit("no"), F.lit("2000-01-01").cast("timestamp")).alias("u"),
        V.range_length(F.lit(5), F.lit(3)).alias("n"), V.range_length(F.lit(3), F.lit(3), True).alias("m"), V.is_id(F.lit("x")).alias("i"),
        V.is_text(F.lit("TEXT/x")).alias("text"), V.is_json(F.lit("application/json")).alias("json"), V.is_pdf(F.lit("text/plain")).alias("pdf"),
        V.chunk_locator(F.lit(0), F.lit(9), F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("l"),
    ).first()
    assert (r.a, r.b, r.c, r.n, r.m, r.i) == ("{}", "{}", "[1]", 0, 1, False) and r.text and r.json and not r.pdf
    assert r.t.isoformat() == datetime(2024, 5, 1, 8).isoformat() and r.u == datetime(2000, 1, 1)
    assert tuple(r.l.bytes) == (0, 9) and tuple(r.l.lines) == (1, 1) and r.l.pages is None


def test_centre_events_and_filters(spark, tmp_path):
    entities = spark.createDataFrame([("e1", "f1", 2, 0), ("e2", "f1", 1, 0), ("e3", "f2", 1, 0)], "entity_id string, file_id string, created_at int, ordinal int")
    files = spark.createDataFrame([("f1", "/a"), ("f2", "/b")], "file_id string, path string")
    found = [[r[0] for r in O.centre(entities, files, **k).collect()] for k in ({"entity_id": "e3"}, {"file_id": "f1"}, {"path": "/b"}, {"path": "/c"})]
    assert found == [["e3"], ["e2"], ["e3"], []]
    for _ in range(2):
        O.record_event(str(tmp_path / "events"), files)
    assert spark.read.parquet(str(tmp_path / "events")).count() == 4
    assert O.merge_filters({"a": 1, "b": [], "modified_after": "x"}, {"a": 2, "c": None, "modified_before": "2024-01-01"}) == {"a": 2, "modified_before": datetime(2024, 1, 1)}
