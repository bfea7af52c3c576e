import random

from pyspark.sql import functions as F

from quarry.llm import op9


def test_families_found_and_others_left(spark, tmp_path):
    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choice(["the", "of", "onthe", "thing", "reed", "under", "version", "to", "ersh"]) for _ in range(n))
    rows, want = [], {}
    flat = [(f, t) for f, own in op9.NOTICES.items() for t in own]
    for i in range(120):
        lines = [prose(rnd.randrange(1, 60)) for _ in range(rnd.randrange(1, 5))]
        if i % 4 == 0:
            f, t = flat[i // 4 % len(flat)]
            t = t.upper() if i % 8 == 0 else t
            lines.insert(rnd.randrange(len(lines) + 1), t)
            want[i] = f
        rows.append((i, "\n".join(lines), 0))
    rows += [(500 + i, t, 0) for i, t in enumerate(op9.OTHERS)] + [(700, None, 0), (701, "", 0), (702, "\n\n  \n", 0), (703, "license " * 3000, 0), (0, rows[0][1], 0), (None, "Licensed under CC BY-NC 4.0.", 1)]
    want[None] = "CC-BY-NC-4.0"
    spark.createDataFrame(rows, "doc_id long, text string, mark int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.families for r in got if r.families} == want
    by = {r.doc_id: r for r in got}
    assert by[700].n_paragraphs == by[702].n_paragraphs == 0 and by[4].n_licenses == 1


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op9.query(spark, str(tmp_path)).count() == 0


def test_all_paragraphs_train_and_calibrate(spark):
    from pyspark.ml.feature import CountVectorizerModel

    rows = [(i, f"the license of word{i} was released\n\nunder version {i % 7} of it\nLicensed under CC BY 4.0.") for i in range(3000)] + [(None, "license " * 3000)]
    counter = CountVectorizerModel.from_vocabulary(op9._vocabulary(), "grams", "features").setBinary(True)
    found = op9.kinds(spark.createDataFrame(rows, "doc_id long, text string"), counter)
    assert {h.half: h.n > 2500 for h in found.groupBy("half").agg(F.sum("times").alias("n")).collect()} == {0: True, 1: True}
    assert found.agg(F.sum("times")).first()[0] == 6001 and found.count() < 50
