import random
import re

import pytest

from quarry.llm import op3


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def brute(docs, bench):
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for item, it in bench:
            v = words(it)
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        items.add(str(item))
        out.append((i, len(w), len(hit), ",".join(sorted(items))))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [400_000, 7])
def test_brute_force(spark, most):
    rnd = random.Random(3)
    vocab = ["a", "bb", "c1", "é", "Dd", "e"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", ",", ".\n"]) for _ in range(n))
    bench = [(i, text(rnd.choice([3, 8, 13, 20, 40]))) for i in range(12)] + [(50, ""), (51, None), (52, "a"), (53, "a bb c1 a bb c1 a bb c1 a bb c1 a bb c1 a bb")]
    docs = [(i, text(rnd.choice([0, 2, 30, 200]))) for i in range(20)]
    docs += [(100 + i, text(20) + " " + " ".join((b or "").split()[2:30]) + " " + text(30)) for i, b in bench]
    docs += [(200, None), (201, ""), (202, "A"), (203, "a BB c1 " * 30), (203, "a BB c1 " * 30), (204, text(5000))]
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in op3.contamination(d, b, most=most).collect()), key=str)
    assert got == brute(docs, bench)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in op3.contamination(d, b).collect()] == [0]
    assert op3.contamination(d.limit(0), b).count() == 0
    assert op3.clean(d, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert op3.clean(d, b).columns == d.columns


def test_clean_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a b", 1, 2, 3), (2, "c d", 1, 2, 3), (None, None, 1, 2, 3)], "doc_id long, text string, _id int, _mark int, mark int")
    out = op3.clean(d, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert out.columns == d.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "None"]
