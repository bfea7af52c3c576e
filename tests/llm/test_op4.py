import hashlib
import random

import pytest

from quarry.llm import op4

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def root(text):
    p = [sha(x) for x in text.split("\n")]
    return sha("".join(sha("".join(p[i : i + 8])) for i in range(0, len(p), 8)))


@pytest.mark.parametrize("size", [12 << 20, 300])
def test_query(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(op4, "BUCKET_BYTES", size)
    monkeypatch.setattr(op4.with_next, "__defaults__", (size,))
    rnd = random.Random(1)
    text = lambda n: " ".join(rnd.choice(["ab", "é", "xyz\n", "q.", "𝄞"]) + str(rnd.randrange(99)) for _ in range(n))
    rows = [(i * 3, text(rnd.randrange(60)), "x") for i in range(50)] + [(7000, None, ""), (8000, "", ""), (9, "same", ""), (9, "same", ""), (9, "other", ""), (10**12, "z" * 5000, ""), (6, "a", None)]
    spark.createDataFrame(rows, "doc_id long, text string, root string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op4.query(spark, str(tmp_path)).collect()
    want, order = [], sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        want.append((i, len(t), sha(t[: len(t) - h] + nxt[:h]), root(t)))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint[:64]) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
        by_text.setdefault(r.fingerprint[:64], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in got if r.n_chars > 80 and r.doc_id < 10**12]
    assert sum(r.near_edited for r in long) / len(long) > 0.4 > 0.2 > sum(r.near_next for r in long) / len(long)


def test_edits(spark):
    a = "\n".join(f"line {i}" for i in range(30))
    b = a.replace("line 12", "line twelve")
    d = spark.createDataFrame([(a, b), (a, a), (None, ""), ("", "x\ny")], "a string, b string")
    got = [[tuple(x) for x in r[0]] for r in d.select(op4.edits(d.a, d.b)).collect()]
    assert got == [[(1, 4)], [], [], [(0, 0), (0, 1)]]


def test_empty_and_single(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert op4.query(spark, f"{tmp_path}/e").count() == 0
    spark.createDataFrame([(1, "ab cd")], "doc_id long, text string").write.parquet(f"{tmp_path}/s/documents.parquet")
    assert op4.query(spark, f"{tmp_path}/s").first().edited_sha256 == sha("ab ab")
