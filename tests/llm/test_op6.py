import random
import re

import pytest

from quarry.llm import op6


def brute(docs, n):
    starts = {}
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in toks:
        if i is not None:
            for p in range(len(w) - n + 1):
                k = tuple(w[p : p + n])
                starts[k] = min(starts.get(k, i), i)
    out = []
    for i, w in toks:
        gone = set()
        for p in range(len(w) - n + 1):
            if i is not None and starts[tuple(w[p : p + n])] < i:
                gone.update(range(p, p + n))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "shingle", "batches", "fan_in"), [(50, 25, 2, 4), (8, 3, 5, 2), (4, 4, 1, 4)])
def test_brute_force(spark, window, shingle, batches, fan_in):
    rnd = random.Random(window)
    text = lambda n: " ".join(rnd.choice("abcdefghij") + rnd.choice(["", "É", "x"]) for _ in range(n))
    passages = [text(window + rnd.randrange(30)) for _ in range(4)]
    docs = []
    for i in range(40):
        docs.append((rnd.randrange(30) if i < 10 else i * 7, "\n".join([text(rnd.randrange(60)), rnd.choice(passages), text(rnd.randrange(20)), rnd.choice(passages)][: rnd.randrange(5)])))
    docs += [(500, None), (501, ""), (None, passages[0]), (502, passages[0]), (502, passages[0] + " b"), (1, "a " * 300), (2, "a " * 200), (900, " ".join(passages) + " " + text(3000))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, marks int")
    got = sorted((tuple(r) for r in op6.cut_repeats(d, window, shingle, batches, op6.Index(spark, fan_in=fan_in, buckets=4)).collect()), key=str)
    assert got == brute(docs, window)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert op6.cut_repeats(d).count() == 0


def test_batches_in_separate_calls(spark, tmp_path):
    """The index is opened by path for every batch; with and without a table of the earlier texts; compacted twice."""
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abcdefghij") + rnd.choice(["", "É", "x"]) for _ in range(n))
    passages = [text(30) for _ in range(5)]
    docs = [(i, " ".join(rnd.sample([text(rnd.randrange(40)), *rnd.sample(passages, 2)], 3))) for i in range(50)] + [(60, passages[0]), (70, passages[0]), (80, passages[0] + " x y")]
    cuts = [0, 12, 24, 36, 50, 51, 52, 53]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    for texts in (None, frame(docs)):
        got = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            index = op6.Index(spark, f"{tmp_path}/{texts is None}", buckets=4, texts=texts)
            got += [tuple(r) for r in op6.cut_repeats(frame(docs[a:b]), 8, 3, 1, index).collect()]
        assert sorted(got, key=str) == brute(docs, 8)
        state = op6.Index(spark, f"{tmp_path}/{texts is None}").state
        assert state["compactions"] >= 2 and len(state["runs"]) <= op6.FAN_IN
        with pytest.raises(ValueError, match="above"):
            op6.cut_repeats(frame([(3, "a")]), 8, 3, 1, index)


def test_words_that_polynomial_hashes_confuse(spark):
    """Two different words of 2048 letters (Thue-Morse and its complement) before the same 60 words."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = "".join("ba"[bin(i).count("1") % 2] for i in range(2048))
    tail = " ".join(f"w{i}" for i in range(60))
    got = op6.cut_repeats(spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 60] and got[1].kept == b


def test_a_run_has_one_file_a_bucket(spark, monkeypatch):
    """Also where more partitions are dealt than there are buckets."""
    kind = type(spark.range(0))
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *cols: plain(self, 29, *cols) if isinstance(n, int) else plain(self, 29, n, *cols))
    index = op6.Index(spark, buckets=8)
    run = index._run(index._write_run(spark.range(5000).selectExpr("xxhash64(id) mark", "id doc_id")))
    assert len(run.inputFiles()) == 8 and run.count() == 5000
