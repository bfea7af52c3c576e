import itertools
import random

import numpy as np
import pytest

from quarry.llm import op7


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    length, n = 5, 4
    e, trans, init = rng.normal(size=(length, n)), rng.normal(size=(2, 2)), rng.normal(size=2)
    real = np.arange(length)[:, None] < np.array([5, 3, 1, 4])
    m, start, pair = op7.forward_backward(e, real, trans, init)
    want_m, want_start, want_pair = np.zeros((length, n)), np.zeros(2), np.zeros((2, 2))
    for s in range(n):
        k = int(real[:, s].sum())
        paths = list(itertools.product((0, 1), repeat=k))
        p = np.array([np.exp(init[y[0]] + sum(e[i, s] * y[i] for i in range(k)) + sum(trans[y[i - 1], y[i]] for i in range(1, k))) for y in paths])
        p /= p.sum()
        for y, q in zip(paths, p, strict=True):
            want_start[y[0]] += q
            for i in range(k):
                want_m[i, s] += q * y[i]
                if i:
                    want_pair[y[i - 1], y[i]] += q
    assert np.allclose(m, want_m) and np.allclose(start, want_start) and np.allclose(pair, want_pair)


def test_marginals_of_a_whole_chain(monkeypatch):
    """Texts of several runs: the same marginals as with runs longer than any text."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefgh"), n)) for n in (0, 1, 3, 4, 5, 37, 9, 0, 64, 100)]
    w = op7.T.Words(op7.pa.array(texts), op7.T.ALNUM, True)
    size = len(op7.HEADS) + 2 << op7.BITS
    model = {"weights": rng.normal(size=size).astype(np.float32), "trans": 2 * rng.normal(size=(2, 2)), "init": rng.normal(size=2)}
    whole = op7.grid(w.first, 128)
    short = op7.grid(w.first, 4)
    monkeypatch.setattr(op7, "grid", lambda first: whole)
    want = op7.marginals(w, model)
    monkeypatch.setattr(op7, "grid", lambda first: short)
    assert np.allclose(op7.marginals(w, model), want)


def corpus(n=900):
    rnd = random.Random(7)
    vocab = [a + b + c for a in ("th", "on", "er", "an", "re") for b in ("the", "ing", "ea", "st") for c in ("", "ly", "ed", "es")]
    rude = ["zugf" + c for c in ("ly", "ed", "es", "er", "um", "ä")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 90))]
        for _ in range(rnd.randrange(1, 5) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(rude))
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out(spark, tmp_path):
    rows, labels = corpus()
    extra = [(5000, None), (5001, ""), (None, "zugfly zugfed"), (5002, "é Thethe"), (0, rows[0][1]), (5003, "onea " * 20_000 + "zugfum")]
    spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (9999, 1), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op7.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    of, by = dict(labels), {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id in of]
    assert len(held) > 200 and sum(r.predicted == of[r.doc_id] for r in held) > 0.97 * len(held)
    assert by[5000].score == by[5001].score < 0.5 and by[None].predicted == 1
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = op7.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for r in op7.score(docs, model).filter("doc_id in (5002, 5003)").join(docs, "doc_id").collect():
        assert [r.text[a:b] for a, b in r.spans] == (["zugfum"] if r.doc_id == 5003 else [])
    kept = op7.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in op7.score(d, op7.fit(d, none)).collect()] == [0.5, 0.5]
    one = op7.fit(d, spark.createDataFrame([(2, 0), (1, 0)], "doc_id long, toxic int"))
    assert op7.score(d, one).count() == 2 and op7.score(d.limit(0), one).count() == 0


def test_grid():
    at, real = op7.grid(np.array([0, 0, 3, 10]), 4)
    assert [list(at[real[:, i], i]) for i in range(at.shape[1])] == [[0, 1, 2], [3, 4, 5, 6], [7, 8, 9]]
    assert pytest.approx(op7.grid(np.array([0, 0]))[0].size) == 0
