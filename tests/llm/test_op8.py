import random
import re

import pytest
import xxhash

from quarry.llm import op8


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def brute_groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("heavy", [2048, 3])
def test_links_match_brute_force(spark, heavy):
    rnd = random.Random(heavy)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    fps = list({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for c in centres for _ in range(60)} | {0, 1, 2**63, 2**63 + 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = op8.links(spark.createDataFrame([(f,) for f in signed], "fp long"), heavy).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 2
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = brute_groups(fps)
    groups = {}
    for f, g in zip(signed, want, strict=True):
        groups.setdefault(g, set()).add(find(f))
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len({find(f) for f in signed})


def test_variants_are_not_broadcast(spark, tmp_path):
    """An estimate from the file of fingerprints is 64 times too small for their variants."""
    spark.range(3000).selectExpr("xxhash64(id) fp").write.parquet(f"{tmp_path}/fps")
    fps = spark.read.parquet(f"{tmp_path}/fps")
    plan = op8.links(fps)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    wild = op8.links(fps.selectExpr("shiftright(fp, 58) fp").distinct(), 3)._jdf.queryExecution().sparkPlan().toString()
    assert wild.count("SortMergeJoin") == 2


def test_documents(spark):
    base = " ".join(f"word{i % 37} x{i}" for i in range(300))
    rows = [(1, "A b C"), (2, None), (3, ""), (4, base), (5, base.upper()), (6, base + " end"), (7, "one"), (8, "one"), (8, "one"), (9, "ä b c d É")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = op8.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_fp(t) for _, t in rows]
    groups = brute_groups(fps)
    want = sorted((i, f - (1 << 64) if f >> 63 else f, min(rows[k][0] for k in range(len(rows)) if groups[k] == groups[n])) for n, ((i, _), f) in enumerate(zip(rows, fps, strict=True)))
    assert sorted(map(tuple, got)) == want
    assert op8.near_duplicates(docs.limit(0)).count() == 0
    kept = sorted(r.doc_id for r in op8.one_of_each(docs).collect())
    assert kept == sorted({w[2] for w in want})


def test_one_of_each_by_id_and_text(spark):
    x, other = "a text of some words " * 5, "nothing like it at all, and some more words of another kind"
    rows = [(7, x), (8, x.upper()), (8, other), (9, "alpha beta gamma"), (9, "delta epsilon zeta eta"), (None, "one two three four"), (None, "five six seven eight nine"), (None, x), (11, "twice the same row"), (11, "twice the same row")]
    names = ["_keep", "row", "mark", "fp", "own", "least", "times"]
    d = spark.createDataFrame([(i, t, *[n] * len(names)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = op8.one_of_each(d)
    assert out.columns == d.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted({r for r in rows if r not in ((8, x.upper()), (None, x))}, key=str)
    assert op8.one_of_each(d.limit(0)).count() == 0
