from collections import Counter

import pytest

from quarry.llm import op1


def test_table_is_fair_and_moves_little():
    a = op1.lookup_table(op1.names(), op1.SIZE)
    n = Counter(a)
    assert len(n) == op1.SHARDS and max(n.values()) - min(n.values()) <= 1
    fewer = [s for s in op1.names() if s != "shard-00007"]
    b = [fewer[x] for x in op1.lookup_table(fewer, op1.SIZE)]
    moved = sum(op1.names()[x] != y for x, y in zip(a, b, strict=True) if x != 7)
    assert moved < 0.1 * op1.SIZE


def test_bad_sizes():
    for shards, size in ((["a"], 10), ([], 7), (["a", "a"], 7), (list("abcd"), 3)):
        with pytest.raises(ValueError):
            op1.lookup_table(shards, size)


def test_place(spark, tmp_path):
    rows = [(None, "x"), (1, "x"), (1, "y"), (2, None), (10**15, "")]
    d = spark.createDataFrame(rows, "doc_id long, shard string")
    got = op1.place(d, "doc_id").collect()
    table = op1.lookup_table(op1.names(), op1.SIZE)
    assert len(got) == 5
    for r in got:
        slot = op1._digits("" if r.doc_id is None else str(r.doc_id)) % op1.SIZE
        assert (r.slot, r.shard) == (slot, op1.names()[table[slot]])
    assert op1.place(d.limit(0), "doc_id").count() == 0
    op1.write_shards(d, "doc_id", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_names_with_commas(spark):
    d = spark.range(200).withColumnRenamed("id", "k")
    assert {r.shard for r in op1.place(d, "k", ["a,b", 'c"d', "e"], 7).collect()} == {"a,b", 'c"d', "e"}
