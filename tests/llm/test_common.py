import os

import pytest
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.components import components


def test_components_by_union_find(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1), (20, 3), *[(i, i + 1) for i in range(100, 140)]]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7, **{i: 100 for i in range(100, 141)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError, match="not settled"):
        components(spark.createDataFrame(edges, "a long, b long"), rounds=1)


def test_may_match_keeps_all_and_any_name(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (None, 7)], "_bucket long, row long")
    maybe, sure = common.may_match(rows, F.col("_bucket"), spark.createDataFrame([(1,)], "x long"))
    assert maybe.columns == rows.columns and [r["_bucket"] for r in maybe.collect()] == [1]
    assert sorted(r.row or 0 for r in sure.collect()) == [0, 7]


def test_scratch_and_drop(spark):
    df = common.scratch(spark.range(5), "test")
    folder = {f.removeprefix("file://").rsplit("/", 1)[0] for f in df.inputFiles()}.pop()
    assert df.count() == 5 and os.path.isdir(folder)
    common.drop(df)
    assert not os.path.isdir(folder)
    assert spark.conf.get(common.CLEAN_SHUFFLES, "false") == "false"
