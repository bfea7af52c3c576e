"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Two fingerprints at distance 2 or less have one
segment at distance 1 or less, so they share one of its one-wildcard variants; an equality join
on variants finds every pair, the join condition verifies it. A variant held by more than
``heavy`` fingerprints isn't joined with itself: its fingerprints are re-indexed with every
choice of two wildcards over all 64 bits, where all that share a key are linked, so a link of
each to the smallest suffices and the rows stay proportional to the fingerprints.

Defined cases: null text has no words (fingerprint zero); a null ``doc_id`` is a row like any
other, its component is the smallest id that isn't null (null if there is none); repeated rows
stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import text as T
from quarry.llm.common import documents, packed, scratch, slices
from quarry.llm.components import components

SEGMENT_BITS = 32
HEAVY = 2048


def _bits_over_half(h: np.ndarray, first: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """For each text the majority bits of its hashes (uint64); no hash: zero."""
    n = len(first) - 1
    total = np.zeros((n, 64), np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    for at in range(0, len(h), most):
        part, own = h[at : at + most], owner[at : at + most]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        np.add.at(total, own[heads], np.add.reduceat(bits, heads, axis=0, dtype=np.int64))
    over = total * 2 > np.diff(first)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(n)


def _simhash(column: pa.Array, shingle: int, seed: int) -> np.ndarray:
    w = T.Words(column, T.NON_SPACE, lower=True)
    counts = w.counts()
    data, to = w.spaced()
    per_text = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    first = np.concatenate([[0], np.cumsum(per_text)])
    number = np.arange(int(first[-1])) - np.repeat(first[:-1], per_text) + np.repeat(w.first[:-1], per_text)
    last = np.minimum(number + shingle, np.repeat(w.first[1:], per_text))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], seed) for a, b in zip(to[number].tolist(), (to[last] - 1).tolist(), strict=True)), np.uint64, len(number))
    return _bits_over_half(h, first)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fp long): the SimHash of each row's text; ``mark``: xxhash64 of the text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fp = _simhash(part.column("text"), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(fp)], ["doc_id", "mark", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, mark long, fp long")


def _segments() -> list[tuple[int, int]]:
    return [(s, (1 << SEGMENT_BITS) - 1 << s) for s in range(0, 64, SEGMENT_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame) -> DataFrame:
    """(fp, seg, bit, part): each fingerprint with one bit of one segment taken out."""
    rows = None
    for shift, mask in _segments():
        one = fps.select("fp", F.lit(shift).cast("tinyint").alias("seg"), F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))).alias("bit"))
        part = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_signed(mask))), shift)
        one = one.withColumn("part", part.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)")))).withColumn("bit", F.col("bit").cast("tinyint"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def links(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all at distance 2 or less.

    Joins of exploded rows are merge joins by hint: Spark's estimate doesn't know how many rows an
    explode makes, and would broadcast all variants while the fingerprints are few enough.
    """
    key = ["seg", "bit", "part"]
    held = variants(fps)
    crowd = scratch(held.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select(*key), "crowd")
    has_crowd = bool(crowd.limit(1).count())
    light = held.join(crowd, key, "left_anti") if has_crowd else held
    left, right = light.withColumnRenamed("fp", "a"), light.withColumnRenamed("fp", "b")
    gap = F.col("a").bitwiseXOR(F.col("b"))
    part = F.when(F.col("seg") == 0, gap.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))).otherwise(F.shiftrightunsigned(gap, SEGMENT_BITS))
    # a pair is told once for a segment: at the bit that differs, at bit 0 if none does
    once = F.when(part == 0, F.col("bit") == 0).otherwise(part == F.expr("shiftleft(1L, bit)"))
    near = left.hint("merge").join(right, key).filter((F.col("a") < F.col("b")) & (F.bit_count(gap) <= 2) & once)
    out = near.select("a", "b")
    if has_crowd:
        pairs = [_signed(((1 << 64) - 1) ^ (1 << i) ^ (1 << j)) for i in range(64) for j in range(i)]
        members = held.join(crowd, key, "left_semi").select("fp").distinct()
        wild = members.select("fp", F.posexplode(F.expr(f"array({','.join(f'{m}L' if m != -(1 << 63) else 'bigint(-9223372036854775808)' for m in pairs)})")).alias("which", "mask"))
        wild = wild.select("fp", "which", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
        low = wild.groupBy("which", "rest").agg(F.min("fp").alias("low"), F.count("*").alias("n")).filter("n > 1")
        out = out.unionByName(wild.hint("merge").join(low.drop("n"), ["which", "rest"]).filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct())
    return out.distinct()


def _rooted(each: DataFrame, heavy: int) -> DataFrame:
    """(fp, ...) of different fingerprints -> the same with ``root``, that of their group."""
    roots = components(links(each.select("fp"), heavy))
    return each.join(roots, each["fp"] == roots["node"], "left").select(*each.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, fp long, component_id): each row's fingerprint and its group's smallest id."""
    rows = scratch(fingerprints(docs), "simhash")
    of = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), heavy)
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The documents with one of each near-duplicate group kept: the one with the smallest id.

    A document is told by id and text: texts under one id that are of different groups all
    stay, and so do different texts with a null id. Of a group's texts under its smallest id
    the one with the smallest hash stays; of rows with its id and text one, the first by the
    hash of all columns. Null ids come last.
    """
    rows = scratch(fingerprints(docs), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "mark")
    of = _rooted(rows.groupBy("fp").agg(F.min(place).alias("least")), heavy)
    keep = of.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.mark")
    times = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("times"))
    same = F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.mark") == F.col("t.mark"))
    keep = scratch(keep.alias("k").join(times.alias("t"), same).select("k.doc_id", "k.mark", "times"), "keep")
    own = packed(docs).withColumn("own", F.xxhash64(F.col("row.text").cast("string")))
    kept = own.join(keep, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("mark")))
    once = kept.filter("times > 1").groupBy("doc_id", "mark").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.filter("times = 1").select("row.*").unionByName(once.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": query}
ORACLES: dict[str, str] = {}
