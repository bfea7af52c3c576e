"""Sharding by a permutation-filled lookup table.

Each shard orders the slots of a prime-sized table by its own permutation; the shards take
turns, each claiming its first free slot, until the table is full. A key hashes to a slot and
so finds its shard in constant time from the broadcast table; losing a shard moves few other
keys. The table has ``size`` entries whatever the data, which bounds the broadcast.

Placing is one map over the rows, without a shuffle. ``write_shards`` rebalances on the
shard, so that a shard with a third of all rows is written by many tasks.

Defined cases: a null key is placed like the empty string; equal keys share a shard; columns
named like the added ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 20 shards with about 100 slots each; pass other names and a larger prime for more.
SHARDS, SIZE = 20, 2003


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def _digits(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """Of each slot, the number of its shard."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    if not 0 < len(set(shards)) == len(shards) <= size:
        raise ValueError("shards must be distinct, one at least and no more than slots")
    step = [(_digits(s + "#offset") % size, _digits(s + "#skip") % (size - 1) + 1) for s in shards]
    turn, slots, free = [0] * len(shards), [-1] * size, size
    while True:
        for i, (offset, skip) in enumerate(step):
            while slots[slot := (offset + turn[i] * skip) % size] >= 0:
                turn[i] += 1
            slots[slot] = i
            free -= 1
            if not free:
                return slots


def table_frame(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """(slot, shard): the lookup table as ``size`` rows, made from one literal."""
    text = F.lit(json.dumps(lookup_table(shards, size)))
    one = spark.range(1).select(F.posexplode(F.from_json(text, "array<int>")).alias("slot", "number"))
    return one.select("slot", F.element_at(F.from_json(F.lit(json.dumps(shards)), "array<string>"), F.col("number") + 1).alias("shard"))


def slot_of(key, size: int = SIZE):
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return F.pmod(digits, F.lit(size)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """The rows with ``slot`` and ``shard``."""
    shards = shards or names()
    table = table_frame(rows.sparkSession, shards, size)
    placed = rows.drop("shard").withColumn("slot", slot_of(rows[key], size))
    return placed.join(F.broadcast(table), "slot", "left").select(*placed.columns, "shard")


def write_shards(rows: DataFrame, key: str, path: str, shards: list[str] | None = None, size: int = SIZE) -> None:
    """Parquet under ``path``, partitioned by shard; large shards get several files."""
    place(rows, key, shards, size).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


#: The same turn-taking in SQL: each step claims one slot; t counts steps, the shard is t mod n.
ORACLE = f"""
WITH RECURSIVE shard AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS name FROM range({SHARDS}) r(i)),
step AS (
  SELECT i, name, ('0x' || md5(name || '#offset')[1:15])::BIGINT % {SIZE} AS o,
         ('0x' || md5(name || '#skip')[1:15])::BIGINT % {SIZE - 1} + 1 AS s FROM shard),
pref AS (SELECT i, list((o + j * s) % {SIZE} ORDER BY j) AS slots FROM step, range({SIZE}) r(j) GROUP BY i),
fill AS (
  SELECT 0 AS t, NULL::BIGINT AS slot, list_resize([]::BOOLEAN[], {SIZE}, false) AS taken
  UNION ALL
  SELECT t + 1, f.slot, taken[1:f.slot] || [true] || taken[f.slot + 2:]
  FROM (SELECT t, taken, list_filter(p.slots, lambda x: NOT taken[x + 1])[1] AS slot
        FROM fill JOIN pref p ON p.i = t % {SHARDS} WHERE t < {SIZE}) f),
slots AS (SELECT slot, name FROM fill JOIN shard ON i = (t - 1) % {SHARDS} WHERE t > 0)
SELECT doc_id, k.slot::INTEGER AS slot, name AS shard
FROM (SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT % {SIZE} AS slot FROM documents) k
JOIN slots USING (slot)
"""

QUERIES = {"op1_maglev_sharding": query}
ORACLES = {"op1_maglev_sharding": ORACLE}
