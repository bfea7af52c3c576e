"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of 13 consecutive words (a shorter item is one window). A
window is the set of its word shingles (five words; all words of a shorter window). Since
containment must be whole, one prefix token is enough: the window's rarest shingle over all
documents. Places in documents where a prefix token stands are the candidates; the token's
offset gives the only possible start (positional bound), the window must end in the document
(length bound), and the words are then compared one by one.

The index is shared with every task only while it has at most ``most`` windows; a larger
benchmark is worked in parts of that size, whose spans are merged for each document.

Defined cases: null texts have no words; an item without words has no window; a null
``item_id`` is written "null"; repeated rows are judged alike and stay; extra columns are
ignored; an empty benchmark contaminates nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import text as T
from quarry.llm.common import documents, packed, scratch, slices

WINDOW, SHINGLE, MOST = 13, 5, 400_000


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, length, wide, body, shift, k, token): each window's shingles, by their place."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w, ids = T.Words(part.column("text"), T.ALNUM, True), part.column("item").to_pylist()
                h, rows = w.hashes(), []
                for i, item in enumerate(ids):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    k = min(shingle, n)
                    tokens, wide = T.ngrams(h[a:b], k).view(np.int64), T.ngrams(h[a:b], n).view(np.int64)
                    for s in range(b - a - n + 1):
                        body = b" ".join(bytes(w.buf[w.start[j] : w.end[j]]) for j in range(a + s, a + s + n))
                        rows += [(item, n, int(wide[s]), body, j, k, int(tokens[s + j])) for j in range(n - k + 1)]
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["item", "length", "wide", "body", "shift", "k", "token"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, length int, wide long, body binary, shift int, k int, token long")


def _token_counts(docs: DataFrame, tokens: dict[int, np.ndarray]) -> DataFrame:
    """(k, token, df): places in documents where each token stands; zero ones are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        total = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        for batch in batches:
            for part in slices(batch):
                w = T.Words(part.column("text"), T.ALNUM, True)
                h = w.hashes()
                for k, known in shared.value.items():
                    g = T.ngrams(h, k).view(np.int64)[T.inside(w.first, k, w.n)]
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    total[k] += np.bincount(at[known[at] == g], minlength=len(known))
        for k, n in total.items():
            has = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(has.sum(), k, np.int32)), pa.array(shared.value[k][has]), pa.array(n[has])], ["k", "token", "df"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k int, token long, df long").groupBy("k", "token").agg(F.sum("df").alias("df"))


def _find(docs: DataFrame, index: dict) -> DataFrame:
    """(doc_id, mark, n_words, spans, items) of each row, by one part of the index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        index = shared.value
        for batch in batches:
            for part in slices(batch):
                w = T.Words(part.column("text"), T.ALNUM, True)
                h, n = w.hashes(), part.num_rows
                spans: list[list] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                for k, (tokens, head) in index["tokens"].items():
                    g = T.ngrams(h, k).view(np.int64)
                    at = np.minimum(np.searchsorted(tokens, g), len(tokens) - 1)
                    for place in np.flatnonzero(tokens[at] == g).tolist():
                        doc = int(np.searchsorted(w.first, place, "right")) - 1
                        low, high = int(w.first[doc]), int(w.first[doc + 1])
                        for x in range(head[at[place]], head[at[place] + 1]):
                            shift, length, body, ids = index["windows"][k][x]
                            start = place - shift
                            if start < low or start + length > high:
                                continue
                            if b" ".join(bytes(w.buf[a:b]) for a, b in zip(w.start[start : start + length].tolist(), w.end[start : start + length].tolist(), strict=True)) == body:
                                spans[doc].append((start - low, start - low + length))
                                items[doc].update(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(w.counts().astype(np.int64)), pa.array([[{"a": a, "b": b} for a, b in sorted(set(s))] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                    ["doc_id", "mark", "n_words", "spans", "items"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, mark long, n_words long, spans array<struct<a:long,b:long>>, items array<string>")


def _parts(prefix: DataFrame, most: int):
    """The index in parts of at most ``most`` windows each, as plain arrays."""
    n = prefix.count()
    pieces = -(-n // most)
    for piece in range(pieces):
        rows = (prefix if pieces == 1 else prefix.filter(F.pmod(F.xxhash64("body"), F.lit(pieces)) == piece)).toLocalIterator()
        by_k: dict[int, list] = {}
        for r in rows:
            by_k.setdefault(r["k"], []).append((r["token"], r["shift"], r["length"], bytes(r["body"]), r["items"]))
        index: dict = {"tokens": {}, "windows": {}}
        for k, found in by_k.items():
            found.sort(key=lambda x: x[:4])
            tokens, head = np.unique(np.array([f[0] for f in found], np.int64), return_index=True)
            index["tokens"][k] = (tokens, np.append(head, len(found)))
            index["windows"][k] = [f[1:] for f in found]
        yield index


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, spans, items) of each row of ``docs``.

    ``spans``: word ranges of occurring windows; ``items``: the items they come from;
    ``mark``: xxhash64 of the text, which tells rows with one id apart.
    """
    parts = scratch(windows(benchmark, window, shingle), "windows")
    counts = None
    tokens = parts.select("k", "token").distinct()
    n_tokens = tokens.count()
    pieces = max(1, -(-n_tokens // (4 * most)))
    for piece in range(pieces):
        by_k: dict[int, list] = {}
        for r in tokens.filter(F.pmod("token", F.lit(pieces)) == piece).toLocalIterator():
            by_k.setdefault(r["k"], []).append(r["token"])
        if by_k:
            one = _token_counts(docs, {k: np.sort(np.array(v, np.int64)) for k, v in by_k.items()})
            counts = one if counts is None else counts.unionByName(one)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    if counts is not None:
        body = ["length", "wide", "body"]
        rank = Window.partitionBy(*body).orderBy("df", "shift")
        whole = parts.join(counts, ["k", "token"], "left").groupBy(*body, "shift", "k", "token").agg(F.min(F.coalesce("df", F.lit(0))).alias("df"))
        prefix = whole.withColumn("rank", F.row_number().over(rank)).filter("rank = 1 and df > 0").drop("rank", "df")
        of = parts.filter("shift = 0").groupBy(*body).agg(F.sort_array(F.collect_set("item")).alias("items"))
        prefix = scratch(prefix.join(of, body), "prefix")
        for index in _parts(prefix, most):
            one = _find(docs, index)
            found = [one] if found is None else [*found, one]
    if not found:
        empty = {"tokens": {}, "windows": {}}
        found = [_find(docs, empty)]
    out = found[0]
    if len(found) > 1:  # every part has each row once
        for one in found[1:]:
            out = out.unionByName(one)
        out = out.groupBy("doc_id", "mark", "n_words").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / len(found)).cast("int").alias("copies"))
        out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    # words covered by sorted spans: what each adds beyond the furthest end so far
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n")), lambda acc: acc["n"])
    return out.select(F.col("doc_id").cast(kind), "mark", "n_words", covered.alias("n_hit"), "spans", "items")


def is_contaminated(n_words="n_words", n_hit="n_hit"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    bad = contamination(docs.select("doc_id", "text"), benchmark).filter(is_contaminated()).select("doc_id", "mark").distinct()
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("mark"))
    return packed(docs).join(bad, same, "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


QUERIES = {"op3_benchmark_decontamination": query}
ORACLES: dict[str, str] = {}
