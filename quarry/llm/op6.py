"""Exact substring deduplication over a log-structured fingerprint index.

A window is 50 consecutive words. Its fingerprint is winnowed: the smallest hash among its
25-word shingles, so equal windows have equal fingerprints and about one place in 13 is stored.
Documents come in batches of ascending id. An ``Index`` holds sorted immutable runs of earlier
batches' fingerprints with the documents that hold them, each a table bucketed and sorted by
fingerprint, so a run is never shuffled again. A batch's fingerprints are merge-joined
with every run; documents of either side with a shared one are read, and of their windows with a
shared fingerprint the words themselves are compared (by a 128-bit cryptographic digest of all 50).
Windows that start in a document with a smaller id are cut out. A batch's fingerprints
become its own run in the index. When more than
``fan_in`` runs have gathered they are compacted into one. A whole text that a smaller id has (by SHA-256)
needs no windows: all of them start there.

An index of a named folder is opened again by ``Index(spark, path)``. The texts it needs to compare
words are stored with it, or given as a table (``texts``) that still holds all earlier batches.

Texts are shuffled only for documents that may hold a shared fingerprint, told by a table of
at most 2^20 bucket numbers.

Defined cases: null texts have no words; rows with a null ``doc_id`` are kept whole and cut
nothing; rows that share a ``doc_id`` are compared with smaller ids only; extra columns are
ignored; an empty table gives an empty result; a batch with ids not above those of the index is an error.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import text as T
from quarry.llm.common import _fs, documents, drop, may_match, scratch, shared_dir, slices

WINDOW, SHINGLE, BATCHES, FAN_IN, BUCKETS = 50, 25, 2, 1, 64


def _window_marks(h: np.ndarray, first: np.ndarray, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprint of the window at each place, and whether one text holds it."""
    g = T.ngrams(h, shingle)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    span, width, low = window - shingle + 1, 1, g
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    return low, T.inside(first, window, len(h))


def fingerprints(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(mark, doc_id, own): each row's winnowed fingerprints, once a stretch of windows."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = T.Words(part.column("text"), T.NON_SPACE, False)
                low, ok = _window_marks(w.hashes(), w.first, window, shingle)
                owner = w.text_of()[: len(low)][ok]
                low = low[ok]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                low, owner = low[new], pa.array(owner[new])
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), part.column("doc_id").take(owner), part.column("own").take(owner)], ["mark", "doc_id", "own"])

    return docs.select("doc_id", "own", "text").mapInArrow(run, "mark long, doc_id long, own long")


class Index:
    """Runs (mark, doc_id) and whole texts (sha, doc_id) of earlier batches, in a folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN, buckets: int = BUCKETS, texts: DataFrame | None = None):
        self.spark, self.fan_in, self.buckets, self.texts = spark, fan_in, buckets, texts
        self.path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.state = {"runs": [], "shas": [], "texts": [], "top": None, "buckets": buckets, "compactions": 0}
        fs, at = _fs(spark, f"{self.path}/state.json")
        if path is None:
            fs.deleteOnExit(at.getParent())
        elif fs.exists(at):
            self.state = json.loads("".join(r.value for r in spark.read.text(f"{self.path}/state.json").collect()))
            self.buckets = self.state["buckets"]

    def _save(self) -> None:
        """The state names what is valid; folders it doesn't name are of a batch that failed."""
        fs, at = _fs(self.spark, f"{self.path}/state.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()

    def _run(self, name: str) -> DataFrame:
        table = f"quarry_{name.replace('-', '_')}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} (mark BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (mark) SORTED BY (mark) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(table)

    def _write_run(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        # dealt by bucket, whatever the number of partitions: one file a bucket, not one of each bucket a task
        rows.repartition(F.pmod(F.hash("mark"), F.lit(self.buckets))).write.bucketBy(self.buckets, "mark").sortBy("mark").option("path", f"{self.path}/{name}").saveAsTable(f"quarry_{name.replace('-', '_')}")
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS quarry_{name.replace('-', '_')}")
        fs, at = _fs(self.spark, f"{self.path}/{name}")
        fs.delete(at, True)

    def known(self, marks: DataFrame) -> DataFrame | None:
        """(mark, doc_id) of earlier documents that hold one of the (mark)s, by a merge join with each run."""
        found = [self._run(r).hint("merge").join(marks, "mark", "left_semi") for r in self.state["runs"]]
        return reduce(DataFrame.unionByName, found) if found else None

    def shas(self) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{x}" for x in self.state["shas"]]) if self.state["shas"] else None

    def stored(self) -> DataFrame:
        """(doc_id, text) of earlier batches."""
        return self.texts if self.texts is not None else self.spark.read.parquet(*[f"{self.path}/{x}" for x in self.state["texts"]])

    def add(self, rows: DataFrame, shas: DataFrame, texts: DataFrame, top: int) -> None:
        state = dict(self.state, runs=[*self.state["runs"], self._write_run(rows)], top=top)
        for kind, df in (("shas", shas), ("texts", texts if self.texts is None else None)):
            if df is not None:
                name = f"{kind}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.path}/{name}")
                state[kind] = [*state[kind], name]
        self.state = state
        if len(self.state["runs"]) > self.fan_in:
            self.compact()
        self._save()

    def compact(self) -> None:
        """All runs into one."""
        old = self.state["runs"]
        self.state = dict(self.state, runs=[self._write_run(reduce(DataFrame.unionByName, [self._run(r) for r in old]))], compactions=self.state["compactions"] + 1)
        self._save()
        for name in old:
            self._forget(name)


def _batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """Slices of ascending ids, about as many rows each."""
    if n < 2:
        return [docs]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 1000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    ends = [None, *cuts, None]
    out = []
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        part = docs if low is None else docs.filter(F.col("doc_id") > low)
        # rows without an id belong to the first batch
        out.append(part if high is None else part.filter((F.col("doc_id") <= high) | (F.lit(low is None) & F.col("doc_id").isNull())))
    return out


def _windows(docs: DataFrame, window: int, shingle: int) -> DataFrame:
    """(h, check, doc_id, mark, at) of the windows whose fingerprint is in the row's ``marks``: a digest of the words, and the first word's place."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = T.Words(part.column("text"), T.NON_SPACE, False)
                at = np.flatnonzero(_chosen(w, w.hashes(), part.column("marks"), window, shingle))
                data, to = w.spaced()
                owner = w.text_of()[at]
                blake = hashlib.blake2b
                digest = b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(to[at].tolist(), to[at + window].tolist(), strict=True)])
                pairs = np.frombuffer(digest, np.int64).reshape(-1, 2)
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), part.column("doc_id").take(own), part.column("own").take(own), pa.array((at - w.first[owner]).astype(np.int32))],
                    ["h", "check", "doc_id", "own", "at"],
                )

    return docs.select("doc_id", "own", "text", "marks").mapInArrow(run, "h long, check long, doc_id long, own long, at int")


def _chosen(w: T.Words, h: np.ndarray, marks: pa.Array, window: int, shingle: int) -> np.ndarray:
    low, ok = _window_marks(h, w.first, window, shingle)
    use = np.zeros(len(low), bool)
    for i in range(len(marks)):
        a, b = int(w.first[i]), min(int(w.first[i + 1]), len(low))
        if b > a and marks[i].is_valid:
            use[a:b] = np.isin(low[a:b], np.asarray(marks[i].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64))
    return use & ok


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """The result of rows (doc_id, text, hits): the windows at the places ``hits`` go, of null none, of an empty list (a copy) all."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = T.Words(part.column("text"), T.NON_SPACE, False)
                data, to = w.spaced()
                hits, n_removed, kept = part.column("hits"), [], []
                for i in range(part.num_rows):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    if not hits[i].is_valid or b - a < window:
                        kept.append(data[to[a] : max(int(to[a]), int(to[b]) - 1)].decode())
                        n_removed.append(0)
                        continue
                    at = np.asarray(hits[i].values.to_numpy(zero_copy_only=False), np.int64)
                    at = at if len(at) else np.arange(b - a - window + 1)
                    cover = np.bincount(at, minlength=b - a + 1) - np.bincount(at + window, minlength=b - a + 1)
                    stay = np.flatnonzero(np.cumsum(cover)[:-1] == 0) + a
                    kept.append(b" ".join([data[s : e - 1] for s, e in zip(to[stay].tolist(), to[stay + 1].tolist(), strict=True)]).decode())
                    n_removed.append(b - a - len(stay))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts().astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "hits").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _one_batch(docs: DataFrame, index: Index, window: int, shingle: int) -> DataFrame:
    """(doc_id, own, hits) of the rows of a batch (doc_id, own, text) that lose words; the index then holds the batch."""
    docs = docs.filter("doc_id is not null and text is not null")
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if ends["low"] is not None and index.state["top"] is not None and ends["low"] <= index.state["top"]:
        raise ValueError("a batch's ids must be above those of the index")
    each = scratch(docs.select(F.sha2("text", 256).alias("sha"), "doc_id", "own"), "shas")
    whole = each.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    least = whole
    if index.shas() is not None:
        old = index.shas().groupBy("sha").agg(F.min("doc_id").alias("old"))
        least = whole.join(old, "sha", "left").select("sha", F.coalesce("old", "low").alias("low"), "high")
    copies = scratch(each.join(least.filter("low < high"), "sha").filter("low < doc_id").select("doc_id", "own").distinct(), "copies")
    marks = scratch(fingerprints(docs, window, shingle).join(copies, ["doc_id", "own"], "left_anti").select("mark", "doc_id", "own"), "marks")
    by_mark = scratch(marks.groupBy("mark").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "by-mark")
    shared = by_mark.filter("low < high").select("mark")
    listed = []
    old = index.known(by_mark.select("mark"))
    if old is not None:
        old = scratch(old, "known")
        shared = shared.unionByName(old.select("mark")).distinct()
        lists = scratch(old.groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), "old-lists")
        texts, _ = may_match(index.stored().select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), F.col("doc_id"), lists.select("doc_id"))
        listed.append(texts.join(lists, "doc_id").select("doc_id", F.lit(None).cast("long").alias("own"), "text", "marks"))
    lists = scratch(marks.join(shared, "mark", "left_semi").groupBy("doc_id", "own").agg(F.collect_set("mark").alias("marks")), "lists")
    maybe, _ = may_match(docs, F.col("doc_id"), lists.select("doc_id"))
    listed.append(maybe.join(lists, ["doc_id", "own"]).select("doc_id", "own", "text", "marks"))
    found = scratch(_windows(reduce(DataFrame.unionByName, listed), window, shingle), "windows")
    low = found.groupBy("h", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("h", "check", "low")
    hits = found.filter("own is not null").join(low, ["h", "check"]).filter("low < doc_id").groupBy("doc_id", "own").agg(F.collect_set("at").alias("hits"))
    hits = scratch(hits.unionByName(copies.select("doc_id", "own", F.array().cast("array<int>").alias("hits"))), "hits")
    if ends["high"] is not None:
        index.add(marks.select("mark", "doc_id").distinct(), whole.select("sha", F.col("low").alias("doc_id")), docs.select("doc_id", "text"), ends["high"])
    drop(found, marks, by_mark, each, copies, lists)
    return hits


def cut_repeats(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, batches: int = BATCHES, index: Index | None = None) -> DataFrame:
    """(doc_id long, n_words, n_removed, kept) of each row; ``kept``: words joined by one space.

    ``index``: what earlier calls left; by default one that lives as long as the session.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), text.alias("text"))
    index = index or Index(docs.sparkSession, texts=docs)
    hits = reduce(DataFrame.unionByName, [_one_batch(part, index, window, shingle) for part in _batches(docs, batches)])
    maybe, sure = may_match(docs, F.col("doc_id"), hits.select("doc_id"))
    both = maybe.join(hits, ["doc_id", "own"], "left").select("doc_id", "text", "hits")
    return _cut(both.unionByName(sure.select("doc_id", "text", F.lit(None).cast("array<int>").alias("hits"))), window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": query}
ORACLES: dict[str, str] = {}
