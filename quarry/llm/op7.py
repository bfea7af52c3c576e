"""Toxicity by a linear-chain conditional random field.

Tokens are lower-cased words. Token labels come from the documents' labels: in a toxic
document, a token is labelled toxic if its word, or the beginning of its word (3, 4 or 5
bytes), stands in far more toxic than clean training documents. The field has two states,
hashed features of the token and transitions; forward-backward marginals give each token's
toxicity, a logistic model of their sum and maximum, fitted on documents that the field has
not seen, the document's score. Tokens with a marginal of 0.5 or more are the offending spans.

The fit uses a bounded sample of labelled rows: the ``most_toxic`` and ``most_clean`` labelled
documents that come first by a hash of their id, of those outside the held-out fold and with at
most ``most_chars`` characters; the field is fitted on at most ``MOST_RUNS`` runs of tokens with and as many
without toxic ones, drawn at random. Marginals are those of a whole text's one chain. Scoring covers every whole text and is one map over the rows.

Defined cases: null and empty texts have no tokens and get the score of no evidence; without
labels of both kinds every score is the smoothed share of toxic labels; labels of unknown or
null ids are ignored; repeated rows stay; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import text as T
from quarry.llm.common import documents, slices

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
MOST_TOXIC, MOST_CLEAN, MOST_CHARS, MOST_RUNS = 2500, 2500, 20_000, 30_000
BITS, HEADS, LENGTH = 18, (3, 4, 5), 64


def features(w: T.Words, low: int = 0, high: int | None = None) -> np.ndarray:
    """Feature numbers (token, kind) of tokens low to high: the word, its beginnings, its end."""
    start, end = w.start[low:high], w.end[low:high]
    size = end - start
    out = np.empty((len(start), len(HEADS) + 2), np.int32)
    for i, n in enumerate((None, *HEADS)):
        key = w.range_hash(start, end if n is None else start + np.minimum(size, n))
        out[:, i] = (key >> np.uint64(64 - BITS)).astype(np.int32) + (i << BITS)
    out[:, -1] = (w.range_hash(end - np.minimum(size, 3), end) >> np.uint64(64 - BITS)).astype(np.int32) + (len(HEADS) + 1 << BITS)
    return out


def grid(first: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers by (place, sequence), and which are real: runs of up to ``length`` in one text."""
    n = np.diff(first)
    runs = -(-n // length)
    start = np.repeat(first[:-1], runs) + length * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    end = np.minimum(start + length, np.repeat(first[1:], runs))
    at = start[None, :] + np.arange(length)[:, None]
    real = at < end[None, :]
    return np.where(real, at, 0), real


def forward_backward(e: np.ndarray, real: np.ndarray, trans: np.ndarray, init: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Marginals of state 1 (place, sequence), and expected starts and transitions.

    ``e``: by how much a token's score of state 1 exceeds that of state 0; ``enter``, ``leave``: of
    each sequence the messages (state, sequence) that come from before and after it, if it is part of a longer one.
    """
    length, n = e.shape
    up = np.exp(np.clip(e, -30, 30))
    t = np.exp(trans)
    alpha = np.zeros((length, 2, n))
    a0, a1 = (np.full(n, np.exp(init[0])), np.exp(init[1]) * up[0]) if enter is None else (enter[0], enter[1] * up[0])
    for i in range(length):
        if i:
            b0 = a0 * t[0, 0] + a1 * t[1, 0]
            b1 = (a0 * t[0, 1] + a1 * t[1, 1]) * up[i]
            a0, a1 = np.where(real[i], b0, a0), np.where(real[i], b1, a1)
        z = a0 + a1
        a0, a1 = a0 / z, a1 / z
        alpha[i, 0], alpha[i, 1] = a0, a1
    marginal, pair = np.zeros((length, n)), np.zeros((2, 2))
    b0, b1 = (np.ones(n), np.ones(n)) if leave is None else leave
    for i in range(length - 1, -1, -1):
        p0, p1 = alpha[i, 0] * b0, alpha[i, 1] * b1
        marginal[i] = np.where(real[i], p1 / (p0 + p1), 0)
        if i:
            use = real[i]
            x0, x1 = b0, b1 * up[i]
            q = np.array([[alpha[i - 1, 0] * t[0, 0] * x0, alpha[i - 1, 0] * t[0, 1] * x1], [alpha[i - 1, 1] * t[1, 0] * x0, alpha[i - 1, 1] * t[1, 1] * x1]])
            pair += (q / q.sum(axis=(0, 1)) * use).sum(axis=2)
            c0, c1 = t[0, 0] * x0 + t[0, 1] * x1, t[1, 0] * x0 + t[1, 1] * x1
            s = c0 + c1
            b0, b1 = np.where(use, c0 / s, b0), np.where(use, c1 / s, b1)
    start = np.array([real[0].sum() - marginal[0].sum(), marginal[0].sum()])
    return marginal, start, pair


def messages(e: np.ndarray, real: np.ndarray, runs: np.ndarray, trans: np.ndarray, init: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters and leaves each run (state, run), where runs of one text follow each other.

    ``runs``: of each text, their number. A run is passed once from either state, which gives its
    2 x 2 matrix; matrices of a text are then multiplied from both ends.
    """
    length, n = e.shape
    up, t = np.exp(np.clip(e, -30, 30)), np.exp(trans)
    whole = np.zeros((2, 2, n))  # (state that enters, state of the last token, run)
    whole[0, 0], whole[1, 1] = 1.0, up[0]
    for i in range(1, length):
        after = np.stack([whole[:, 0] * t[0, 0] + whole[:, 1] * t[1, 0], (whole[:, 0] * t[0, 1] + whole[:, 1] * t[1, 1]) * up[i]], axis=1)
        after /= after.sum(axis=(0, 1))
        whole = np.where(real[i], after, whole)
    head = np.cumsum(runs) - runs
    enter, leave = np.zeros((2, n)), np.ones((2, n))
    enter[:, head[runs > 0]] = np.exp(init)[:, None]
    order = np.argsort(-runs, kind="stable")
    longest = int(runs.max()) if len(runs) else 0
    more = [order[: np.searchsorted(-runs[order], -j, "left")] for j in range(longest)]  # texts with over j runs
    for j in range(1, longest):
        r = head[more[j]] + j
        v = t.T @ (enter[:, None, r - 1] * whole[:, :, r - 1]).sum(axis=0)
        enter[:, r] = v / v.sum(axis=0)
    for j in range(longest - 1, 0, -1):
        r = head[more[j]] + j
        v = t @ (whole[:, :, r] * leave[None, :, r]).sum(axis=1)
        leave[:, r - 1] = v / v.sum(axis=0)
    return enter, leave


def _token_labels(feats: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts of which some key is far commoner in toxic texts."""
    n_bad, n_good = toxic.sum(), (~toxic).sum()
    out = np.zeros(len(feats), bool)
    for kind in range(1 + len(HEADS)):
        pairs = np.unique(owner.astype(np.int64) * np.int64(1 << (BITS + 3)) + feats[:, kind])
        key, bad = pairs & ((1 << (BITS + 3)) - 1), toxic[pairs >> (BITS + 3)]
        a, b = (np.bincount(key[x], minlength=len(HEADS) + 2 << BITS) for x in (bad, ~bad))
        ratio = ((a + 0.5) / (n_bad + 1)) / ((b + 0.5) / (n_good + 1))
        out |= ((a >= max(5, 0.005 * n_bad)) & (ratio >= 20))[feats[:, kind]]
    return out & toxic[owner]


def train(texts: list[str], toxic: np.ndarray, epochs: int = 6, seed: int = 1, most_runs: int = MOST_RUNS) -> dict:
    """The field's weights and the document model, as plain arrays.

    The weights are fitted on runs of up to LENGTH tokens, ``most_runs`` with toxic ones and as many without, drawn at random.
    """
    toxic = np.asarray(toxic, bool)
    prior = (toxic.sum() + 0.5) / (len(toxic) + 1)
    model = {"prior": float(prior)}
    # of near copies one only: texts that share the smallest five-word hash
    w = T.Words(pa.array(texts, pa.string()), T.ALNUM, True)
    g, ok = T.ngrams(w.hashes(), 5), T.inside(w.first, 5, w.n)
    seen, keep = set(), []
    for i in range(len(texts)):
        a, b = w.first[i], min(w.first[i + 1], len(g))
        own = g[a:b][ok[a:b]]
        mark = int(own.min()) if len(own) else zlib.crc32(texts[i].encode())
        if mark not in seen:
            seen.add(mark)
            keep.append(i)
    texts, toxic = [texts[i] for i in keep], toxic[keep]
    del w, g, ok
    if not toxic.any() or toxic.all():
        return model
    w = T.Words(pa.array(texts, pa.string()), T.ALNUM, True)
    feats, owner = features(w), w.text_of()
    rng = np.random.default_rng(seed)
    later = rng.random(len(texts)) < 0.35  # for the document model
    if later.all() or not (toxic & ~later).any() or not (~toxic & ~later).any():
        later[:] = False
    fit = ~later[owner]
    label = np.zeros(w.n, bool)
    number = np.cumsum(~later) - 1
    label[fit] = _token_labels(feats[fit], number[owner[fit]], toxic[~later])
    at, real = grid(w.first)
    of = owner[at[0]] if at.size else np.zeros(0, np.int64)
    use = real[0] & ~later[of] if at.size else np.zeros(0, bool)
    bad = (label[at] & real).any(axis=0)
    spare = np.flatnonzero(use & ~bad & ~toxic[of])
    chosen = np.concatenate([rng.permutation(np.flatnonzero(use & bad))[:most_runs], rng.permutation(spare)[:most_runs]])
    size = len(HEADS) + 2 << BITS
    weights, trans, init = np.zeros(size), np.zeros((2, 2)), np.array([0.0, -3.0])
    square, rate = np.full(size, 1e-8), 0.3
    small = np.full(6, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(chosen)
        for s in range(0, len(order), 2048):
            a, r = at[:, order[s : s + 2048]], real[:, order[s : s + 2048]]
            f, y = feats[a], label[a] & r
            m, start, pair = forward_backward(weights[f].sum(axis=2), r, trans, init)
            grad = np.bincount(f.ravel(), weights=np.repeat((y - m).ravel(), f.shape[2]), minlength=size) - 0.02 * weights
            square += grad**2
            weights += rate * grad / np.sqrt(square)
            seen_pair = np.array([[(x & z & r[1:]).sum() for z in (~y[1:], y[1:])] for x in (~y[:-1], y[:-1])])
            g2 = np.concatenate([(seen_pair - pair).ravel(), np.array([(~y[0]).sum(), y[0].sum()]) - start])
            small += g2**2
            step = rate * g2 / np.sqrt(small)
            trans += step[:4].reshape(2, 2)
            init += step[4:]
    del feats, label, at, real
    model |= {"weights": weights.astype(np.float32), "trans": trans, "init": init}
    x = document_features(marginals(w, model), w.first)
    use = later if later.any() else ~later
    model["document"] = _logistic(x[use], toxic[use])
    return model


def marginals(w: T.Words, model: dict) -> np.ndarray:
    """Of each token the probability of the toxic state."""
    out = np.zeros(w.n)
    if not w.n:
        return out
    e = np.concatenate([model["weights"][features(w, at, at + (1 << 18))].sum(axis=1, dtype=np.float64) for at in range(0, w.n, 1 << 18)])
    at, real = grid(w.first)
    enter, leave = messages(e[at], real, -(-np.diff(w.first) // len(at)), model["trans"], model["init"])
    for s in range(0, at.shape[1], 4096):
        own = slice(s, s + 4096)
        a, r = at[:, own], real[:, own]
        m, _, _ = forward_backward(e[a], r, model["trans"], model["init"], enter[:, own], leave[:, own])
        out[a[r]] = m[r]
    return out


def document_features(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(owner, weights=m, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, owner, m)
    return np.stack([np.ones(n), np.log1p(total), most], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (y - p) - ridge * b)
    return b


def score_words(w: T.Words, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the texts and marginals of the tokens."""
    n = len(w.first) - 1
    if "document" not in model:
        return np.full(n, model["prior"]), np.zeros(w.n)
    m = marginals(w, model)
    return 1 / (1 + np.exp(-np.clip(document_features(m, w.first) @ model["document"], -30, 30))), m


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_chars: int = MOST_CHARS) -> DataFrame:
    """(text, toxic): the bounded sample that the model is fitted on."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    picked = own.filter("toxic = 1").orderBy("order", "doc_id").limit(most_toxic).unionByName(own.filter("toxic <> 1").orderBy("order", "doc_id").limit(most_clean)).select("doc_id", "toxic")
    # at most most_toxic + most_clean rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").filter(F.char_length("text") <= most_chars)
    return rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> dict:
    """Train in one task on the bounded sample; the model, a few MB, comes to the driver."""

    def run(table: pa.Table) -> pa.Table:
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        table = table.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))))
        del ids, texts
        model = train(table["text"].to_pylist(), table["toxic"].to_numpy() == 1)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    made = sample(docs, labels, **bounds).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else {"prior": 0.5}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, spans) of each row; spans: (start, end) of offending words in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = T.Words(part.column("text"), T.ALNUM, True)
                s, m = score_words(w, shared.value)
                hot, points = np.flatnonzero(m >= 0.5), np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
                owner = w.text_of()[hot]
                a, b = (points[x[hot]] - points[w.base[owner]] for x in (w.start, w.end))
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), spans], ["doc_id", "score", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:long,end:long>>")


def reject(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with a score below the threshold, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s, _ = score_words(T.Words(part.column("text"), T.ALNUM, True), shared.value)
                yield part.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return score(docs, model).select("doc_id", (fold == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op7_crf_toxicity": query}
ORACLES: dict[str, str] = {}
