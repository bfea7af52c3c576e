"""Search: TF-IDF, BM25, nearest neighbours, rank fusion, reranking, hybrid.

Corpus sizes and document frequencies come from one-row aggregates in the same plan; the only
tables broadcast are those: a row for the whole corpus or one for each word of the query.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import core as C

K1, B, FLOOR = 1.2, 0.75, 0.01
#: Weights of the channels in rank fusion, rank offset and bonus for each further channel.
CHANNELS, RANK_K, BONUS = {"content": 1.0, "path": 1.8, "vector": 0.8}, 20.0, 0.35


def term_frequencies(rows: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(file_id, term, tf) of (file_id, text)."""
    words = C.tokens(F.col("text"))
    if only is not None:
        words = F.filter(words, lambda t: t.isin(only))
    return rows.select("file_id", F.explode(words).alias("term")).groupBy("file_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    return term_frequencies(rows).groupBy("term").agg(F.count("*").alias("df"))


def top(rows: DataFrame, k: int, score: str = "score", *ids: str) -> DataFrame:
    return rows.orderBy(F.col(score).desc(), *(ids or ("file_id",))).limit(k)


def lexical_search(rows: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(file_id, score): sum over query tokens of tf (ln(N / (1 + df)) + 1), largest first."""
    words = C.query_tokens(query)
    tf = term_frequencies(rows, sorted(set(words)))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    times = F.create_map(*[F.lit(x) for w in sorted(set(words)) for x in (w, words.count(w))]) if words else F.create_map().cast("map<string,int>")
    weight = F.element_at(times, F.col("term")) * F.col("tf") * (F.ln(F.col("n") / (1 + F.col("df"))) + 1)
    found = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(n)).groupBy("file_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return top(found, k)


def bm25(rows: DataFrame, phrases: list[list[str]], columns: dict[str, float], scoped: dict[str, list[str]] | None = None, all_of: bool = True) -> DataFrame:
    """(file_id, score) of rows with token arrays.

    ``columns``: token array columns and their weights; they make up a row's length.
    ``scoped``: phrase columns if phrases are told apart by column (path search), any of which
    will do; otherwise a phrase may stand in any column and ``all_of`` them must.
    """
    length = reduce(lambda a, b: a + b, [F.size(c) for c in columns])
    parts = [(p, [c]) for p in phrases for c in scoped["any"]] if scoped else [(p, list(columns)) for p in phrases]
    counts = [reduce(lambda a, b: a + b, [columns[c] * C.phrase_count(F.col(c), p) for c in own]) for p, own in parts]
    rows = rows.select("file_id", length.alias("length"), *[c.cast("double").alias(f"f{i}") for i, c in enumerate(counts)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(parts))])
    has = [F.col(f"f{i}") > 0 for i in range(len(parts))]
    wanted = reduce((lambda a, b: a | b) if scoped or not all_of else (lambda a, b: a & b), has)
    score = F.lit(0.0)
    for i in range(len(parts)):
        raw = F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        f = F.col(f"f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.filter(wanted).crossJoin(F.broadcast(stats)).select("file_id", F.greatest(score, F.lit(FLOOR)).alias("score"))


def indexed(files: DataFrame) -> DataFrame:
    """(file_id, t_filename, t_path, t_content) token arrays of files with ``text``."""
    return files.select("file_id", *[C.search_tokens(F.col(c)).alias(f"t_{n}") for n, c in (("filename", "filename"), ("path", "path"), ("content", "text"))])


def content_search(files: DataFrame, query: str, k: int = 30) -> DataFrame:
    own = C.phrases(query)
    if not own:
        return files.select("file_id", F.lit(0.0).alias("score")).limit(0)
    return top(bm25(indexed(files), own, {"t_filename": 1.0, "t_path": 1.0, "t_content": 1.0}).withColumn("score", F.round("score", 6)), k)


def path_search(files: DataFrame, query: str, k: int = 30) -> DataFrame:
    """The whole query is one phrase, in the file's name or its path."""
    phrase = [p for own in C.phrases(query) for p in own]
    if not phrase:
        return files.select("file_id", F.lit(0.0).alias("score")).limit(0)
    found = bm25(indexed(files), [phrase], {"t_filename": 0.5, "t_path": 1.0, "t_content": 1.0}, {"any": ["t_filename", "t_path"]})
    return top(found.withColumn("score", F.round("score", 6)), k)


def nearest(vectors: DataFrame, query: list[float] | Column, k: int = 10, model: str | None = None) -> DataFrame:
    """(id, similarity) of the k vectors nearest to one."""
    rows = vectors.filter(F.col("model_name") == model) if model else vectors
    vector = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    return rows.select("id", F.round(C.cosine(F.col("vector"), vector), 6).alias("similarity")).orderBy(F.col("similarity").desc(), "id").limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """(query_id, id, similarity, rank); queries are broadcast in blocks of about ``block``, dealt by their id."""
    blocks = math.ceil(queries.count() / block) or 1
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")

    def best(some: DataFrame) -> DataFrame:
        pairs = vectors.crossJoin(F.broadcast(some)).select("query_id", "id", F.round(C.cosine(F.col("vector"), F.col("query_vector")), 6).alias("similarity"))
        return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    return reduce(DataFrame.unionByName, [best(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries) for i in range(blocks)])


def ranked(hits: DataFrame, channel: str) -> DataFrame:
    """A channel's hits with their place, 1 first."""
    order = Window.partitionBy(F.lit(channel)).orderBy(F.col("score").desc(), "file_id")
    return hits.select("file_id", "score", F.lit(channel).alias("channel"), F.row_number().over(order).alias("rank"))


def fuse(*channels: DataFrame) -> DataFrame:
    """(file_id, fused, hits, raw): weighted reciprocal ranks, more for hits in several channels."""
    rows = reduce(DataFrame.unionByName, channels)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), F.col("channel"))
    out = rows.groupBy("file_id").agg(F.sum(weight / (RANK_K + F.col("rank"))).alias("sum"), F.count("*").alias("hits"), F.max("score").alias("raw"))
    bonus = F.when(F.col("hits") > 1, 1 + (F.col("hits") - 1) * BONUS).otherwise(1.0)
    return out.select("file_id", (F.col("sum") * bonus).alias("fused"), "hits", "raw")


def path_filter(path: Column, prefix: str | None = None, extensions: list[str] | None = None, contains: str | None = None) -> Column:
    tests = [F.lit(True)]
    if prefix:
        tests.append(path.startswith(prefix))
    if extensions:
        tests.append(F.coalesce(C.extension(path).isin([e.lower() for e in extensions]), F.lit(False)))
    if contains:
        tests.append(path.contains(contains))
    return reduce(lambda a, b: a & b, tests)


def metadata_filter(mimes: list[str] | None = None, modified=(None, None), size=(None, None)) -> Column:
    """Ends are included; a row without a file fails."""
    tests = [F.col("size_bytes").isNotNull()]
    if mimes:
        tests.append(F.lower("mime_type").isin([m.lower() for m in mimes]))
    for name, (low, high) in (("modified_at", modified), ("size_bytes", size)):
        tests += ([F.col(name) >= low] if low is not None else []) + ([F.col(name) <= high] if high is not None else [])
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def features(files: DataFrame, query: str, as_of: Column) -> DataFrame:
    """path_score, freshness and quality of files with text, line_start and page_start."""
    return files.withColumn("path_score", C.path_similarity(query, F.col("path"), F.col("filename"))).withColumn("freshness", C.freshness(F.col("modified_at"), as_of)).withColumn("quality", C.extraction_quality(F.col("text"), F.col("line_start"), F.col("page_start"), F.lit(False), F.lit("")))


def hybrid_search(files: DataFrame, vectors: DataFrame | None, query: str, query_vector=None, k: int = 10, as_of: Column | None = None, where: Column | None = None, preset: str = "default") -> DataFrame:
    """Channels, fusion, filters, features and the k best, in one plan.

    Filters act after the channels' cut at max(3 k, 30) hits, as they do in the plan order.
    """
    depth = max(3 * k, 30)
    channels = [ranked(content_search(files, query, depth), "content"), ranked(path_search(files, query, depth), "path")]
    if vectors is not None and query_vector is not None:
        near = nearest(vectors, query_vector, depth).select(F.col("id").alias("file_id"), F.col("similarity").alias("score"))
        channels.append(ranked(near, "vector"))
    fused = fuse(*channels)  # at most three times ``depth`` rows
    found = files.join(F.broadcast(fused), "file_id")
    if where is not None:
        found = found.filter(where)
    found = features(found, query, as_of if as_of is not None else F.current_timestamp())
    best = F.max("fused").over(Window.partitionBy(F.lit(0)))
    lexical = F.when(best <= 1e-4, 0.5).otherwise(F.least(F.greatest(F.try_divide(F.col("fused"), best), F.lit(0.0)), F.lit(1.0)))
    found = found.withColumn("lexical", lexical)
    score = F.round(C.composite(F.col("lexical"), F.col("path_score"), F.col("freshness"), F.col("quality"), preset), 6)
    out = found.select("file_id", "path", F.round("fused", 6).alias("fused"), "hits", score.alias("score"))
    return top(out, k)
