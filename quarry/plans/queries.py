"""One query for each operator on the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import core as C
from quarry.operators import access as A
from quarry.operators import chunkers as K
from quarry.operators import search as S
from quarry.operators import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORDS, PATH_QUERY, NAME = "the thing with and", "doc_1", "src1"
AS_OF = "2024-02-01 00:00:00"

FILES = r"""
docs AS (SELECT 'doc-' || doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt' AS filename,
  'txt' AS extension, 'text/plain' AS mime_type, doc_id, text, strlen(text)::BIGINT AS size_bytes, sha256(text) AS content_hash,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS modified_at FROM documents)"""
SPLIT = r"""string_split(text, chr(10))"""
LINES = rf"""
alllines AS (SELECT file_id, unnest({SPLIT}) AS line, generate_subscripts({SPLIT}, 1) - 1 AS pos, len({SPLIT}) AS n FROM docs),
lines AS (SELECT file_id, pos, line FROM (SELECT file_id, pos, n, regexp_replace(line, '\r$', '') AS line FROM alllines) WHERE NOT (pos = n - 1 AND line = ''))"""
WINDOWS = """
sized AS (SELECT file_id, pos + 1 AS line, strlen(line) + 1 AS n, count(*) OVER (PARTITION BY file_id) AS total FROM lines),
walk AS (
  SELECT file_id, 0::BIGINT AS line, 1::BIGINT AS start, 0::BIGINT AS held, NULL::BIGINT AS s, 0::BIGINT AS last_n FROM (SELECT DISTINCT file_id FROM sized)
  UNION ALL
  SELECT w.file_id, z.line, CASE WHEN w.held + z.n >= 1200 OR z.line = z.total THEN z.line - least(2, z.line - w.start + 1) + 1 ELSE w.start END,
    CASE WHEN w.held + z.n >= 1200 OR z.line = z.total THEN z.n + CASE WHEN z.line > w.start THEN w.last_n ELSE 0 END ELSE w.held + z.n END,
    CASE WHEN w.held + z.n >= 1200 OR z.line = z.total THEN w.start END, z.n
  FROM walk w JOIN sized z ON z.file_id = w.file_id AND z.line = w.line + 1),
cuts AS (SELECT file_id, s AS line_start, line AS line_end, row_number() OVER (PARTITION BY file_id ORDER BY line) - 1 AS chunk_index FROM walk WHERE s IS NOT NULL),
chunks AS (SELECT c.file_id, chunk_index, line_start, line_end, string_agg(l.line, chr(10) ORDER BY pos) AS content
  FROM cuts c JOIN lines l ON l.file_id = c.file_id AND l.pos + 1 BETWEEN line_start AND line_end GROUP BY ALL)"""
TOKENS = r"""list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_-]+'), lambda x: strlen(x) > 1), lambda x: lower(x))"""
SEARCH = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
INDEX = f"""
idx AS (SELECT file_id, {SEARCH.format("filename")} AS f, {SEARCH.format("path")} AS p, {SEARCH.format("text")} AS c FROM docs)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.files_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {FILES} SELECT file_id, path, filename, extension, mime_type, size_bytes, content_hash, epoch(modified_at)::BIGINT AS modified FROM docs")
def catalog_files(spark, sf_dir):
    return _docs(spark, sf_dir).select("file_id", "path", "filename", "extension", "mime_type", "size_bytes", "content_hash", F.unix_seconds("modified_at").alias("modified"))


@query(f"WITH {FILES} SELECT file_id, path FROM docs ORDER BY modified_at DESC, file_id LIMIT 20 OFFSET 10")
def catalog_list_page(spark, sf_dir):
    return _docs(spark, sf_dir).orderBy(F.col("modified_at").desc(), "file_id").offset(10).limit(20).select("file_id", "path")


@query(f"WITH {FILES} SELECT file_id, path FROM docs WHERE starts_with(path, 'src1') AND extension = 'txt' AND contains(path, '/en/')")
def path_filter(spark, sf_dir):
    return _docs(spark, sf_dir).filter(S.path_filter(F.col("path"), "src1", ["TXT", "md"], "/en/")).select("file_id", "path")


@query(f"WITH {FILES} SELECT file_id, size_bytes FROM docs WHERE mime_type = 'text/plain' AND size_bytes BETWEEN 1000 AND 10000 AND modified_at >= TIMESTAMP '2024-01-01 02:00:00'")
def metadata_filter(spark, sf_dir):
    test = S.metadata_filter(["TEXT/plain"], (F.lit("2024-01-01 02:00:00").cast("timestamp"), None), (1000, 10000))
    return _docs(spark, sf_dir).filter(test).select("file_id", "size_bytes")


@query(r"""SELECT p, (len(list_filter(string_split(lower(p), '/'), lambda x: starts_with(x, '.') AND x NOT IN ('.', '..'))) > 0 OR list_contains(string_split(lower(p), '/'), 'target') OR ends_with(lower(p), 'build') OR contains(p, '/build/')) AS excluded
FROM (SELECT CASE doc_id % 5 WHEN 0 THEN '/w/.x/' WHEN 1 THEN '/w/Target/' WHEN 2 THEN '/w/rebuild' WHEN 3 THEN '/w/build/' ELSE '/w/src/' END || CASE doc_id % 5 WHEN 2 THEN '' ELSE doc_id || '.txt' END AS p FROM documents)""")
def path_exclusion(spark, sf_dir):
    n = F.col("doc_id") % 5
    head = F.when(n == 0, "/w/.x/").when(n == 1, "/w/Target/").when(n == 2, "/w/rebuild").when(n == 3, "/w/build/").otherwise("/w/src/")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(head, F.when(n == 2, "").otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))).alias("p"))
    return rows.select("p", C.excluded(F.col("p")).alias("excluded"))


@query(f"WITH {FILES} SELECT file_id, term, count(*)::BIGINT AS tf FROM (SELECT file_id, unnest({TOKENS}) AS term FROM docs) GROUP BY ALL")
def tokenize_tf(spark, sf_dir):
    return S.term_frequencies(_docs(spark, sf_dir))


@query(f"WITH {FILES} SELECT term, count(DISTINCT file_id)::BIGINT AS df FROM (SELECT file_id, unnest({TOKENS}) AS term FROM docs) GROUP BY ALL")
def doc_freq(spark, sf_dir):
    return S.document_frequencies(_docs(spark, sf_dir))


@query(f"""WITH {FILES}, q AS (SELECT unnest(['{WORDS.replace(" ", "','")}']) AS term),
tf AS (SELECT file_id, term, count(*) AS tf FROM (SELECT file_id, unnest({TOKENS}) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT file_id, round(sum(tf * (ln((SELECT count(*) FROM docs) / (1 + df)) + 1)), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) GROUP BY file_id ORDER BY score DESC, file_id LIMIT 10""")
def lexical_search(spark, sf_dir):
    return S.lexical_search(_docs(spark, sf_dir), WORDS)


VECTORS = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"SELECT id, round(list_cosine_similarity(v, (SELECT v FROM {VECTORS} WHERE id = 7)), 6) AS similarity FROM {VECTORS} ORDER BY similarity DESC, id LIMIT 10")
def knn_cosine(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    one = rows.filter("id = 7").select(F.col("vector").alias("query_vector"))
    return rows.crossJoin(F.broadcast(one)).select("id", F.round(C.cosine(F.col("vector"), F.col("query_vector")), 6).alias("similarity")).orderBy(F.col("similarity").desc(), "id").limit(10)


@query(f"""SELECT * FROM (SELECT q.id AS query_id, d.id, round(list_cosine_similarity(d.v, q.v), 6) AS similarity, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(d.v, q.v), 6) DESC, d.id) AS rank
FROM {VECTORS} d, {VECTORS} q WHERE q.id % 50 = 0) WHERE rank <= 5""")
def knn_batch(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.nearest_batch(rows, rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")))


MARKDOWN = """
marked AS (SELECT file_id, pos, CASE pos % 5 WHEN 1 THEN '# ' || line WHEN 3 THEN '## ' || line ELSE line END AS line FROM lines),
headed AS (SELECT file_id, pos, line, starts_with(trim(line), '#') AS head FROM marked)"""
DEPTH, TITLE = "strlen(regexp_extract(trim(line), '^#+'))", "trim(regexp_replace(trim(line), '^#+', ''))"


def _markdown(spark, sf_dir):
    mark = lambda x, i: F.when(i % 5 == 1, F.concat(F.lit("# "), x)).when(i % 5 == 3, F.concat(F.lit("## "), x)).otherwise(x)
    return _docs(spark, sf_dir).select("file_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))


@query(f"""WITH {FILES}, {LINES}, {MARKDOWN}, s AS (SELECT *, sum(head::INT) OVER (PARTITION BY file_id ORDER BY pos) AS section FROM headed)
SELECT file_id, coalesce(max(CASE WHEN head THEN {TITLE} END), 'Preamble') AS heading, coalesce(max(CASE WHEN head THEN {DEPTH} END), 1)::BIGINT AS depth, min(pos) + 1 AS line_start, max(pos) + 1 AS line_end, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head) AS content
FROM s GROUP BY file_id, section HAVING count(*) FILTER (NOT head) > 0""")
def chunk_markdown_sections(spark, sf_dir):
    return K.markdown_sections(_markdown(spark, sf_dir)).select("file_id", "heading", F.col("depth").cast("long").alias("depth"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "content")


@query(f"""WITH {FILES}, {LINES}, {MARKDOWN}, h AS (SELECT file_id, pos, {DEPTH} AS depth, {TITLE} AS title FROM headed WHERE head)
SELECT a.file_id, a.pos, a.depth::BIGINT AS depth, a.title, max(b.pos) AS parent_pos FROM h a LEFT JOIN h b ON a.file_id = b.file_id AND b.pos < a.pos AND b.depth < a.depth GROUP BY ALL""")
def heading_edges(spark, sf_dir):
    return K.heading_edges(_markdown(spark, sf_dir)).select("file_id", F.col("pos").cast("long").alias("pos"), F.col("depth").cast("long").alias("depth"), "title", F.col("parent_pos").cast("long").alias("parent_pos"))


@query("""WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, props AS c FROM events),
s AS (SELECT *, coalesce(sum(strlen(c) + 1) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start FROM l)
SELECT 'user-' || user_id AS file_id, i AS chunk_index, byte_start, byte_start + strlen(trim(c)) AS byte_end, i + 1 AS line_start, trim(c) AS content, strlen(trim(c)) // 4 AS token_count, sha256(trim(c)) AS content_hash FROM s WHERE trim(c) <> ''""")
def chunk_jsonl(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "props"))).alias("own"))
    files = own.select(F.concat(F.lit("user-"), F.col("user_id")).alias("file_id"), F.array_join("own.props", "\n").alias("text"))
    return K.json_lines(files).select("file_id", F.col("chunk_index").cast("long").alias("chunk_index"), "byte_start", "byte_end", F.col("line_start").cast("long").alias("line_start"), "content", "token_count", "content_hash")


def _chunks(spark, sf_dir):
    return K.text_windows(_docs(spark, sf_dir))


@query(f"WITH RECURSIVE {FILES}, {LINES}, {WINDOWS} SELECT file_id, chunk_index, line_start, line_end, content, strlen(content) // 4 AS token_count FROM chunks")
def chunk_text_windows(spark, sf_dir):
    return _chunks(spark, sf_dir).select("file_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "line_start", "line_end")], "content", "token_count")


@query(f"WITH RECURSIVE {FILES}, {LINES}, {WINDOWS} SELECT file_id, min(line_start) AS line_start, max(line_end) AS line_end, string_agg(content, chr(10) ORDER BY chunk_index) AS content, string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) AS chunks FROM chunks WHERE line_start <= 12 AND line_end >= 5 GROUP BY file_id")
def range_overlap_open(spark, sf_dir):
    out = T.open_range(_chunks(spark, sf_dir), 5, 12)
    return out.withColumn("line_start", F.col("line_start").cast("long")).withColumn("line_end", F.col("line_end").cast("long"))


@query(f"WITH RECURSIVE {FILES}, {LINES}, {WINDOWS} SELECT file_id, filename || ':' || CASE WHEN line_start = line_end THEN 'Line ' || line_start ELSE 'Lines ' || line_start || '-' || line_end END AS locator FROM chunks JOIN docs USING (file_id)")
def evidence_locators(spark, sf_dir):
    rows = _chunks(spark, sf_dir).join(_docs(spark, sf_dir).select("file_id", "filename"), "file_id")
    none = F.lit(None).cast("int")
    return rows.select("file_id", C.locator(F.col("filename"), F.col("line_start"), F.col("line_end"), none, none).alias("locator"))


@query(f"WITH RECURSIVE {FILES}, {LINES}, {WINDOWS} SELECT d.file_id, path, size_bytes, mime_type, count(c.file_id)::BIGINT AS chunk_count, max(line_end)::BIGINT AS line_count, sum(strlen(content) // 4)::BIGINT AS tokens FROM docs d LEFT JOIN chunks c USING (file_id) GROUP BY ALL")
def inspect_profile(spark, sf_dir):
    return T.profile(_docs(spark, sf_dir), _chunks(spark, sf_dir)).withColumn("line_count", F.col("line_count").cast("long"))


def _bm25_sql(f: list[str], n_any: str, limit: int) -> str:
    terms = " + ".join(f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / mean))" for i in range(len(f)))
    return f"""counted AS (SELECT file_id, len(f) + len(p) + len(c) AS d, {", ".join(f"({x})::DOUBLE AS f{i}" for i, x in enumerate(f))} FROM idx),
stats AS (SELECT count(*) AS n, avg(d) AS mean, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(f)))} FROM counted),
hits AS (SELECT file_id, round(greatest({terms}, 0.01), 6) AS score FROM counted, stats WHERE {n_any.join(f"f{i} > 0" for i in range(len(f)))} ORDER BY score DESC, file_id LIMIT {limit})"""


_PREFIX = [" + ".join(f"len(list_filter({c}, lambda x: starts_with(x, '{w}')))" for c in "fpc") for w in ("thing", "with")]
_PHRASE = [f"{w} * len(list_filter(range(len({c}) - 1), lambda i: {c}[i + 1] = 'doc' AND starts_with({c}[i + 2], '1')))" for w, c in ((0.5, "f"), (1, "p"))]
CONTENT_SQL, PATH_SQL = _bm25_sql(_PREFIX, " AND ", 30), _bm25_sql(_PHRASE, " OR ", 30)


@query(f"WITH {FILES}, {INDEX}, {CONTENT_SQL} SELECT * FROM hits")
def bm25_content(spark, sf_dir):
    return S.content_search(_docs(spark, sf_dir), "thing with")


@query(f"WITH {FILES}, {INDEX}, {PATH_SQL} SELECT * FROM hits")
def bm25_path(spark, sf_dir):
    return S.path_search(_docs(spark, sf_dir), PATH_QUERY)


_TWO = f"""c AS (WITH {INDEX}, {CONTENT_SQL} SELECT * FROM hits), p AS (WITH {INDEX}, {PATH_SQL} SELECT * FROM hits),
r AS (SELECT file_id, score, 1.0 AS w, row_number() OVER (ORDER BY score DESC, file_id) AS rank FROM c UNION ALL SELECT file_id, score, 1.8, row_number() OVER (ORDER BY score DESC, file_id) FROM p),
fused AS (SELECT file_id, sum(w::DOUBLE / (20 + rank)) * CASE WHEN count(*) > 1 THEN 1 + (count(*) - 1) * 0.35::DOUBLE ELSE 1 END AS fused, count(*)::BIGINT AS hits, max(score) AS raw FROM r GROUP BY file_id)"""


@query(f"WITH {FILES}, {_TWO} SELECT file_id, round(fused, 6) AS fused, hits, raw FROM fused")
def rrf_fusion(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    out = S.fuse(S.ranked(S.content_search(docs, "thing with"), "content"), S.ranked(S.path_search(docs, PATH_QUERY), "path"))
    return out.withColumn("fused", F.round("fused", 6))


_FEATURES = r"""CASE WHEN contains(regexp_replace(filename, '\.[^.]*$', ''), 'doc_1') THEN greatest(0.95 / 1.1, 0.6) ELSE (contains(path, 'doc_1')::INT + contains(path, 'src1')::INT) / 2.0 / 1.1 END AS path_score,
greatest(least(exp(-greatest(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(modified_at), 0) / 86400.0 / 30.0), 1.0), 0.05) AS freshness,
greatest(least(CASE WHEN size_bytes BETWEEN 150 AND 2500 THEN 0.55 WHEN size_bytes BETWEEN 40 AND 149 THEN 0.45 WHEN size_bytes > 2500 THEN 0.5 ELSE 0.3 END
 + CASE WHEN length(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')) / greatest(size_bytes, 1) > 0.8 THEN 0.2 ELSE 0.1 END, 1.0), 0.1)::DOUBLE AS quality"""


@query(f"WITH {FILES} SELECT file_id, round(path_score, 6) AS path_score, round(freshness, 6) AS freshness, round(quality, 6) AS quality FROM (SELECT file_id, {_FEATURES} FROM docs)")
def rerank_features(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("line_start", F.lit(1)).withColumn("page_start", F.lit(None).cast("int"))
    out = S.features(rows, "doc_1 src1", F.lit(AS_OF).cast("timestamp"))
    return out.select("file_id", *[F.round(c, 6).alias(c) for c in ("path_score", "freshness", "quality")])


_HYBRID = [" + ".join(f"len(list_filter(range(len({c}) - 1), lambda i: {c}[i + 1] = 'doc' AND starts_with({c}[i + 2], '1')))" for c in "fpc")]


@query(f"""WITH {FILES}, c AS (WITH {INDEX}, {_bm25_sql(_HYBRID, " AND ", 30)} SELECT * FROM hits), p AS (WITH {INDEX}, {PATH_SQL} SELECT * FROM hits),
r AS (SELECT file_id, score, 1.0 AS w, row_number() OVER (ORDER BY score DESC, file_id) AS rank FROM c UNION ALL SELECT file_id, score, 1.8, row_number() OVER (ORDER BY score DESC, file_id) FROM p),
fused AS (SELECT file_id, sum(w::DOUBLE / (20 + rank)) * CASE WHEN count(*) > 1 THEN 1 + (count(*) - 1) * 0.35::DOUBLE ELSE 1 END AS fused, count(*)::BIGINT AS hits FROM r GROUP BY file_id),
x AS (SELECT file_id, path, fused, hits, {_FEATURES.replace("(contains(path, 'doc_1')::INT + contains(path, 'src1')::INT) / 2.0", "contains(path, 'doc_1')::INT")} FROM docs JOIN fused USING (file_id) WHERE contains(path, '/en/'))
SELECT file_id, path, round(fused, 6) AS fused, hits, round(0.45 * fused / max(fused) OVER () + 0.25 * path_score + 0.15 * freshness + 0.15 * quality, 6) AS score FROM x ORDER BY score DESC, file_id LIMIT 10""")
def hybrid_search(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("line_start", F.lit(1)).withColumn("page_start", F.lit(None).cast("int"))
    return S.hybrid_search(rows, None, PATH_QUERY, as_of=F.lit(AS_OF).cast("timestamp"), where=F.col("path").contains("/en/"))


TREE = """
entities AS (SELECT 'region-' || r_regionkey AS entity_id, r_name AS name FROM region UNION ALL SELECT 'nation-' || n_nationkey, n_name FROM nation UNION ALL SELECT 'customer-' || c_custkey, c_name FROM customer),
edges AS (SELECT 'region-' || n_regionkey AS source_id, 'nation-' || n_nationkey AS target_id FROM nation UNION ALL SELECT 'nation-' || c_nationkey, 'customer-' || c_custkey FROM customer)"""


def _tree(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    node = lambda t, kind, key, name: read(t).select(F.concat(F.lit(f"{kind}-"), F.col(key)).alias("entity_id"), F.col(name).alias("name"))
    entities = node("region", "region", "r_regionkey", "r_name").unionByName(node("nation", "nation", "n_nationkey", "n_name")).unionByName(node("customer", "customer", "c_custkey", "c_name"))
    edge = lambda t, a, x, b, y: read(t).select(F.concat(F.lit(f"{a}-"), F.col(x)).alias("source_id"), F.concat(F.lit(f"{b}-"), F.col(y)).alias("target_id"), F.lit("Contains").alias("relation_type"))
    edges = edge("nation", "region", "n_regionkey", "nation", "n_nationkey").unionByName(edge("customer", "nation", "c_nationkey", "customer", "c_custkey"))
    return edges.withColumn("relation_id", F.concat_ws(">", "source_id", "target_id")), entities


@query(f"""WITH {TREE} SELECT CASE WHEN source_id = 'nation-3' THEN 'outgoing' ELSE 'incoming' END AS direction, source_id || '>' || target_id AS relation_id, o.entity_id AS other_id, o.name AS other_name
FROM edges LEFT JOIN entities o ON o.entity_id = CASE WHEN source_id = 'nation-3' THEN target_id ELSE source_id END WHERE source_id = 'nation-3' OR target_id = 'nation-3'""")
def related_one_hop(spark, sf_dir):
    edges, entities = _tree(spark, sf_dir)
    return T.related(edges, entities, "nation-3", "contains").select("direction", "relation_id", "other_id", "other_name")


@query(f"""WITH RECURSIVE {TREE}, walk AS (SELECT 'region-1' AS entity_id, 0 AS depth UNION SELECT target_id, depth + 1 FROM walk JOIN edges ON source_id = entity_id WHERE depth < 2)
SELECT entity_id, min(depth)::BIGINT AS depth FROM walk SEMI JOIN entities USING (entity_id) GROUP BY entity_id""")
def graph_bfs(spark, sf_dir):
    edges, entities = _tree(spark, sf_dir)
    return T.neighbourhood(edges, entities, "region-1", 2).withColumn("depth", F.col("depth").cast("long"))


@query(f"""WITH {TREE} SELECT '  "' || source_id || '" -> "' || target_id || '" [label="Contains"];' AS line FROM edges""")
def graph_dot(spark, sf_dir):
    return T.to_dot(_tree(spark, sf_dir)[0])


SNAPSHOTS = "old AS (SELECT path, content_hash FROM docs WHERE doc_id % 10 <> 0), fresh AS (SELECT path, CASE WHEN doc_id % 5 = 1 THEN sha256(text || '!') ELSE content_hash END AS content_hash FROM docs WHERE doc_id % 7 <> 0)"


@query(f"WITH {FILES}, {SNAPSHOTS} SELECT path, CASE WHEN o.content_hash IS NULL THEN 'new' WHEN f.content_hash IS NULL THEN 'deleted' WHEN o.content_hash = f.content_hash THEN 'unchanged' ELSE 'modified' END AS change FROM old o FULL JOIN fresh f USING (path)")
def change_detection(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    fresh = docs.filter("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 == 1, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return T.changes(docs.filter("doc_id % 10 <> 0").select("path", "content_hash"), fresh)


@query(f"WITH {FILES} SELECT file_id, CASE WHEN doc_id % 3 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS created_at FROM docs WHERE doc_id % 10 <> 0 OR doc_id % 3 = 0")
def upsert_merge(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    old = docs.filter("doc_id % 10 <> 0").select("file_id", "size_bytes", F.lit(1).cast("long").alias("created_at"))
    new = docs.filter("doc_id % 3 = 0").select("file_id", (F.col("size_bytes") + 1).alias("size_bytes"), F.lit(2).cast("long").alias("created_at"))
    return T.upsert(old, new, "file_id")


@query(f"WITH RECURSIVE {FILES}, {LINES}, {WINDOWS} SELECT file_id, chunk_index FROM chunks JOIN docs USING (file_id) WHERE doc_id % 4 <> 0")
def cascade_delete(spark, sf_dir):
    gone = _docs(spark, sf_dir).filter("doc_id % 4 = 0")
    return T.without_files(_chunks(spark, sf_dir), gone).select("file_id", F.col("chunk_index").cast("long").alias("chunk_index"))


@query("SELECT event_id, user_id, event_type, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 10")
def events_recent(spark, sf_dir):
    return T.recent(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id").select("event_id", "user_id", "event_type", F.col("place").cast("long").alias("place"))


@query("""SELECT event_id, user_id, event_type, CASE WHEN was IS NULL THEN 'created' ELSE 'modified' END AS change
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type""")
def change_feed_dedup(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return T.change_feed(rows, "user_id", F.col("event_type"), ("ts", "event_id")).select("event_id", "user_id", "event_type", "change")


@query(f"""WITH {TREE} SELECT entity_id, name FROM entities WHERE contains(lower(name), 'tion_1') ORDER BY name, entity_id LIMIT 20""")
def entity_name_search(spark, sf_dir):
    return A.entities_named(_tree(spark, sf_dir)[1], "Tion_1").select("entity_id", "name")


@query(f"""WITH RECURSIVE {FILES}, {LINES}, {WINDOWS}, hit AS (SELECT *, line_start <= 60 AND line_end >= 40 AS touched FROM chunks),
best AS (SELECT *, bool_or(touched) OVER (PARTITION BY file_id) AS found FROM hit)
SELECT file_id, CASE WHEN found THEN 'lines' ELSE 'chunk' END AS how, string_agg(content, chr(10) ORDER BY chunk_index) AS content FROM best WHERE CASE WHEN found THEN touched ELSE chunk_index = 0 END GROUP BY file_id, found""")
def open_precedence(spark, sf_dir):
    none = F.lit(None).cast("int")
    rows = _chunks(spark, sf_dir).withColumn("page_start", none).withColumn("page_end", none)
    return A.open_at(rows, pages=(1, 2), lines=(40, 60)).select("file_id", "how", "content")
