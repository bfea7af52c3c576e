"""Queries of the catalog's operators and of small functions, and the same in DuckDB's SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from quarry.functions import values as V
from quarry.operators import catalog as O
from quarry.operators import embed as E
from quarry.operators.postings import Postings
from quarry.plans.queries import DEPTH, FILES, LINES, MARKDOWN, SNAPSHOTS, TITLE, TOKENS, TREE, WINDOWS, WORDS, _chunks, _docs, _markdown, _tree, change_detection, query

HEADINGS = f"h AS (SELECT file_id, pos, {DEPTH} AS depth, {TITLE} AS title FROM headed WHERE head)"


@query(f"WITH RECURSIVE {FILES}, {LINES}, {WINDOWS} SELECT (SELECT count(*) FROM docs) AS files, (SELECT count(*) FROM chunks) AS chunks")
def catalog_counts(spark, sf_dir):
    return O.counts(_docs(spark, sf_dir), _chunks(spark, sf_dir))


@query(f"""WITH {FILES}, {SNAPSHOTS}, c AS (SELECT CASE WHEN o.content_hash IS NULL THEN 'new' WHEN f.content_hash IS NULL THEN 'deleted' WHEN o.content_hash = f.content_hash THEN 'unchanged' ELSE 'modified' END AS change FROM old o FULL JOIN fresh f USING (path))
SELECT count(*) FILTER (change <> 'deleted') AS scanned, count(*) FILTER (change IN ('new', 'modified')) AS changed, count(*) FILTER (change = 'unchanged') AS unchanged, 0::BIGINT AS denied FROM c""")
def scan_report(spark, sf_dir):
    return O.scan_report(change_detection(spark, sf_dir))


@query(f"WITH {FILES} SELECT file_id, path FROM docs WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)")
def has_vectors(spark, sf_dir):
    model = F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("model_name")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("doc-"), "vec_id").alias("file_id"), model)
    return O.has_vectors(_docs(spark, sf_dir), vectors, "even").select("file_id", "path")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def graph_latest_nodes(spark, sf_dir):
    return O.latest_nodes(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"""WITH {TREE} SELECT source_id || '>' || target_id AS relation_id, CASE WHEN starts_with(source_id, 'region') THEN 'Contains' ELSE 'fresh' END AS relation_type FROM edges""")
def graph_merged_edges(spark, sf_dir):
    edges, _ = _tree(spark, sf_dir)
    edges = edges.select("relation_id", "relation_type")
    return O.merged_edges(edges.filter("relation_id like 'region%'"), edges.withColumn("relation_type", F.lit("fresh")))


@query(f"""WITH {TREE}, o AS (SELECT source_id AS e, count(*) AS n FROM edges GROUP BY e), i AS (SELECT target_id AS e, count(*) AS n FROM edges WHERE source_id <> target_id GROUP BY e)
SELECT entity_id, coalesce(o.n, 0)::BIGINT AS outgoing, coalesce(i.n, 0)::BIGINT AS incoming, (coalesce(o.n, 0) + coalesce(i.n, 0))::BIGINT AS total FROM entities LEFT JOIN o ON o.e = entity_id LEFT JOIN i ON i.e = entity_id""")
def graph_connections(spark, sf_dir):
    return O.connections(*_tree(spark, sf_dir))


@query(f"""WITH {TREE} SELECT 0 AS place, 'digraph G {{' AS line UNION ALL SELECT 3, '}}' UNION ALL SELECT 1, '  "' || entity_id || '" [label="' || name || '"];' FROM entities
UNION ALL SELECT 2, '  "' || source_id || '" -> "' || target_id || '" [label="Contains"];' FROM edges""")
def graph_dot_file(spark, sf_dir):
    edges, entities = _tree(spark, sf_dir)
    return O.dot_graph(entities, edges)


@query(f"""WITH {FILES}, {LINES}, {MARKDOWN}, {HEADINGS} SELECT sha256('Heading#' || file_id || '#' || pos) AS entity_id, title AS name, 'Heading' AS entity_type, file_id, depth::BIGINT AS depth, pos::BIGINT AS ordinal FROM h""")
def heading_entities(spark, sf_dir):
    return O.heading_entities(_markdown(spark, sf_dir))[0].withColumn("depth", F.col("depth").cast("long")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"""WITH {FILES}, {LINES}, {MARKDOWN}, {HEADINGS}, p AS (SELECT a.file_id, a.pos, max(b.pos) AS parent FROM h a LEFT JOIN h b ON a.file_id = b.file_id AND b.pos < a.pos AND b.depth < a.depth GROUP BY ALL)
SELECT CASE WHEN parent IS NULL THEN sha256('Document#' || file_id) ELSE sha256('Heading#' || file_id || '#' || parent) END AS source_id, sha256('Heading#' || file_id || '#' || pos) AS target_id, 'Contains' AS relation_type FROM p""")
def heading_relations(spark, sf_dir):
    return O.heading_entities(_markdown(spark, sf_dir))[1]


@query(f"""WITH {FILES}, {LINES}, {MARKDOWN}, {HEADINGS}, o AS (SELECT file_id, list(title ORDER BY pos) AS t FROM h GROUP BY file_id) SELECT docs.file_id, array_to_string(coalesce(t, []), '|') AS outline FROM docs LEFT JOIN o USING (file_id)""")
def inspect_outline(spark, sf_dir):
    entities, _ = O.heading_entities(_markdown(spark, sf_dir))
    files = _docs(spark, sf_dir).select("file_id", F.lit("text/markdown").alias("mime_type"))
    found = O.outline(files, entities.select("file_id", "name", "entity_type", F.lit(None).cast("string").alias("sheet"), "ordinal"))
    return found.select("file_id", F.array_join("outline", "|").alias("outline"))


NAMES = ["a.md", "b.json", "c.pdf", "d.xlsx", "e.docx", "f.txt", "g.rs"]


@query(f"WITH {FILES} SELECT sha256('Document#' || file_id) AS entity_id, split_part('{' '.join(NAMES)}', ' ', (doc_id % 7)::INT + 1) AS name, 'Document' AS entity_type, file_id FROM docs WHERE doc_id % 7 < 5")
def document_entities(spark, sf_dir):
    from quarry.functions import core as C

    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") % 7 + 1).cast("int"))
    files = _docs(spark, sf_dir).withColumn("filename", name).withColumn("mime_type", C.mime_type(C.extension(name)))
    return O.document_entities(files)


@query(f"WITH {FILES} SELECT file_id, length(text)::BIGINT AS score, (row_number() OVER (ORDER BY length(text) DESC, file_id) - 1)::BIGINT AS ordinal FROM docs WHERE doc_id < 50")
def result_ordinals(spark, sf_dir):
    rows = _docs(spark, sf_dir).filter("doc_id < 50").select("file_id", F.char_length("text").cast("long").alias("score"))
    return O.numbered(rows).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"WITH {FILES} SELECT file_id, left(text, 150) AS preview, greatest(size_bytes - doc_id, 0) AS n_bytes, greatest(size_bytes - 2 * doc_id + 1, 0) AS n_lines, size_bytes <= doc_id AS empty FROM docs")
def previews_and_lengths(spark, sf_dir):
    low, high = F.col("doc_id"), F.col("size_bytes")
    return _docs(spark, sf_dir).select("file_id", V.preview(F.col("text")).alias("preview"), V.range_length(low, high).alias("n_bytes"), V.range_length(2 * low, high, True).alias("n_lines"), V.range_empty(low, high).alias("empty"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END AS props, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS written, true AS same FROM events")
def json_and_times(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    written = V.rfc3339(F.col("ts"))
    return rows.select("event_id", V.json_or_empty(broken).alias("props"), written.alias("written"), (V.from_rfc3339(written) == F.col("ts")).alias("same"))


@query(f"""WITH {FILES}, ids AS (SELECT file_id, doc_id, md5(file_id) AS h FROM docs)
SELECT file_id, CASE WHEN doc_id % 4 <> 3 THEN h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS id, CASE WHEN doc_id % 2 = 0 THEN 'Indexed' ELSE 'Failed: no text' END AS status FROM ids""")
def ids_and_statuses(spark, sf_dir):
    h, n = F.md5("file_id"), F.col("doc_id") % 4
    text = F.when(n == 0, h).when(n == 1, F.upper(h)).when(n == 2, F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")).otherwise(F.concat(h, F.lit("0")))
    odd = F.col("doc_id") % 2 == 1
    status = F.struct(F.when(odd, "Failed").otherwise("Indexed").alias("kind"), F.when(odd, "no text").alias("reason"))
    return _docs(spark, sf_dir).select("file_id", V.parse_id(text).alias("id"), V.status_name(status).alias("status"))


@query("SELECT vec_id, true AS same, 4 * len(embedding) AS n_bytes FROM embeddings")
def vectors_as_bytes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("blob", V.vector_bytes("embedding"))
    return rows.select("vec_id", (V.vector_from_bytes("blob") == F.col("embedding")).alias("same"), F.octet_length("blob").cast("long").alias("n_bytes"))


def _index(spark, sf_dir) -> Postings:
    """The index of a table, built once a session in a folder that all executors see."""
    known = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    at = f"{known.rstrip('/')}/quarry-postings-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    index = Postings(spark, at)
    return index if index.generation() else index.build(_docs(spark, sf_dir))


@query(f"WITH {FILES} SELECT file_id, term, count(*)::BIGINT AS tf FROM (SELECT file_id, unnest({TOKENS}) AS term FROM docs) WHERE term IN ('the', 'der') GROUP BY ALL")
def postings_lookup(spark, sf_dir):
    return _index(spark, sf_dir).lookup(["the", "der"]).select("file_id", "term", "tf")


@query(f"""WITH {FILES}, q AS (SELECT unnest(['{WORDS.replace(" ", "','")}']) AS term),
tf AS (SELECT file_id, term, count(*) AS tf FROM (SELECT file_id, unnest({TOKENS}) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT file_id, round(sum(tf * (ln((SELECT count(*) FROM docs) / (1 + df)) + 1)), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) GROUP BY file_id ORDER BY score DESC, file_id LIMIT 10""")
def lexical_search_indexed(spark, sf_dir):
    return _index(spark, sf_dir).search(WORDS)


@query("")
def hashed_vectors(spark, sf_dir):
    return E.hashed(_docs(spark, sf_dir).select("file_id", F.col("text").alias("content"))).select("file_id", "vector", "dimensions", "model_name")


@query(f"WITH {FILES} SELECT file_id, CASE WHEN modified_at >= TIMESTAMP '2024-01-01 01:00:00' THEN 'later' ELSE 'earlier' END AS when_modified FROM docs WHERE size_bytes <= 2000")
def open_ended_filter(spark, sf_dir):
    keep = O.merge_filters({"max_size": 9, "modified_after": "2024-01-01T01:00:00", "modified_before": "no time", "extensions": []}, {"max_size": 2000})
    assert set(keep) == {"max_size", "modified_after"}
    late = F.col("modified_at") >= F.lit(keep["modified_after"].isoformat()).cast("timestamp")
    rows = _docs(spark, sf_dir).filter(O.between(F.col("size_bytes"), None, keep["max_size"]))
    return rows.select("file_id", F.when(late, "later").otherwise("earlier").alias("when_modified"))
