"""Table schemas of the catalog."""

from pyspark.sql import types as T

_s, _l, _i, _ts, _d = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.DoubleType()


def _table(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


STATUS = _table(("kind", _s), ("reason", _s))
CHUNK_TYPE = _table(("kind", _s), ("heading", _s), ("depth", _i), ("page", _i), ("total_pages", _i), ("sheet", _s), ("row_start", _i), ("row_end", _i), ("language", _s))
FILES = _table(("file_id", _s), ("path", _s), ("filename", _s), ("extension", _s), ("mime_type", _s), ("size_bytes", _l), ("content_hash", _s), ("status", STATUS), ("created_at", _ts), ("modified_at", _ts), ("indexed_at", _ts), ("file_index", _l), ("device_id", _l))
CHUNKS = _table(("chunk_id", _s), ("file_id", _s), ("chunk_index", _i), ("chunk_type", CHUNK_TYPE), ("byte_start", _l), ("byte_end", _l), ("line_start", _i), ("line_end", _i), ("page_start", _i), ("page_end", _i), ("content", _s), ("token_count", _l), ("content_hash", _s))
EMBEDDINGS = _table(("embedding_id", _s), ("file_id", _s), ("chunk_id", _s), ("model_name", _s), ("dimensions", _i), ("vector", T.ArrayType(T.FloatType())), ("created_at", _ts))
ENTITIES = _table(("entity_id", _s), ("name", _s), ("entity_type", _s), ("file_id", _s), ("chunk_id", _s), ("properties", _s), ("ordinal", _i), ("created_at", _ts))
RELATIONSHIPS = _table(("relation_id", _s), ("source_id", _s), ("target_id", _s), ("relation_type", _s), ("weight", _d), ("properties", _s), ("created_at", _ts))
FILE_EVENTS = _table(("event_id", _s), ("file_id", _s), ("event_type", _s), ("ts", _ts), ("source", _s), ("metadata", _s))
CHANGES = _table(("path", _s), ("op", _s), ("content_hash", _s), ("ts", _ts))
TABLES = {"files": FILES, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "entities": ENTITIES, "relationships": RELATIONSHIPS, "file_events": FILE_EVENTS}


def initialize(spark) -> dict:
    """Empty tables by name."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
