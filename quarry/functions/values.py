"""Small column functions: MIME tests, ranges, previews, JSON with a fallback, times, ids, vectors as bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: MIME types that tell what a file is.
OFFICE = "application/vnd.openxmlformats-officedocument."
JSON_TYPES = ("application/json", "text/json")


def is_text(mime: Column) -> Column:
    return F.lower(mime).startswith("text/")


def is_markdown(mime: Column) -> Column:
    return F.lower(mime).isin("text/markdown", "text/x-markdown")


def is_json(mime: Column) -> Column:
    return F.lower(mime).isin(*JSON_TYPES)


def is_pdf(mime: Column) -> Column:
    return F.lower(mime) == "application/pdf"


def is_spreadsheet(mime: Column) -> Column:
    return F.lower(mime).isin(f"{OFFICE}spreadsheetml.sheet", "application/vnd.ms-excel")


def is_word_document(mime: Column) -> Column:
    return F.lower(mime).isin(f"{OFFICE}wordprocessingml.document", "application/msword")


def range_length(start: Column, end: Column, inclusive: bool = False) -> Column:
    """Of a range of bytes (end excluded) or lines and pages (``inclusive``); an inverted one has none."""
    return F.greatest(end - start + (1 if inclusive else 0), F.lit(0))


def range_empty(start: Column, end: Column, inclusive: bool = False) -> Column:
    return range_length(start, end, inclusive) == 0


def preview(text: Column, n: int = 150) -> Column:
    """The first ``n`` characters."""
    return F.left(text, F.lit(n))


def json_or_empty(text: Column) -> Column:
    """The text if it is JSON, else ``{}``."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.lit("{}"))


def rfc3339(ts: Column) -> Column:
    """A timestamp as text, in UTC with microseconds."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_rfc3339(text: Column, otherwise: Column | None = None) -> Column:
    """The timestamp of a text; of one that can't be read ``otherwise`` (null by default)."""
    found = F.try_to_timestamp(text)
    return found if otherwise is None else F.coalesce(found, otherwise)


def status_name(status: Column) -> Column:
    """``Failed: reason`` for a failure, else the kind's name."""
    return F.when(status["reason"].isNotNull(), F.concat(status["kind"], F.lit(": "), status["reason"])).otherwise(status["kind"])


def is_id(text: Column) -> Column:
    """Whether a text is a UUID, with hyphens or without."""
    return text.rlike(r"^(?i)(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32})$")


def parse_id(text: Column) -> Column:
    """A UUID in its usual form (lower case, hyphens); null if it is none."""
    bare = F.replace(F.lower(text), F.lit("-"), F.lit(""))
    usual = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5")
    return F.when(is_id(text), usual)


def chunk_locator(byte_start: Column, byte_end: Column, line_start: Column, line_end: Column, page_start: Column, page_end: Column) -> Column:
    """The ranges of a chunk as one value; a range without a start is null."""
    pair = lambda a, b: F.when(a.isNotNull(), F.struct(a.alias("start"), F.coalesce(b, a).alias("end")))
    return F.struct(pair(byte_start, byte_end).alias("bytes"), pair(line_start, line_end).alias("lines"), pair(page_start, page_end).alias("pages"))


@F.pandas_udf(T.BinaryType())
def vector_bytes(vectors: pd.Series) -> pd.Series:
    """array<float> as little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_from_bytes(blobs: pd.Series) -> pd.Series:
    """The floats of such bytes; of a length that isn't a multiple of four, null."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").copy())
