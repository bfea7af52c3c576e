"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A paragraph is a line, a section eight paragraphs. A paragraph's hash is the SHA-256 of its
text, a section's the SHA-256 of its paragraphs' hashes, the root that of all sections'. Equal
texts have equal roots; ``edits`` walks from differing sections to the differing paragraphs.
Below the paragraphs, every four words with the space that follows them are a leaf with a
20-bit code. A fingerprint is the root and the codes; the likeness of two is the share of the
larger one's distinct codes that both hold, and 1 exactly where the roots are equal.

The next document by descending id is found inside ranges of ids of about equal text
size (one exchange of the texts); only each range's first document crosses ranges.

Defined cases: null texts are empty; rows with one id follow each other by descending text;
null ids come last; extra columns are ignored; a single document follows itself; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, groups_for

SECTION, LEAF_WORDS, BUCKET_BYTES, MOST_BUCKETS = 8, 4, 12 << 20, 4096


def paragraph_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))


def section_hashes(paragraphs: Column) -> Column:
    """From an array of paragraph hashes to one of section hashes."""
    starts = F.sequence(F.lit(1), F.size(paragraphs), F.lit(SECTION))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(paragraphs, i, SECTION), ""), 256))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ""), 256)


def leaves(text: Column) -> Column:
    """Codes (int) of the leaves; paragraph ends also end leaves."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?:[^\s]+[^\S\n]*){{1,{LEAF_WORDS}}}|\s+"), F.lit(0))
    return F.transform(pieces, lambda x: F.xxhash64(x).bitwiseAND(F.lit(0xFFFFF)).cast("int"))


def fingerprint(root_hash: Column, codes: Column) -> Column:
    return F.concat(root_hash, F.lit(":"), F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 5, "0"))), ""))


def likeness(root_a: Column, codes_a: Column, root_b: Column, codes_b: Column) -> Column:
    larger = F.greatest(F.size(F.array_distinct(codes_a)), F.size(F.array_distinct(codes_b)))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(codes_a, codes_b)), larger), F.lit(0.0))
    return F.when(root_a == root_b, 1.0).otherwise(F.least(share, F.lit(0.999999)))


def edits(a: Column, b: Column) -> Column:
    """Where two texts differ: array of (section, paragraph), both from 0, of either text.

    Sections with equal hashes are passed over without a look at their paragraphs.
    """
    pa, pb = paragraph_hashes(F.coalesce(a, F.lit(""))), paragraph_hashes(F.coalesce(b, F.lit("")))
    sa, sb = section_hashes(pa), section_hashes(pb)
    numbers = F.sequence(F.lit(0), F.greatest(F.size(sa), F.size(sb)) - 1)
    differ = F.filter(numbers, lambda s: ~F.get(sa, s).eqNullSafe(F.get(sb, s)))
    inner = F.sequence(F.lit(0), F.lit(SECTION - 1))
    return F.flatten(F.transform(differ, lambda s: F.transform(F.filter(inner, lambda p: ~F.get(pa, s * SECTION + p).eqNullSafe(F.get(pb, s * SECTION + p))), lambda p: F.struct(s.alias("section"), p.alias("paragraph")))))


def with_fingerprint(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>root`` and ``<prefix>codes`` of a text column."""
    rows = rows.withColumn(f"{prefix}codes", leaves(F.col(text))).withColumn("_p", paragraph_hashes(F.col(text)))
    return rows.withColumn(f"{prefix}root", root(section_hashes(F.col("_p")))).drop("_p")


def _cuts(docs: DataFrame, bucket_bytes: int) -> list[int]:
    points = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    found = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("doc_id", points, 20_000).alias("cuts")).first()
    n = min(MOST_BUCKETS, groups_for(found["bytes"] or 0, bucket_bytes))
    cuts = found["cuts"] or []
    return sorted({cuts[i * MOST_BUCKETS // n - 1] for i in range(1, n)}) if cuts else []


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, root, codes, next_text, next_root, next_codes) of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = _cuts(docs, bucket_bytes)
    # ids up to a cut are in its bucket or a lower one
    number = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    docs = docs.withColumn("bucket", F.coalesce(number, F.lit(0)))
    n = len(cuts) + 1
    dealt = with_fingerprint(docs.repartition(n, "bucket"), "text", "")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc(), F.col("text").desc())
    after = lambda c: F.lead(c).over(order).alias(f"next_{c}")
    rows = dealt.select("bucket", "doc_id", "text", "root", "codes", after("text"), after("root"), after("codes"))
    # the first document of each bucket, one row a bucket; there are at most MOST_BUCKETS
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    first = docs.join(F.broadcast(tops), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.max("text").alias("head_text"))
    down = Window.orderBy(F.col("bucket").desc())
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = first.select("bucket", F.coalesce(F.lead("head_text").over(down), F.first("head_text").over(whole)).alias("head_text"))
    rows = rows.join(heads, "bucket", "left")
    last = F.col("next_text").isNull()
    text = F.when(last, F.col("head_text")).otherwise(F.col("next_text"))
    codes = F.when(last, leaves(F.col("head_text"))).otherwise(F.col("next_codes"))
    top = F.when(last, root(section_hashes(paragraph_hashes(F.col("head_text"))))).otherwise(F.col("next_root"))
    return rows.select("doc_id", "text", "root", "codes", text.alias("next_text"), top.alias("next_root"), codes.alias("next_codes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(documents(spark, sf_dir))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("left(text, n_chars - floor(n_chars / 2))"), F.left(F.col("next_text"), half)))
    rows = with_fingerprint(rows, "edited", "edited_")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("root"), F.col("codes")).alias("fingerprint"), fingerprint(F.col("edited_root"), F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("codes"), F.col("edited_root"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("root"), F.col("codes"), F.col("next_root"), F.col("next_codes")).alias("near_next"),
    )


QUERIES = {"op4_merkle_fingerprints": query}
ORACLES: dict[str, str] = {}
