"""Column functions: paths, MIME types, tokens, vectors, scores, locators. All are built-ins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MIME type by extension.
MIME = {
    "rs": "application/x-rust", "py": "application/x-python", "js": "application/javascript", "ts": "application/typescript",
    "tsx": "text/jsx", "jsx": "text/jsx", "html": "text/html", "htm": "text/html", "css": "text/css", "json": "application/json",
    "toml": "text/x-toml", "yaml": "text/yaml", "yml": "text/yaml", "md": "text/markdown", "markdown": "text/markdown",
    "txt": "text/plain", "log": "text/plain", "csv": "text/csv", "pdf": "application/pdf",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "svg": "image/svg+xml",
}
#: Path patterns that a scan leaves out.
IGNORED = ("node_modules", ".git", ".svn", ".hg", "target", ".venv", "venv", "dist", "build", "__pycache__", ".DS_Store", "Thumbs.db", "desktop.ini", ".idea", ".vscode", ".vcf", ".vfc", ".ics")
NOT_TOKEN = r"[^\p{IsAlphabetic}\p{N}_\-]+"


def clean_path(path: Column) -> Column:
    return F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def filename(path: Column) -> Column:
    return F.substring_index(clean_path(path), "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased; null without one. A name's leading dot begins no extension."""
    return F.nullif(F.lower(F.regexp_extract(filename(path), r"^.+\.([^.]*)$", 1)), F.lit(""))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def mime_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit("application/octet-stream"))


def excluded(path: Column, custom: tuple[str, ...] = (), ignore_hidden: bool = True) -> Column:
    """Whether a scan leaves a path out: hidden parts, a pattern as a part, as an end, or as /part/."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    parts, low = F.split(F.lower(path), "/"), F.lower(path)
    tests = [F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", ".."))] if ignore_hidden else []
    for p in dict.fromkeys([*IGNORED, *(c.strip() for c in custom if c.strip())]):
        p = p.strip("*").strip("/").replace("\\", "/").lower()
        tests += [F.array_contains(parts, p), low.endswith(p), low.contains(f"/{p}/")]
    return reduce(lambda a, b: a | b, tests)


def tokens(text: Column) -> Column:
    """Lexical tokens: runs of letters, digits, _ and - of over one byte, then lower-cased."""
    return F.transform(F.filter(F.split(text, NOT_TOKEN), lambda t: F.octet_length(t) > 1), F.lower)


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w\-]+", query.lower()) if len(t.encode()) > 1]


def search_tokens(text: Column) -> Column:
    """Full-text tokens, not stemmed: runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def phrases(query: str) -> list[list[str]]:
    """A query's AND-ed phrases: each token's letter and digit runs; the last is a prefix."""
    found = [[p for p in re.split(r"[\W_]+", t.lower()) if p] for t in re.split(r"[^\w\-]+", query)]
    return [p for p in found if p]


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in a token array; its last word is a prefix."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda t: t.startswith(phrase[0])))
    # no lambda reads ``words``: where the optimizer puts the split in its place, it would be split for each element
    rows = F.arrays_zip(*[F.slice(words, j + 1, F.size(words)).alias(f"w{j}") for j in range(len(phrase))])
    last = len(phrase) - 1
    hit = lambda x: reduce(lambda a, b: a & b, [x[f"w{j}"] == p for j, p in enumerate(phrase[:-1])]) & x[f"w{last}"].startswith(phrase[-1])
    return F.coalesce(F.size(F.filter(rows, hit)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(F.try_divide(total(a, b), norm), F.lit(0.0))).otherwise(0.0)


def locator(name: Column, line_start: Column, line_end: Column, page_start: Column, page_end: Column) -> Column:
    lines = F.concat(F.lit(" (Lines "), line_start, F.lit("-"), line_end, F.lit(")"))
    page = F.when(page_start == page_end, F.concat(F.lit("Page "), page_start)).otherwise(F.concat(F.lit("Pages "), page_start, F.lit("-"), page_end))
    line = F.when(line_start == line_end, F.concat(F.lit("Line "), line_start)).otherwise(F.concat(F.lit("Lines "), line_start, F.lit("-"), line_end))
    text = F.when(page_start.isNotNull() & line_start.isNotNull(), F.concat(page, lines)).when(page_start.isNotNull(), page).when(line_start.isNotNull(), line).otherwise(F.lit("Document"))
    return F.concat(name, F.lit(":"), text)


def path_similarity(query: str, path: Column, name: Column) -> Column:
    words = query_tokens(query)
    if not words:
        return F.lit(0.5)
    path, base = F.lower(clean_path(path)), stem(F.lower(name))
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    factor = 1 / (1 + F.lit(0.05) * depth)
    in_stem = reduce(lambda a, b: a | b, [base.contains(w) for w in words])
    share = sum((path.contains(w).cast("double") for w in words), F.lit(0.0)) / len(words)
    return F.when(in_stem, F.least(F.greatest(0.95 * factor, F.lit(0.6)), F.lit(1.0))).otherwise(share * factor)


def freshness(modified: Column, as_of: Column) -> Column:
    days = F.greatest(F.unix_seconds(as_of) - F.unix_seconds(modified), F.lit(0)) / 86400.0
    return F.when(modified.isNull(), 0.70).otherwise(F.greatest(F.least(F.exp(-days / 30.0), F.lit(1.0)), F.lit(0.05)))


def extraction_quality(content: Column, line_start: Column, page_start: Column, is_section: Column, snippet: Column) -> Column:
    n = F.octet_length(content)
    size = F.when(n.between(150, 2500), 0.30).when(n.between(40, 149), 0.20).when(n > 2500, 0.25).otherwise(0.05)
    readable = F.length(F.regexp_replace(content, r"[^\p{IsAlphabetic}\p{N}\s]", "")) / F.greatest(n, F.lit(1))
    score = F.when(line_start.isNotNull(), 0.25).otherwise(0.0) + F.when(page_start.isNotNull() | is_section, 0.25).otherwise(0.0) + size + F.when(readable > 0.8, 0.20).otherwise(0.10)
    return F.when(content.isNotNull(), F.greatest(F.least(score, F.lit(1.0)), F.lit(0.1))).otherwise(F.when(F.octet_length(snippet) > 60, 0.60).otherwise(0.30))


#: Weights of lexical score, path, freshness and quality.
PRESETS = {"default": (0.45, 0.25, 0.15, 0.15), "lexical": (0.70, 0.15, 0.05, 0.10), "code": (0.40, 0.35, 0.10, 0.15)}


def composite(lexical: Column, path: Column, fresh: Column, quality: Column, preset: str = "default") -> Column:
    a, b, c, d = PRESETS[preset]
    return a * lexical + b * path + c * fresh + d * quality
