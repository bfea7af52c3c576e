"""BPE encoding and decoding by tree concatenation.

A text longer than ``leaf_chars`` is cut into pieces without regard to words. The pieces are
encoded on their own (those of a text longer than ``spread_chars`` in different tasks) and
joined as a tree: around each join a window is encoded anew, and grows until on both sides a
whole word stands at the same place with the same ids in the window and in the half. What lies
between comes from the window, the rest from the halves. A window that has grown over both
halves is their exact encoding itself.

This needs a tokenizer whose words never hold ASCII white space and that drops it, as
``word_bpe_49k.json`` does; then a word's ids depend on nothing beyond the white space around it.

Defined cases: null texts are empty (no ids, decoded ""); special tokens written in a text are
read as the library reads them; repeated rows stay; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, scratch, slices

LEAF_CHARS, SPREAD_CHARS, FIRST_WINDOW = 16_384, 1 << 20, 64
_WORD = re.compile(r"[^ \t-\r]+")
_PLAIN = re.compile(r"[!-;=-{}~À-ÖØ-öø-ÿ]+").fullmatch
#: Ids that one step of decoding takes; those of a longer text are taken alone.
STEP_IDS = 1 << 22


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Coder:
    """Ids of words, kept for the words met so far; when over ``most`` are held, for those met at that time.

    Plain words are encoded many in one text, with a special token between them, at which the
    library cuts a text before all else. Words that may hold or make a part of such a token, or
    whose characters are not all ASCII or Latin letters, are encoded one by one.
    """

    def __init__(self, path: str, most: int = 200_000, together: int = 256):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        of = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            of[i] = name
        self.names = pa.array(of, pa.string())
        between = [(i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if not (t.normalized or t.single_word or t.lstrip or t.rstrip) and "<" in t.content]
        self.between = between[-1] if between else None
        self.known: dict[str, bytes] = {}
        self.most, self.together = most, together

    def learn(self, words) -> None:
        words = words if isinstance(words, set) else set(words)
        if len(self.known) > self.most:  # those met now stay
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in self.known]
        plain = [w for w in new if _PLAIN(w)] if self.between else []
        if plain:
            number, mark = self.between
            groups = [plain[at : at + self.together] for at in range(0, len(plain), self.together)]
            for own, e in zip(groups, self._encoded([mark.join(g) for g in groups]), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == number) * 4
                raw = ids.tobytes()
                for word, a, b in zip(own, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True):
                    self.known[word] = raw[a:b]
            new = [w for w in new if not _PLAIN(w)]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for word, e in zip(part, self._encoded(part), strict=True):
                self.known[word] = np.array(e.ids, "<u4").tobytes()

    def _encoded(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def of(self, word: str) -> bytes:
        if word not in self.known:
            self.learn([word])
        return self.known[word]

    def piece(self, text: str, at: int = 0) -> tuple[list[int], list[str]]:
        """Places and texts of the words of a piece that begins at ``at``."""
        found = [(m.start() + at, m[0]) for m in _WORD.finditer(text)]
        words = [w for _, w in found]
        self.learn(words)
        return [p for p, _ in found], words


def join(coder: Coder, text: str, low: int, cut: int, high: int, left, right, window: int = FIRST_WINDOW):
    """Join the encodings of text[low:cut] and text[cut:high]."""
    while True:
        a, b = max(low, cut - window), min(high, cut + window)
        places, words = coder.piece(text[a:b], a)
        if a == low and b == high:
            return places, words
        of = dict(zip(places, range(len(places)), strict=True))
        p = q = None
        for i in range(len(left[0]) - 1, -1, -1):  # a whole word before the cut, not at the window's edge
            at, end = left[0][i], left[0][i] + len(left[1][i])
            if at <= a and a > low:
                break
            if end < cut and at in of and coder.of(words[of[at]]) == coder.of(left[1][i]):
                p = (i, of[at])
                break
        for i, at in enumerate(right[0]):  # a whole word after the cut
            end = at + len(right[1][i])
            if end >= b and b < high:
                break
            if at > cut and at in of and coder.of(words[of[at]]) == coder.of(right[1][i]):
                q = (i, of[at])
                break
        if a == low and p is None:
            p = (0, 0)
        if b == high and q is None:
            q = (len(right[0]), len(words))
        if p is not None and q is not None:
            return left[0][: p[0]] + places[p[1] : q[1]] + right[0][q[0] :], left[1][: p[0]] + words[p[1] : q[1]] + right[1][q[0] :]
        window *= 2


def bounds(n: int, leaf: int) -> list[int]:
    """Cuts of n characters by halving until no piece is longer than ``leaf``."""
    cuts = [0, n]
    while max(b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)) > leaf:
        cuts = sorted({*cuts, *[(a + b) // 2 for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})
    return cuts


def concatenate(coder: Coder, text: str, cuts: list[int], pieces: list) -> list[str]:
    """Join neighbours, then their neighbours, up to the whole text."""
    while len(pieces) > 1:
        joined, ends = [], [cuts[0]]
        for i in range(0, len(pieces), 2):
            if i + 1 < len(pieces):
                joined.append(join(coder, text, cuts[i], cuts[i + 1], cuts[i + 2], pieces[i], pieces[i + 1]))
            else:
                joined.append(pieces[i])
            ends.append(cuts[min(i + 2, len(pieces))])
        cuts, pieces = ends, joined
    return pieces[0][1]


@cache
def coder_for(path: str) -> Coder:
    return Coder(path)


def _encoded(coder: Coder, words_of: list[list[str]]) -> list[pa.Array]:
    known = coder.known
    ids = [b"".join([known[w] for w in words]) for words in words_of]
    ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
    decoded, at = [], 0
    while at < len(ids):  # strings of a step stay far below the 2 GB of an array
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP_IDS, "right")) - 1)
        flat = coder.names.take(pa.array(np.frombuffer(b"".join(ids[at:to]), "<u4")))
        decoded.append(pc.binary_join(pa.ListArray.from_arrays(pa.array((ends[at : to + 1] - ends[at]).astype(np.int32)), flat), " "))
        at = to
    return [pa.array(np.diff(ends)), pa.array(ids, pa.binary()), pa.concat_arrays(decoded) if decoded else pa.array([], pa.string())]


def encode(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS, spread_chars: int = SPREAD_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row, before them the columns ``keep``.

    ``ids``: little-endian unsigned 32-bit integers; ``decoded``: the ids decoded again.
    """
    path = path or vocabulary_path()
    own = ["doc_id", *keep]
    kind = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in own)
    docs = docs.select(*own, F.col("text").cast("string").alias("text"))
    out = f"{kind}, n_tokens long, ids binary, decoded string"
    names = [*own, "n_tokens", "ids", "decoded"]

    def short(batches):
        coder = coder_for(path)
        for batch in batches:
            for part in slices(batch):
                words_of = []
                for t in part.column("text").to_pylist():
                    t = t or ""
                    if len(t) <= leaf_chars:
                        words = _WORD.findall(t)
                    else:
                        cuts = bounds(len(t), leaf_chars)
                        words = concatenate(coder, t, cuts, [coder.piece(t[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                    words_of.append(words)
                coder.learn({w for words in words_of for w in words})
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *_encoded(coder, words_of)], names)

    done = docs.filter(F.coalesce(F.char_length("text") <= spread_chars, F.lit(True))).mapInArrow(short, out)
    if not docs.filter(F.char_length("text") > spread_chars).limit(1).count():
        return done
    long = scratch(docs.filter(F.char_length("text") > spread_chars).withColumn("row", F.monotonically_increasing_id()), "long")

    def cut(batches):
        for batch in batches:
            for i, t in enumerate(batch.column("text").to_pylist()):
                cuts = bounds(len(t), spread_chars)
                for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    one = [batch.column(c).slice(i, 1) for c in ("row", *own)]
                    yield pa.RecordBatch.from_arrays([*one, pa.array([n]), pa.array([a]), pa.array([t[a:b]])], ["row", *own, "n", "at", "text"])

    def piece(batches):
        coder = coder_for(path)
        for batch in batches:
            for i in range(batch.num_rows):
                t, at = batch.column("text")[i].as_py(), batch.column("at")[i].as_py()
                cuts = bounds(len(t), leaf_chars)
                words = concatenate(coder, t, cuts, [coder.piece(t[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                places = [m.start() + at for m in _WORD.finditer(t)]
                yield batch.slice(i, 1).append_column("places", pa.array([places], pa.list_(pa.int64()))).append_column("words", pa.array([words], pa.list_(pa.string())))

    def whole(table: pa.Table) -> pa.Table:
        coder = coder_for(path)
        rows = sorted(table.to_pylist(), key=lambda r: r["n"])
        t = "".join(r["text"] for r in rows)
        words = concatenate(coder, t, [r["at"] for r in rows] + [len(t)], [(r["places"], r["words"]) for r in rows])
        coder.learn(words)
        return pa.Table.from_arrays([*[table.column(c).slice(0, 1) for c in own], *_encoded(coder, [words])], names)

    rows = long.mapInArrow(cut, f"row long, {kind}, n long, at long, text string").repartition("row", "n")
    rows = rows.mapInArrow(piece, f"row long, {kind}, n long, at long, text string, places array<long>, words array<string>")
    return done.unionByName(rows.groupBy("row").applyInArrow(whole, out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(documents(spark, sf_dir))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe_tree_concatenation": query}
ORACLES: dict[str, str] = {}
