import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import op5


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(op5.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rnd = random.Random(5)
    bits = ["the", "Thinking", "don't", "'s", "é", "é", " ́x", "a b", "日本語", "123", "<|endoftext|>", "<|start", "oftext|>", "!!!", " ", "İ", "ß", "\n\n", "\r\n", "\x0b", "😀", "x" * 70, "​", "\x1f", "\x85"]
    out = [None, "", " ", "a", "́", "a" * 3000, "ab" * 900 + " " + "c" * 500, " " * 4000 + "end", "x" + "́" * 900]
    for _ in range(60):
        out.append("".join(rnd.choice(bits) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.choice([1, 5, 40, 700]))))
    return out


@pytest.mark.parametrize(("leaf", "spread"), [(16_384, 1 << 20), (100, 1 << 20), (37, 700)])
def test_library(spark, library, leaf, spread):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, "a", "y"), (None, "a b", "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in op5.encode(d, leaf_chars=leaf, spread_chars=spread).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert op5.encode(d.limit(0)).count() == 0


def test_plain_words_go_to_the_library_together(library, monkeypatch):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeXYZÄß.,'\"019-") for _ in range(rnd.randrange(1, 12))) for _ in range(2000)]
    words += ["<|endoftext|>", "a<|endoftext|>b", "<|endof", "text|>", "<", "|", "İ.", "é", "日本", "́", "\x85", "x y", "!?...", "don't", "\x1f"]
    coder, sent = op5.Coder(op5.vocabulary_path(), together=100), []
    plain = coder._encoded
    monkeypatch.setattr(coder, "_encoded", lambda texts: sent.extend(texts) or plain(texts))
    coder.learn(words)
    assert len(sent) < 50
    assert all(coder.of(w) == np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words)


def test_decoding_in_steps(library, monkeypatch):
    monkeypatch.setattr(op5, "STEP_IDS", 5)
    coder = op5.Coder(op5.vocabulary_path())
    texts = ["", "a b c d e f g", "x", "", "two words", "\u0085", "one"]
    words = [t.split(" ") if t else [] for t in texts]
    coder.learn({w for ws in words for w in ws})
    n, ids, decoded = op5._encoded(coder, words)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.to_pylist() == [len(x) for x in want] and ids.to_pylist() == [np.array(x, "<u4").tobytes() for x in want]
    assert decoded.to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want]
