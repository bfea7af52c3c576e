import re

import numpy as np
import pyarrow as pa

from quarry.llm import text as T

TEXTS = ["A  b\tc", "", None, "x", " é-È 9\n", "abc abc", "tail"]


def test_words_match_regex():
    for table, lower, pattern in ((T.NON_SPACE, False, rb"[^\x20\x09-\x0D]+"), (T.ALNUM, True, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = T.Words(pa.array(TEXTS), table, lower)
        want = [re.findall(pattern, (t or "").encode().lower() if lower else (t or "").encode()) for t in TEXTS]
        got = [[bytes(w.buf[w.start[i] : w.end[i]]) for i in range(w.first[k], w.first[k + 1])] for k in range(len(TEXTS))]
        assert got == want


def test_hashes_follow_content():
    w = T.Words(pa.array(["abc de abc", "de abc de abc", "e"]), T.NON_SPACE, False)
    h = w.hashes()
    assert h[0] == h[2] == h[4] == h[6] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 3
    g, ok = T.ngrams(h, 3), T.inside(w.first, 3, w.n)
    assert ok.tolist() == [True, False, False, True, True, False] and g[0] == g[4] and len(set(g.tolist())) == 3


def test_slice_of_a_larger_array():
    a = pa.array(["zz zz", "abc de", None, "abc"]).slice(1)
    w = T.Words(a, T.NON_SPACE, False)
    assert w.counts().tolist() == [2, 0, 1] and w.hashes()[0] == w.hashes()[2]
    assert not len(T.ngrams(np.zeros(0, np.uint64), 3))


def test_words_that_differ_have_different_hashes():
    words = ["a" * n for n in range(1, 1200, 7)] + ["a" * n + "b" for n in range(0, 1200, 7)] + ["".join("ab"[bin(i ^ f).count("1") % 2] for i in range(2048)) for f in (0, 1)]
    w = T.Words(pa.array([" ".join(words), " ".join(reversed(words))]), T.NON_SPACE, False)
    h = w.hashes()
    assert len(set(h[: len(words)].tolist())) == len(words) and (h[: len(words)] == h[len(words) :][::-1]).all()
    data, to = w.spaced()
    assert data == (" ".join(words) + " " + " ".join(reversed(words)) + " ").encode() and data[to[3] : to[4]].decode() == words[3] + " "
