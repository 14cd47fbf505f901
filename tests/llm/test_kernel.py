import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm.kernel import chain, hash_words, shingle_sets, word_counts, words

TEXT = st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x1fz𝒳-", max_size=40))


def plain_words(text):
    low = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", low)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 30))
def test_words_are_those_of_the_contract(texts, chunk):
    got = []
    for found in words(pa.array(texts, pa.string()), chunk=chunk):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in found.raw.tobytes())
        hashes = found.hash
        for row in range(found.hi - found.lo):
            at = range(found.bounds[row], found.bounds[row + 1])
            got.append([low[found.start[k] : found.end[k]] for k in at])
            assert [hashes[k] for k in at] == [hash_words([w.decode("utf-8", "surrogateescape")])[0] for w in got[-1]]
    assert got == [plain_words(t) for t in texts]
    assert word_counts(pa.array(texts, pa.string()), chunk).tolist() == [len(plain_words(t)) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(TEXT, max_size=5), st.integers(1, 4))
def test_shingle_sets(texts, n):
    sizes = {}
    for found in words(pa.array(texts, pa.string())):
        for row, own in shingle_sets(found, n):
            sizes[row] = len(own)
    for row, text in enumerate(texts):
        w = plain_words(text)
        want = len({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
        assert sizes[row] == want


def test_sliced_columns_and_order_of_shingles():
    column = pa.array(["x y", "a b c", None, "c b a"]).slice(1)
    (found,) = words(column)
    own = dict(shingle_sets(found, 3))
    assert [len(own[k]) for k in range(3)] == [1, 0, 1] and own[0][0] != own[2][0]
    assert len(chain(np.arange(3, dtype=np.uint64), 4)) == 0
