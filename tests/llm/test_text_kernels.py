"""Kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from basalt.llm import kernels as K

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab É\n\t.,7Z", max_size=30)), min_size=1, max_size=8)


def split(values, **how):
    parts = [(i, j, K.words(buf, offsets, **how)) for i, j, buf, offsets in K.text_chunks(pa.array(values, pa.string()), 16)]
    return [w.hashes[w.first[d] : w.first[d + 1]].tolist() for i, j, w in parts for d in range(j - i)]


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_match_the_pattern(values):
    want = [re.findall(r"[^\x20\x09-\x0D]+", v or "") for v in values]
    got = split(values)
    assert [len(g) for g in got] == [len(w) for w in want]
    fold = {chr(i): chr(i + 32) for i in range(65, 91)}
    names = {}
    for g, w in zip(got, want, strict=True):
        for h, word in zip(g, w, strict=True):
            low = "".join(fold.get(c, c) for c in word)
            assert names.setdefault(low, h) == h
    assert len(set(names.values())) == len(names)


def test_shingles_and_keys():
    w = K.words(np.frombuffer(b"a b c d e f a b c d e x y", np.uint8), np.array([0, 11, 21, 21, 25]))
    sets = K.shingle_sets(w)
    assert [len(s) for s in sets] == [2, 1, 0, 1]
    assert set(sets[1].tolist()) <= set(sets[0].tolist())
    keys = K.sequence_keys(w)
    assert len({k.tobytes() for k in keys}) == 4
    assert K.binary_rows(K.keys_to_arrow(keys), np.uint64, 2).tolist() == keys.tolist()
