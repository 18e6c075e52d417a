import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import text

from .helpers import words

TEXTS = st.lists(st.none() | st.text(alphabet="ab é中\n\t\x0b\x85\xa0 ", max_size=30), max_size=12)


@settings(deadline=None, max_examples=150)
@given(TEXTS)
def test_words_of_slices(texts):
    found = []
    for _, _, buf, off in text.slices(pa.array(texts, pa.string()), 40):
        s, e, at = text.words(buf, off)
        all_words = [buf[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)]
        found += [all_words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert found == [words(t) for t in texts]


def test_hashes_do_not_depend_on_place():
    long = "x" * 5000
    buf = np.frombuffer(f"abc de abc {long} q {long}".encode(), np.uint8)
    s, e, _ = text.words(buf, np.array([0, len(buf)]))
    h = text.hash_spans(buf, s, e)
    assert h[0] == h[2] and h[3] == h[5] and len(set(h.tolist())) == 4


def test_hashes_over_chunk_borders():
    raw = (b"word%d " * 1) % 7
    buf = np.frombuffer(raw * 300_000, np.uint8)
    s, e, _ = text.words(buf, np.array([0, len(buf)]))
    assert len(set(text.hash_spans(buf, s, e).tolist())) == 1


def test_grams():
    h = np.arange(10, dtype=np.uint64)
    assert len(text.grams(h, 4)) == 7
    assert len(text.grams(h[:2], 4)) == 1 and len(text.grams(h[:0], 4)) == 0
    assert text.grams(h[:2], 4)[0] != text.grams(h[:3], 4)[0]
