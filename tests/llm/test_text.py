import numpy as np
import pyarrow as pa

from foldspark.llm import text as X
from tests.llm.conftest import lower, texts, words


def test_words_are_those_of_the_pattern(monkeypatch):
    column = [t for _, t in texts()]
    for piece in (16, 64, 1 << 20):
        monkeypatch.setattr(X, "PIECE", piece)
        raw, offsets = X.arrow_bytes(pa.array(column))
        h, d, s, e = X.words(raw, offsets, spans=True)
        data = raw.tobytes()
        assert [data[a:b].decode() for a, b in zip(s, e, strict=True)] == [w for t in column for w in words(t)]
        assert d.tolist() == [i for i, t in enumerate(column) for _ in words(t)]
        seen = {}
        for a, b, x in zip(s, e, h.tolist(), strict=True):
            assert seen.setdefault(data[a:b], x) == x
        assert len(set(seen.values())) == len(seen)
        low = X.words(raw, offsets, lower=True)[0]
        again = X.words(*X.arrow_bytes(pa.array([lower(t) for t in column])))[0]
        assert np.array_equal(low, again)


def test_windows_stay_in_texts():
    h, d = X.words(*X.arrow_bytes(pa.array(["a b c", "a b c d", None, "a"])))
    w = X.windows(h, 3)
    assert X.inside(d, 3).tolist() == [True, False, False, True, True, False]
    assert w[0] == w[3] != w[4]


def test_slices_of_a_column():
    column = pa.array(["x y", None, "ü z", "q"]).slice(1, 2)
    raw, offsets = X.arrow_bytes(column)
    assert raw.tobytes().decode() == "ü z" and offsets.tolist() == [0, 0, 4]
