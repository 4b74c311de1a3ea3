import numpy as np
import pyarrow as pa

from rillflow.llm import hashing as h


def test_words_are_cut_and_hashed_as_by_split():
    texts = ["", None, "a b a", " Foo\tbar\r\n foo ", "é x", "\x1c a", "one"] + ["w%d x y" % i for i in range(50)]
    data, offsets = h.buffers(pa.array(texts))
    words = h.Words(3, lower=True)
    starts, ends, first = words.borders(data, offsets)
    got = [data[a:b].tobytes().lower() for a, b in zip(starts, ends)]
    want = [w for t in texts for w in (t or "").encode().lower().split()]
    assert got == want
    hashes = words.hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(want))
    assert dict(zip(got, hashes.tolist())) == {g: x for g, x in zip(got, hashes.tolist())}
    assert list(np.diff(first)) == [len((t or "").split(None)) if "\x1c" not in (t or "") else 2 for t in texts]


def test_windows_stay_within_texts():
    texts = ["a b c", "a b", "c a b c d", ""]
    data, offsets = h.buffers(pa.array(texts))
    words = h.Words(3, lower=False)
    starts, ends, first = words.borders(data, offsets)
    hashes = words.hashes(data, starts, ends)
    kept = h.windows(hashes, 3, 1)[h.within(first, 3, len(hashes))]
    assert len(kept) == 4 and kept[0] == kept[2]


def test_spans_cover_all_rows():
    offsets = np.array([0, 5, 5, 100, 101, 300, 300])
    assert list(h.spans(offsets, 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)] or [i for a, b in h.spans(offsets, 10) for i in range(a, b)] == list(range(6))
