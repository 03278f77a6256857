import random

import numpy as np
import pyarrow as pa
from loomspark.llm import common


def test_words_are_the_runs_between_spaces_and_equal_words_have_equal_hashes():
    r = random.Random(5)
    texts = ["".join(r.choice("ab é漢 \t\n\x0b.") for _ in range(r.randint(0, 40))) for _ in range(300)] + ["", None, "   "]
    w = common.words(pa.array(texts))
    seen: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        raw = [x for x in _split((t or "").encode())]
        got = [w.buf[a:b].tobytes() for a, b in zip(w.start[w.ptr[i] : w.ptr[i + 1]], w.end[w.ptr[i] : w.ptr[i + 1]])]
        assert got == raw
        for x, h in zip(got, w.hashes[w.ptr[i] : w.ptr[i + 1]].tolist()):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def _split(raw: bytes):
    for s in common.SPACES:
        raw = raw.replace(bytes([s]), b" ")
    return [x for x in raw.split(b" ") if x]


def test_grams_stay_inside_documents():
    w = common.words(pa.array(["a b c d", "c d", "b c d"]))
    h, inside = w.grams(2)
    doc = w.doc_of()[: len(h)]
    assert [int(x) for x in np.bincount(doc[inside], minlength=3)] == [3, 1, 2]
    first, last = h[inside][doc[inside] == 0], h[inside][doc[inside] == 2]
    assert first[1:].tolist() == last.tolist() and first[2] == h[inside][doc[inside] == 1][0]


def test_chunks_hold_all_rows_and_long_texts_alone():
    b = pa.record_batch([pa.array(["x" * n for n in (10, 500, 3, 3, 3, 0)] + [None])], ["text"])
    parts = list(common.chunks(iter([b]), most=20))
    assert sum(p.num_rows for p in parts) == b.num_rows
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 20 for p in parts)
