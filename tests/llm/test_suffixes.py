import hashlib

import numpy as np
from conftest_llm import order_id

from cohortloom.llm import suffixes as S


def test_suffix_array_sorts_all_suffixes():
    rng = np.random.default_rng(1)
    for case in range(150):
        n = int(rng.integers(1, 250))
        a = rng.integers(0, int(rng.integers(1, 6)), n).astype(np.uint8) + np.uint8(97 * (case % 2))
        if case % 5 == 0:
            a = np.tile(a[:7], 40)[:n].copy()
        data = a.tobytes()
        order = S.suffix_array(a, len(a) + 8)
        assert order.tolist() == sorted(range(len(a)), key=lambda i: data[i:])
        words = np.append(S._words(a), np.zeros(64, np.uint64))
        for k, shared in list(enumerate(S.common_prefixes(words, order, 50).tolist()))[1:]:
            x, y = data[order[k - 1] :], data[order[k] :]
            want = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            if 0 not in x + y:
                assert shared == min(want, 50)


def brute(rows):
    first = {}
    for row in rows:
        data = (row[1] or "").encode()
        for i in range(len(data) - S.LENGTH + 1):
            key = data[i : i + S.LENGTH]
            first[key] = min(first.get(key, order_id(row)), order_id(row))
    out = []
    for row in rows:
        data = (row[1] or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - S.LENGTH + 1):
            if first[data[i : i + S.LENGTH]] < order_id(row):
                gone[i : i + S.LENGTH] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((row[0], len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_report_equals_brute_force(docs, rows, none):
    got = [tuple(r) for r in S.repeat_report(docs).collect()]
    want = brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 5000
    assert S.repeat_report(none).count() == 0


def test_texts_keep_whole_characters(docs, rows):
    out = S.drop_repeats(docs)
    assert out.schema == docs.schema
    got = out.collect()
    assert len(got) == len(rows) and {r["copy"] for r in got} == {"own"}
    by_id = {r["doc_id"]: r["text"] for r in got}
    assert by_id[60] == "" and by_id[70] is None  # a copy goes, a null stays
    assert S._whole_characters("aéb".encode(), [(2, 4)]) == [(1, 4)]
    assert S._whole_characters("éé".encode(), [(0, 1), (2, 3)]) == [(0, 4)]
