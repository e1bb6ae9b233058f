import hashlib

from conftest_llm import order_id

from cohortloom.llm import anchors as A


def brute(rows):
    words = [(r[1] or "").encode().split() for r in rows]
    first = {}
    for row, w in zip(rows, words):
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, order_id(row)), order_id(row))
    out = []
    for row, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < order_id(row):
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((row[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_cover_reaches_every_difference():
    for i in range(A.PERIOD):
        for j in range(A.PERIOD):
            assert any((i + d) % A.PERIOD in A.COVER and (j + d) % A.PERIOD in A.COVER for d in range(A.PERIOD))


def test_report_equals_brute_force(docs, rows, none):
    got = [tuple(r) for r in A.repeat_report(docs).collect()]
    want = brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 500
    assert A.repeat_report(none).count() == 0


def test_texts(docs, rows):
    out = A.drop_repeats(docs)
    assert out.schema == docs.schema
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[60]["text"] == "" and by_id[70]["text"] is None and by_id[60]["kept"] == "own"
    assert by_id[73]["text"] == "word"
