import hashlib
import math
import re
from collections import Counter
from functools import reduce

import xxhash

from cohortloom.llm import imatch as M


def _want(rows):
    """n_chars and the digest of the edited text, by brute force, in descending order of id, null last; the first of equal ids by text."""
    known = sorted(((M.NO_ID if r[0] is None else r[0], r[1] or "") for r in rows), key=lambda x: (-x[0], x[1]))
    ids = sorted({d for d, _ in known}, reverse=True)
    first = {}
    for d, t in known:
        first.setdefault(d, t)
    out = []
    for d, t in known:
        after = first[ids[(ids.index(d) + 1) % len(ids)]]
        half = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out)


def _chained(seed, data):
    return xxhash.xxh64_intdigest(data, seed=seed)


def _terms(text):
    """Different words as signed hashes, in their order."""
    words = {w.encode() for w in re.split("[\x20\x09-\x0D]+", text.lower()) if w}
    found = {_chained(_chained(42, w), M.SEED.to_bytes(4, "little")) for w in words}
    return sorted(h - (h >> 63 << 64) for h in found)


def _murmur(values):
    """Murmur3 of 64-bit numbers, each seeded by the hash of those before."""

    def one(h, value):
        rotated = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
        for k in (value & 0xFFFFFFFF, value >> 32):
            k = rotated(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            h = (rotated(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    return reduce(one, values, 42)


def _slot(term):
    return (term & (1 << 64) - 1) >> 64 - M.SLOT_BITS


def _fingerprint(text, lexicon):
    """Hashes by size, and what is shown of them."""
    terms = _terms(text)
    band = [t for t in terms if _slot(t) in lexicon]
    numbered = [[_chained(_chained(42, (t & (1 << 64) - 1).to_bytes(8, "little")), n.to_bytes(4, "little")) for t in band] for n in range(1, M.PER_LEVEL + 1)]
    sizes = [[_murmur(kept) if (kept := [h for h in hs if h % (2 << k) == 0]) else None for hs in numbered] for k in range(M.LEVELS)]
    if band:
        return sizes, ".".join("-" if h is None else f"{h:x}" for size in sizes for h in size)
    return sizes, "w%x" % reduce(_chained, [(t & (1 << 64) - 1).to_bytes(8, "little") for t in terms], 42)


def _likeness(a, b):
    if a[1] == b[1]:
        return 1.0
    used = [[(x, y) for x, y in zip(p, q) if x is not None or y is not None] for p, q in zip(a[0], b[0])]
    told = ([u for u in used if 2 * len(u) >= M.PER_LEVEL] or used[:1])[-1]
    return sum(x == y for x, y in told) / len(told) if told else 0.0


def test_fingerprints_and_likenesses_by_brute_force(docs, rows):
    counts = Counter(slot for r in rows for slot in {_slot(t) for t in _terms(r[1] or "")})
    lexicon = {slot for slot, df in counts.items() if df > 1 and 0.1 <= math.log(len(rows) / df) <= 8.0}
    known = sorted(((M.NO_ID if r[0] is None else r[0], r[1] or "") for r in rows), key=lambda x: (-x[0], x[1]))
    ids = sorted({d for d, _ in known}, reverse=True)
    first = {d: t for d, t in reversed(known)}
    want = []
    for d, t in known:
        after = first[ids[(ids.index(d) + 1) % len(ids)]]
        own, edited, following = (_fingerprint(x, lexicon) for x in (t, t[: len(t) - len(t) // 2] + after[: len(t) // 2], after))
        want.append((d, len(t), own[1], edited[1], _likeness(own, edited), _likeness(own, following)))
    got = M.neighbour_report(docs, 0.1, 8.0).collect()
    names = ("n_chars", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted((M.NO_ID if r["doc_id"] is None else r["doc_id"], *(r[n] for n in names)) for r in got) == sorted(want)


def test_report(docs, rows, none):
    got = M.neighbour_report(docs, 0.1, 8.0).collect()
    assert sorted((M.NO_ID if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == _want(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert len({by_id[k]["fingerprint"] for k in range(60, 70)}) == 1  # equal texts
    assert by_id[64]["near_next"] == 1.0 and by_id[64]["near_edited"] >= by_id[30]["near_edited"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    plain = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 40 and r["n_chars"] > 400]
    assert sum(r["near_edited"] for r in plain) > 2 * sum(r["near_next"] for r in plain)
    assert M.neighbour_report(none).count() == 0


def test_single_document_is_its_own_next(spark):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    row = M.neighbour_report(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and row["near_next"] == 1.0


def test_lexicon_is_the_band_of_document_frequency(spark):
    docs = spark.createDataFrame([(" ".join(["all", f"own{k}", f"half{k % 2}", f"Tenth{k % 10}"]),) for k in range(40)], "text string")
    words = M.lexicon(docs, 0.5, 2.5)
    shown = spark.createDataFrame([(w,) for w in ["all", "own3", "half1", "tenth4"]], "w string")
    inside = shown.select("w", M._in_lexicon(M.term_hashes(shown.w)[0], words).alias("x")).collect()
    assert {r["w"]: r["x"] for r in inside} == {"all": False, "own3": False, "half1": True, "tenth4": True}


def test_no_python_in_the_plan(docs):
    plan = M.neighbour_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Python", "Arrow", "Pandas"))
