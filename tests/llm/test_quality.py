import random
from collections import Counter

import numpy as np
import pytest

from cohortloom.llm import quality as Q


def brute_stats(text):
    text = text or ""
    words = [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c\n")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside |= {i, i + 1, i + 2}
    duplicates = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), duplicates, len(inside), len(lines)


def test_statistics_equal_brute_force(rows):
    odd = ["a a a a a", "x y z x y z w", "l\nl\n\n \nl\n", "a\x0bb\x0cc\rd", "é é é", "#*$%&|<>\n#", ""]
    for text in odd + [r[1] for r in rows]:
        assert Q.text_stats(text) == brute_stats(text)


def test_chi_square():
    assert Q._chi2_cdf(Q.chi2_quantile(0.75, 4), 4) == pytest.approx(0.75)
    assert Q.chi2_quantile(0.95, 2) == pytest.approx(5.991464547, abs=1e-6)
    assert Q.chi2_quantile(0.99, 4) == pytest.approx(13.27670414, abs=1e-6)


def _corpus():
    rng = random.Random(4)
    out = []
    for k in range(900):
        lang, source = ("en", "fr")[k % 2], f"s{k % 2}" if k < 800 else f"small{k}"
        junk = k % 20 == 7
        length = 5 if lang == "en" else 7
        words = ["".join(rng.choice("abcdefghij") for _ in range(max(1, int(rng.gauss(length, 1.5))))) for _ in range(rng.randint(60, 300))]
        if junk:
            words = [w + "###" if i % 2 else w for i, w in enumerate(words)]
        out.append((k, " ".join(words), lang, source, junk, "mine"))
    return out + [(901, None, None, None, False, "mine"), (902, "too short", "en", "s0", False, "mine"), (903, "same words here " * 80, "en", "s0", False, "mine")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(_corpus(), "doc_id long, text string, lang string, source string, junk boolean, kept string")


def brute_distances(found):
    """The same estimates in numpy, for one group's vectors."""
    floors = np.array(list(Q.FEATURES.values()))
    p, q = len(floors), Q.chi2_quantile(Q.SUPPORT, len(floors))
    center = np.median(found, axis=0)
    spread = (np.quantile(found, 0.75, axis=0) - np.quantile(found, 0.25, axis=0)) / 1.349
    inverse = np.diag(1 / np.maximum(spread, floors) ** 2)
    for _ in range(Q.STEPS):
        d = found - center
        distance = np.einsum("ni,ij,nj->n", d, inverse, d)
        cls = np.floor(16 * np.log2(distance + 1e-9))
        order = np.sort(cls)
        edge = order[min(len(order) - 1, int(np.ceil(Q.SUPPORT * len(order))) - 1)]
        near = found[cls <= edge]
        center = near.mean(axis=0)
        cov = np.cov(near.T, bias=True) * Q.SUPPORT / Q._chi2_cdf(q, p + 2)
        inverse = np.linalg.inv(lifted(cov, floors))
    d = found - center
    return np.einsum("ni,ij,nj->n", d, inverse, d)


def lifted(cov, floors):
    """At least the spread of the floors in every direction, term by term."""
    values, turn = np.linalg.eigh(cov / floors[:, None] / floors[None, :])
    out = np.zeros_like(cov)
    for value, direction in zip(values, turn.T):
        out += max(value, 1.0) * np.outer(direction * floors, direction * floors)
    return out


def test_scatter_of_degenerate_groups():
    floors = np.array(list(Q.FEATURES.values()))
    rng = np.random.default_rng(2)
    line = np.outer(rng.normal(size=50), [1.0, 0.5, 2.0, -1.0])
    groups = [np.ones((30, 4)), np.repeat([[1.0, 0, 0, 0], [1.2, 0.5, 0.5, 0.5]], 20, axis=0), line, rng.normal(size=(40, 4)) * 1e-9, rng.normal(size=(60, 4))]
    for x in groups:
        cov = (x - x.mean(0)).T @ (x - x.mean(0)) / len(x)
        for noise in (0.0, 1e-17, -1e-17):  # rounding of sums
            inverse = Q.inverse_scatter(cov + noise, floors)
            assert np.linalg.eigvalsh(inverse).min() > 0
            assert np.allclose(inverse @ lifted(cov + noise, floors), np.eye(4), atol=1e-6)
            step = rng.normal(size=(100, 4)) * floors / 2
            assert (np.einsum("ni,ij,nj->n", step, inverse, step) <= 1.0001 * ((step / floors) ** 2).sum(1)).all()


@pytest.mark.parametrize("first,second", [(120, 80), (100, 100), (200, 0)])
def test_groups_of_copies(spark, first, second):
    """Copies of one or two pages: nothing fails, no distance is negative, and a page near the line between them stays."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7))) for _ in range(240)]
    lines = [" ".join(words[k : k + 10]) for k in range(0, 200, 10)]
    clean, repeated = "\n".join(lines), "\n".join([*lines[:15], *lines[:5]])
    near = "\n".join([*lines[:18], lines[0], " ".join(words[200:210])])  # one line twice
    data = [(k, clean) for k in range(first)] + [(1000 + k, repeated) for k in range(second)] + [(2000, near)]
    docs = spark.createDataFrame([(k, t, "en", "s0") for k, t in data], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in Q.quality_report(docs).collect()}
    assert len(got) == len(data) and all(r["distance"] >= 0 for r in got.values())
    assert got[0]["kept"] and (second == 0 or (got[1000]["kept"] and got[2000]["kept"]))


def test_report(corpus):
    got = {r["doc_id"]: r for r in Q.quality_report(corpus).collect()}
    data = _corpus()
    assert set(got) == {r[0] for r in data}
    vectors, eligible = {}, {}
    for doc_id, text, lang, source, *_ in data:
        n, chars, symbols, dup, repeat, lines = brute_stats(text)
        row = got[doc_id]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        failed = n < 50 or 100 * repeat > 50 * n
        assert row["base_failed"] == failed
        if not failed:
            vectors[doc_id] = [np.log((chars + 250) / (n + 50)), np.sqrt(symbols / n), np.sqrt(repeat / n), np.sqrt(dup / max(lines, 1))]
            eligible[doc_id] = (lang, source)
    for group in {("en", "s0"), ("fr", "s1")}:
        ids = [d for d, g in eligible.items() if g == group]
        want = brute_distances(np.array([vectors[d] for d in ids]))
        assert np.allclose([got[d]["distance"] for d in ids], want, rtol=0.05, atol=0.05)
    for doc_id, _, _, _, junk, _ in data[:900]:
        assert got[doc_id]["kept"] == (not junk), doc_id
    assert not got[901]["kept"] and not got[902]["kept"] and not got[903]["kept"]


def test_filter_keeps_columns_and_small_corpora(corpus, docs, none):
    kept = Q.keep_good(corpus)
    assert kept.columns == corpus.columns and {r["kept"] for r in kept.collect()} == {"mine"}
    few = Q.quality_report(docs)  # too few rows for any estimate: the base rules alone decide
    assert all(r["kept"] != r["base_failed"] for r in few.collect())
    assert Q.keep_good(none).count() == 0 and Q.keep_good(none).columns == none.columns


def test_outliers_in_duplicate_lines_or_repeats_alone(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7)))
    prose = lambda n: [word() for _ in range(n)]
    data = [(k, "\n".join(" ".join(prose(10)) for _ in range(20))) for k in range(300)]
    short = ["\n".join([*(" ".join(prose(10)) for _ in range(4)), *["menu"] * 36]) for _ in range(3)]  # nine lines of ten
    phrase = [" ".join(prose(131) + prose(8) * 12) for _ in range(3)]  # two words of five
    data += [(1000 + k, t) for k, t in enumerate(short)] + [(2000 + k, t) for k, t in enumerate(phrase)]
    docs = spark.createDataFrame([(k, t, "en", "s0") for k, t in data], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in Q.quality_report(docs).collect()}
    assert all(r["kept"] for k, r in got.items() if k < 1000)
    for k, r in got.items():
        if k >= 1000:
            assert not r["base_failed"] and not r["kept"], k
        if k >= 2000:
            assert r["n_dup_lines"] == 0 and r["n_repeat_words"] > 0
