import random
import zlib

import numpy as np
import pytest

from cohortloom.llm import langid as L


def test_gradients_are_those_of_the_loss():
    net = L.ByteGru(3)
    x, y = np.array([[1, 2, 3, 4], [5, 2, 200, 4]], np.uint8), np.array([0, 2])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        return -net.forward(x)[0][:, np.arange(2), y].mean()

    for name, g in net.gradients(x, y).items():
        at = (2, 7) if name[0] == "w" else tuple(n // 2 for n in net.p[name].shape)
        was = net.p[name][at]
        net.p[name][at] = was + 1e-3
        high = loss()
        net.p[name][at] = was - 1e-3
        low = loss()
        net.p[name][at] = was
        assert g[at] == pytest.approx((high - low) / 2e-3, rel=0.02, abs=2e-6)


def _labelled():
    rng = random.Random(9)
    parts = {"en": ["th", "ing", "er", "wh", "ou"], "de": ["sch", "ung", "ß", "ei", "ck"], "fr": ["eau", "é", "oi", "qu", "ç"]}
    out = []
    for k in range(300):
        lang = ("en", "de", "fr")[k % 3]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 40))]
        out.append((k, " ".join(words), None if k % 17 == 0 else lang, lang))
    return out


def test_held_out_accuracy(spark, none):
    data = _labelled()
    docs = spark.createDataFrame([(d, t, lang, "x") for d, t, lang, _ in data], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in L.language_report(docs).collect()}
    assert {d: r["held_out"] for d, r in got.items()} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in data}
    held = [(got[d]["lang_pred"], true) for d, _, _, true in data if got[d]["held_out"]]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert L.language_report(none).count() == 0


def test_odd_rows(docs, spark):
    got = {r["doc_id"]: r for r in L.language_report(docs).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (70, 71, 72, 77))
    assert got[75]["lang_pred"] in ("en", "de") and got[74]["lang_pred"] in ("en", "de")
    data = [(k, "schung the " * 5, ("de", "en")[k % 2]) for k in range(40)] + [(900, "½ ² ① ⅷ _ 7", None), (901, "½a", None)]
    found = {r["doc_id"]: r["lang_pred"] for r in L.language_report(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert found[900] == "und" and found[901] != "und"  # numbers are no letters
    plain = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.language_report(plain).first()["lang_pred"] == "und"  # nothing to learn from


def test_memory_and_order_change_nothing(monkeypatch):
    net = L.train([("thing", 0), ("schung", 1)] * 20, 2)
    texts = ["thing other", "schung schung x", None, "12", "y" * 500]
    want = L.Reader(net, ["en", "de"]).predict(texts)
    monkeypatch.setattr(L, "MEMORY_WORDS", 1)
    small = L.Reader(net, ["en", "de"])
    got = [small.predict([t])[0] for t in reversed(texts)][::-1]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5)
