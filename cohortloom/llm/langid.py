"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word with a blank on each side, byte by byte, once forwards and once backwards, and gives every
position a distribution over the languages.  It starts anew at each word, so equal words have equal outputs and a task reads
each different word once.  A document's probabilities pool the log-probabilities of all its positions.

It is trained in numpy by backpropagation through time on the words of a bounded sample: up to ``SAMPLE_DOCS``
labelled documents of the training folds, dealt evenly over the languages by a hash of doc_id and text, and of their words the
``SAMPLE_WORDS`` most frequent, again evenly.  Prediction reads the text alone.

Defined results: null text, or one without a letter, is ``und`` with score 0; so is everything when no row is
labelled; words without a letter are not read; words of over ``PIECE`` bytes are read in pieces; a null doc_id is in a
training fold; repeated rows are predicted each; ties go to the language first in order; empty tables give empty
results; further columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortloom.session import written

UNITS = 16
PIECE = 24
SAMPLE_DOCS, SAMPLE_WORDS = 4000, 16_000
EPOCHS, BATCH, RATE = 8, 128, 0.01
MEMORY_WORDS = 400_000
SHARPEST = 20  # words from which a longer text is no longer given more certainty
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2

_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteGru:
    """Weights and passes of the network; sequences of a batch have one length."""

    def __init__(self, languages: int, seed: int = 5):
        r, h = np.random.default_rng(seed), UNITS
        self.p: dict[str, np.ndarray] = {"v": r.normal(0, 0.2, (2 * h, languages)), "c": np.zeros(languages)}
        for d in "fb":
            self.p |= {f"w{d}": r.normal(0, 0.2, (256, 3 * h)), f"u{d}": r.normal(0, 0.25, (h, 3 * h)), f"b{d}": np.zeros(3 * h)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _read(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States after every position of ``x`` (in reading order), and what the way back needs."""
        w, u, b = (self.p[k + d] for k in "wub")
        h, n = np.zeros((len(x), UNITS), np.float32), UNITS
        states, steps = np.empty((x.shape[1], len(x), n), np.float32), []
        for t in range(x.shape[1]):
            given, own = w[x[:, t]] + b, h @ u
            gates = _sigmoid(given[:, : 2 * n] + own[:, : 2 * n])
            keep, reset = gates[:, :n], gates[:, n:]
            new = np.tanh(given[:, 2 * n :] + reset * own[:, 2 * n :])
            steps.append((h, keep, reset, new, own[:, 2 * n :]))
            h = keep * h + (1 - keep) * new
            states[t] = h
        return states, steps

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Log-probabilities (position, sequence, language)."""
        f, f_steps = self._read(x, "f")
        b, b_steps = self._read(x[:, ::-1], "b")
        both = np.concatenate([f, b[::-1]], axis=2)
        logits = both @ self.p["v"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), (both, f_steps, b_steps)

    def _back(self, x: np.ndarray, d: str, steps: list, d_states: np.ndarray, grads: dict) -> None:
        u, n = self.p["u" + d], UNITS
        grads["w" + d], grads["u" + d], grads["b" + d] = (np.zeros_like(self.p[k + d]) for k in "wub")
        carried = np.zeros((len(x), n), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            h, keep, reset, new, own = steps[t]
            dh = d_states[t] + carried
            d_new = dh * (1 - keep) * (1 - new * new)
            d_keep = dh * (h - new) * keep * (1 - keep)
            d_reset = d_new * own * reset * (1 - reset)
            d_given = np.concatenate([d_keep, d_reset, d_new], axis=1)
            d_own = np.concatenate([d_keep, d_reset, d_new * reset], axis=1)
            np.add.at(grads["w" + d], x[:, t], d_given)
            grads["b" + d] += d_given.sum(axis=0)
            grads["u" + d] += h.T @ d_own
            carried = dh * keep + d_own @ u.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions."""
        logp, (both, f_steps, b_steps) = self.forward(x)
        d = np.exp(logp)
        d[:, np.arange(len(y)), y] -= 1
        d /= d.shape[0] * d.shape[1]
        grads = {"v": np.einsum("tbh,tbl->hl", both, d), "c": d.sum(axis=(0, 1))}
        d_both = d @ self.p["v"].T
        self._back(x, "f", f_steps, d_both[:, :, :UNITS], grads)
        self._back(x[:, ::-1], "b", b_steps, d_both[::-1, :, UNITS:], grads)
        return grads


def _pieces(word: str) -> list[bytes]:
    data = word.encode()
    return [b" " + data[a : a + PIECE] + b" " for a in range(0, len(data), PIECE)]


def train(examples: list[tuple[str, int]], languages: int, seed: int = 5) -> ByteGru:
    """Fit the network on (word, language number) by Adam, in batches of one length."""
    net, r = ByteGru(languages, seed), np.random.default_rng(seed)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for word, y in examples:
        for piece in _pieces(word):
            by_length.setdefault(len(piece), []).append((piece, y))
    data = {n: (np.frombuffer(b"".join(p for p, _ in rows), np.uint8).reshape(-1, n), np.array([y for _, y in rows])) for n, rows in sorted(by_length.items())}
    first, second = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        batches = []
        for n, (x, y) in data.items():
            order = r.permutation(len(y))
            batches += [(n, order[a : a + BATCH]) for a in range(0, len(y), BATCH)]
        for k in r.permutation(len(batches)):
            n, rows = batches[k]
            x, y = data[n]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for name, g in net.gradients(x[rows], y[rows]).items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                net.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """Pooled outputs of words, remembered up to ``MEMORY_WORDS`` (which saves time and changes no result)."""

    def __init__(self, net: ByteGru, languages: list[str]):
        self.net, self.languages = net, languages
        self.known: dict[str, int] = {}
        self.table = np.zeros((1, len(languages) + 1))  # summed log-probabilities of a word, and its positions; row 0: no letter

    def _read(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages) + 1))
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for k, word in enumerate(words):
            for piece in _pieces(word):
                by_length.setdefault(len(piece), []).append((k, piece))
        for n, rows in by_length.items():
            for a in range(0, len(rows), 4096):
                part = rows[a : a + 4096]
                x = np.frombuffer(b"".join(p for _, p in part), np.uint8).reshape(-1, n)
                np.add.at(out, np.array([k for k, _ in part]), np.column_stack([self.net.forward(x)[0].sum(axis=0), np.full(len(part), n)]))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        counted = [Counter((t or "").split()) for t in texts]
        new = list(set().union(*counted) - self.known.keys())
        lettered = [w for w in new if _LETTER.search(w)]
        known = self.known | dict.fromkeys(new, 0)
        known.update(zip(lettered, range(len(self.table), len(self.table) + len(lettered))))
        table = np.concatenate([self.table, self._read(lettered)])
        if len(known) <= MEMORY_WORDS:
            self.known, self.table = known, table
        out = []
        for words in counted:
            at = np.fromiter((known[w] for w in words), np.int64, len(words))
            times = np.fromiter(words.values(), np.float64, len(words))
            pooled = times @ table[at] if len(words) else table[0]
            read = times[at > 0].sum()
            if not read:
                out.append((UNKNOWN, 0.0))
                continue
            logits = pooled[:-1] / pooled[-1] * min(read, SHARPEST)
            p = np.exp(logits - logits.max())
            best = int(np.argmax(p))
            out.append((self.languages[best], float(p[best] / p.sum())))
        return out


_READERS: dict[int, Reader] = {}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS, F.lit(0)) == HELD_OUT


def fit(docs: DataFrame) -> tuple[ByteGru, list[str]]:
    """The network and the languages, from the labelled rows outside the held-out fold.

    The counts of labels cover all rows; the driver gets at most ``SAMPLE_WORDS`` words.
    """
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return ByteGru(1), []
    share = SAMPLE_DOCS // len(languages) + 1
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(1 << 40)) / float(1 << 40)
    limit = F.lit(0.0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, share / n).otherwise(limit)
    sample = labelled.where(part < limit).limit(2 * SAMPLE_DOCS)
    words = sample.select("lang", F.explode(F.split("text", r"\s+")).alias("word")).where(F.col("word").rlike(r"\p{L}"))
    counts = written(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language_words")
    examples = []
    for k, lang in enumerate(languages):
        top = counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(SAMPLE_WORDS // len(languages) + 1)
        examples += [(r["word"], k) for r in top.select("word").collect()]
    return train(examples, len(languages)), languages


def predict(docs: DataFrame, net: ByteGru, languages: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``_lang`` and ``_score``."""
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(b"".join(x.tobytes() for x in net.p.values()))
        if key not in _READERS:
            _READERS.clear()  # a worker keeps the last one
            _READERS[key] = Reader(net, languages)
        reader = _READERS[key]
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                found = reader.predict(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*columns, "_lang", "_score"]
                )

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())]))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    net, languages = fit(docs)
    out = predict(docs.select("doc_id", "text"), net, languages)
    return out.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
