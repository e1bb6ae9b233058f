"""BPE with word ends by dynamic programming over the prefixes of a word.

A sequence of tokens is what BPE makes of its text if and only if every two neighbours are compatible, that is, BPE
makes these two of the text of both.  So every prefix of a word has one last token: the one token ending there that is
compatible with the last token of the prefix before it.  An automaton of the vocabulary's suffixes (Aho-Corasick)
finds the tokens that end at a position, a test of the pair picks the one, and back-pointers from the end of the word give the
ids.  The work is linear in the length of the word, whatever the number of merges.

Two neighbours are incompatible if some token on the right edge of the first and some on the left edge of the second would have been merged while
both were there (``WordCoder._compatible``).

Spark partitions the documents; in a task the texts are cut at blanks, which no word crosses, and each different piece
is put in normal form (NFC, lower case by character), split into words and encoded.  Pieces and words already encoded
are remembered by the worker up to ``MEMORY_WORDS``, pairs up to ``MEMORY_PAIRS``; that saves time and never changes a result.

Defined results: null text is encoded like an empty one (no ids); strings of special tokens are recognised in the text
and become their ids; equal texts and repeated rows get equal ids; a text without blanks is one piece, of any length;
empty tables give empty results; further columns are kept where a table of documents is returned, ``_word_ids`` and
``_decoded`` are added to them; unknown ids are left out when decoding.  Characters that the Unicode tables of the ``tokenizers`` and ``regex`` libraries know
under different versions (added in 2025) may be split differently; all others are split alike.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

MEMORY_WORDS = 400_000
MEMORY_PAIRS = 1_000_000
MEMORY_CHARS = 64  # longer pieces are not remembered
BATCH_ROWS = 256
END = 256  # added to the byte that ends a word
FOREVER = 1 << 40

#: Characters with the Unicode property White_Space (fixed values).
BLANKS = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PIECE = re.compile(f"[^{BLANKS}]+")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def lower(text: str) -> str:
    """Lower case of every character by itself; the form of a sigma does not depend on its place."""
    return text.replace("Σ", "σ").lower()


class WordCoder:
    """Encoder and decoder of one tokenizer file of this kind."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("not a BPE tokenizer with word ends, without decoder and post-processor")
        forms = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if forms != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normal form {forms}")
        vocabulary = model["vocab"]
        letters = byte_letters()
        split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], bytes_["type"], bytes_["use_regex"], bytes_["add_prefix_space"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError("unknown way of splitting into words")
        pattern = split["pattern"]["Regex"].replace(r"[^\s", f"[^{BLANKS}")
        self.words = regex.compile(pattern)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_ids = special
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

        # tokens by id: symbols (bytes, the last of a word with END added), parts, and the merge that makes them
        size = 1 + max([*vocabulary.values(), *special.values()])
        symbols: list[str] = [""] * size
        self.left, self.right = array("i", [-1]) * size, array("i", [-1]) * size
        self.made = array("q", [-1]) * size  # rank of the merge; single symbols are there from the start
        for letter, byte in letters.items():
            for text, symbol in ((letter, byte), (letter + suffix, byte + END)):
                if text in vocabulary:
                    symbols[vocabulary[text]] = chr(symbol)
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merges[i << 20 | j] = rank
            if symbols[k] or not symbols[i] or not symbols[j]:
                raise ValueError(f"token {a + b} is made in two ways, or of unknown parts")
            symbols[k], self.left[k], self.right[k], self.made[k] = symbols[i] + symbols[j], i, j, rank
        self.pairs: dict[int, bool] = {}
        self.automaton, self.whole = ahocorasick.Automaton(), {}
        usable = [False] * size
        for k in sorted(range(size), key=self.made.__getitem__):  # parts before what is made of them
            if not symbols[k]:
                continue
            i, j = self.left[k], self.right[k]
            usable[k] = i < 0 or (usable[i] and usable[j] and self._compatible(i, j, self.made[k]))
            if usable[k]:  # BPE makes this one token of its text
                self.automaton.add_word(symbols[k], (k, len(symbols[k])))
                self.whole[symbols[k]] = k.to_bytes(4, "little")
        self.automaton.make_automaton()
        self.shown = [""] * size
        for text, k in [*vocabulary.items(), *special.items()]:
            self.shown[k] = text
        self.decimal = [str(k) for k in range(size)]
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    def _compatible(self, a: int, b: int, until: int = FOREVER) -> bool:
        """Does BPE make the tokens a and b of the text of both (before the merge of rank ``until``)?

        The right edge of a was once a single symbol, which merges turned into longer and longer edges; likewise the
        left edge of b.  Walking both back in time passes all pairs that were neighbours at some time.  The pair's own merge would have
        come first if its rank is below those that ended its parts; of equal ranks the one further left wins.
        """
        merges, made, left, right = self.merges, self.made, self.left, self.right
        end_a = end_b = until
        while True:
            rank = merges.get(a << 20 | b)
            if rank is not None and rank < end_a and (rank <= end_b if end_b < until else rank < end_b):
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                end_a, a = made[a], right[a]
            elif made[b] > made[a]:
                end_b, b = made[b], left[b]
            else:  # both made by one merge; the one further left came first, so the older state is that of b
                end_b, b = made[b], left[b]

    def encode_word(self, word: str) -> bytes:
        """Ids of a word of normal form, as little-endian unsigned 32-bit integers."""
        data = word.encode()
        symbols = data[:-1].decode("latin-1") + chr(data[-1] + END)
        if symbols in self.whole:  # one token, the last of the whole word
            return self.whole[symbols]
        last, before = array("i", [-1]) * len(data), array("i", [0]) * len(data)
        pairs, compatible, found = self.pairs, self._compatible, -1
        for end, (token, length) in self.automaton.iter(symbols):  # end is the place of the token's last symbol
            if end == found:
                continue
            start = end - length
            if start >= 0:
                key = last[start] << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= MEMORY_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = compatible(last[start], token)
                if not fits:
                    continue
            last[end], before[end], found = token, start, end
        at, ids = len(data) - 1, array("I")
        while at >= 0:
            ids.append(last[at])
            at = before[at]
        ids.reverse()
        return ids.tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        if self.special and "<" in piece:
            parts = self.special.split(piece)
        else:
            parts = [piece]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special_ids[part].to_bytes(4, "little"))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            for word in self.words.findall(lower(part)):
                ids = self.known_words.get(word)
                if ids is None:
                    ids = self.encode_word(word)
                    if len(word) <= MEMORY_CHARS and len(self.known_words) < MEMORY_WORDS:
                        self.known_words[word] = ids
                out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for piece in _PIECE.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self._encode_piece(piece)
                if len(piece) <= MEMORY_CHARS and len(known) < MEMORY_WORDS:
                    known[piece] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: list[int]) -> str:
        """The tokens as the vocabulary writes them, with one blank between; the file names no decoder."""
        shown = self.shown
        size = len(shown)
        return " ".join([shown[k] for k in ids if 0 <= k < size and shown[k]])


_CODERS: dict[str, WordCoder] = {}


def coder_of(file: bytes) -> WordCoder:
    """The coder of a file; a worker keeps the last one."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = WordCoder(file)
    return _CODERS[key]


def _mapped(docs: DataFrame, path: str, column: str, fields: list[T.StructField], columns: Callable[[WordCoder, list], list[pa.Array]]) -> DataFrame:
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of a few megabytes
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(file.value)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays(batch.columns + columns(coder, batch.column(at).to_pylist()), names=[*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + fields))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``_word_ids`` (array of int)."""

    def columns(coder: WordCoder, texts: list) -> list[pa.Array]:
        coded = [coder.encode(t or "") for t in texts]
        ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "<u4"), *coded]).astype(np.int32)))]

    return _mapped(docs, path, "text", [T.StructField("_word_ids", T.ArrayType(T.IntegerType()))], columns)


def decode(docs: DataFrame, path: str, column: str = "_word_ids") -> DataFrame:
    """``docs`` with ``_decoded``, the text of the ids in ``column`` (null ids give an empty text)."""

    def columns(coder: WordCoder, ids: list) -> list[pa.Array]:
        return [pa.array([coder.decode([k for k in x or [] if k is not None]) for x in ids], pa.string())]

    return _mapped(docs, path, column, [T.StructField("_decoded", T.StringType())], columns)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again."""
    fields = [T.StructField("_n_tokens", T.LongType()), T.StructField("_ids_sha256", T.StringType()), T.StructField("_decoded_sha256", T.StringType())]

    def columns(coder: WordCoder, texts: list) -> list[pa.Array]:
        n, ids_sha, decoded_sha = [], [], []
        for text in texts:
            ids = coder.encode(text or "").tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]

    out = _mapped(docs.select("doc_id", "text"), path, "text", fields, columns)
    return out.selectExpr("doc_id", "_n_tokens AS n_tokens", "_ids_sha256 AS ids_sha256", "_decoded_sha256 AS decoded_sha256")
