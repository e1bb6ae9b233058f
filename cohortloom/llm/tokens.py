"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Spark partitions the documents; in a task the texts are cut into pieces (a run of blanks and what follows it, which
the split pattern never crosses), each different piece is split by the pattern, and the different words not yet known
go to DuckDB as token-position rows.  A recursive query joins the rows' neighbours with the merge table, contracts the
leftmost pair of least rank of every word, and goes on until no word changes.  Decoding joins the ids with the
vocabulary and puts the bytes together by an ordered aggregation.

The merge table holds every pair of tokens whose concatenation is a token, so it follows from the rank file alone.
A word of more than ``SHORT`` bytes contracts all equal pairs of least rank at once where that cannot change the
result (no pair that arises has a rank as low), in rounds whose states are dropped every ``ROUNDS`` rounds.

Words already encoded are remembered by the worker, up to ``MEMORY_WORDS``; that saves time and never changes a result.
They and the tables go when the worker takes up a task of another operator (see ``worker``).

Defined results: null text is encoded like an empty one (no ids); special-token strings are ordinary text; repeated
rows are encoded each; empty tables give empty results; further columns are kept where a table of documents is
returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from cohortloom.llm.worker import kept

SHORT = 48
ROUNDS = 32
MEMORY_WORDS = 400_000
BATCH_CHARS = 4_000_000
DECODE_TOKENS = 500_000

#: Characters with the Unicode property White_Space (fixed values).
BLANKS = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PIECE = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")

_CONTRACT = """
WITH RECURSIVE s(round, w, i, t, ni, nt) AS (
  SELECT 0, w, i, t, ni, nt FROM start
  UNION ALL
  (WITH least AS (
     SELECT s.w, min((m.r * 65536::BIGINT + s.i) * 65536 + s.ni) AS k
     FROM s JOIN merges m ON m.a = s.t AND m.b = s.nt GROUP BY s.w),
   pair AS (
     SELECT least.w, ((k // 65536) % 65536)::INT AS i, (k % 65536)::INT AS gone, (k // 4294967296)::INT AS r, s.ni, s.nt
     FROM least JOIN s ON s.w = least.w AND s.i = k % 65536)
   SELECT s.round + 1, s.w, s.i, CASE WHEN s.i = p.i THEN p.r ELSE s.t END, CASE WHEN s.i = p.i THEN p.ni ELSE s.ni END,
          CASE WHEN s.i = p.i THEN p.nt WHEN s.ni = p.i THEN p.r ELSE s.nt END
   FROM s JOIN pair p ON s.w = p.w WHERE s.i <> p.gone)
), last AS (SELECT w, max(round) AS round FROM s GROUP BY w)
SELECT s.w, s.i, s.t FROM s JOIN last USING (w, round) ORDER BY s.w, s.i
"""

_CONTRACT_LONG = f"""
WITH RECURSIVE s(round, w, i, t) AS (
  SELECT 0, w, i, t FROM start
  UNION ALL
  (WITH p AS (
     SELECT round, w, i, t, lead(t) OVER v AS nt, lead(i) OVER v AS ni, lead(t, 2) OVER v AS nnt, lag(t) OVER v AS pt
     FROM s WINDOW v AS (PARTITION BY w ORDER BY i)),
   h AS (SELECT p.*, m.r FROM p JOIN merges m ON m.a = p.t AND m.b = p.nt QUALIFY m.r = min(m.r) OVER (PARTITION BY w)),
   g AS (SELECT *, sum(CASE WHEN touches THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY i) AS run
         FROM (SELECT *, lag(ni) OVER (PARTITION BY w ORDER BY i) = i AS touches FROM h)),
   c AS (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) AS k, row_number() OVER (PARTITION BY w ORDER BY i) AS nth FROM g),
   u AS (SELECT c.w, bool_or(coalesce(x.r <= c.r, false) OR coalesce(y.r <= c.r, false) OR coalesce(z.r <= c.r, false)) AS risky
         FROM c LEFT JOIN merges x ON x.a = c.pt AND x.b = c.r LEFT JOIN merges y ON y.a = c.r AND y.b = c.nnt
                LEFT JOIN merges z ON z.a = c.r AND z.b = c.r GROUP BY c.w),
   hit AS (SELECT c.w, c.i, c.ni AS gone, c.r FROM c JOIN u USING (w) WHERE c.k % 2 = 1 AND (c.nth = 1 OR NOT u.risky))
   SELECT s.round + 1, s.w, s.i, coalesce(hit.r, s.t)
   FROM s JOIN (SELECT DISTINCT w FROM hit) a ON a.w = s.w LEFT JOIN hit ON hit.w = s.w AND hit.i = s.i
          LEFT JOIN hit q ON q.w = s.w AND q.gone = s.i
   WHERE q.w IS NULL AND s.round < {ROUNDS})
), last AS (SELECT w, max(round) AS round FROM s GROUP BY w)
SELECT s.w, s.i, s.t, s.round FROM s JOIN last USING (w, round) ORDER BY s.w, s.i
"""

_DECODE = """
SELECT part, unhex(string_agg(h, '' ORDER BY pos)) AS data FROM ids JOIN vocabulary USING (id) GROUP BY part ORDER BY part
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Coder:
    """Encoder and decoder of one rank file, with its DuckDB tables; one in a worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        import duckdb

        self.ranks = read_ranks(rank_file)
        blanks = pattern.replace(r"[^\s", f"[^{BLANKS}").replace(r"\S", f"[^{BLANKS}]").replace(r"\s", f"[{BLANKS}]")
        self.pattern = regex.compile(blanks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        ranks, pairs = self.ranks, []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, r))
        a, b, r = (np.array(x, np.int32) for x in zip(*pairs))
        found = pa.table({"a": a, "b": b, "r": r})  # noqa: F841  DuckDB reads local tables by name
        self.db.execute("CREATE TABLE merges AS SELECT * FROM found")
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "h": [t.hex() for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")

    def _contract(self, words: list[bytes], long: bool) -> list[bytes]:
        """Ids of the words, as little-endian unsigned 32-bit integers."""
        lens = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lens)
        w = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        i = (np.arange(ends[-1]) - np.repeat(ends - lens, lens)).astype(np.int32)
        t = self.single[np.frombuffer(b"".join(words), np.uint8)]
        while long:
            start = pa.table({"w": w, "i": i, "t": t})  # noqa: F841
            out = self.db.sql(_CONTRACT_LONG).to_arrow_table()
            w, i, t = (out[c].to_numpy() for c in "wit")
            long = bool((out["round"].to_numpy() >= ROUNDS).any())
            if not long:
                break
        else:
            after = np.append(t[1:], -1).astype(np.int32)
            after[ends - 1] = -1
            start = pa.table({"w": w, "i": i, "t": t, "ni": i + np.int32(1), "nt": after})  # noqa: F841
            out = self.db.sql(_CONTRACT).to_arrow_table()
            w, t = out["w"].to_numpy(), out["t"].to_numpy()
        bounds = np.searchsorted(w, np.arange(len(words) + 1))
        ids = t.astype("<u4").tobytes()
        return [ids[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [self.ranks[w].to_bytes(4, "little") if w in self.ranks else None for w in words]
        rest = [k for k, x in enumerate(out) if x is None]
        for long in (False, True):
            part = [k for k in rest if (len(words[k]) > SHORT) == long]
            if part:
                for k, ids in zip(part, self._contract([words[k] for k in part], long)):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [_PIECE.findall(t) for t in texts]
        new = set().union(*cut) - self.known.keys()
        known = self.known
        if new:
            pieces = list(new)
            split = [self.pattern.findall(p) for p in pieces]
            words = list(set().union(*split))
            ids = dict(zip(words, self._encode_words([w.encode() for w in words])))
            found = {p: b"".join([ids[w] for w in s]) for p, s in zip(pieces, split)}
            if len(known) + len(found) <= MEMORY_WORDS:
                known.update(found)
            else:
                known = known | found
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def decode(self, coded: Iterable[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids; a long one is put together from parts."""
        parts = [(k, c[at : at + 4 * DECODE_TOKENS]) for k, c in enumerate(coded) for at in range(0, len(c), 4 * DECODE_TOKENS)]
        out: dict[int, list[bytes]] = {}
        at = 0
        while at < len(parts):
            to, size = at, 0
            while to < len(parts) and (to == at or size + len(parts[to][1]) <= 4 * DECODE_TOKENS):
                size += len(parts[to][1])
                to += 1
            token = np.frombuffer(b"".join(p for _, p in parts[at:to]), "<u4").astype(np.int32)
            part = np.repeat(np.arange(at, to, dtype=np.int32), [len(p) // 4 for _, p in parts[at:to]])
            ids = pa.table({"part": part, "pos": np.arange(len(token), dtype=np.int32), "id": token})  # noqa: F841
            for row in self.db.sql(_DECODE).to_arrow_table().to_pylist():
                out.setdefault(parts[row["part"]][0], []).append(row["data"])
            at = to
        return [b"".join(out.get(k, [])) for k in range(len(coded))]


def _coder(rank_file: bytes, pattern: str) -> Coder:
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    return kept("tokens", key, lambda: Coder(rank_file, pattern))


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` characters or tokens, or of one row."""
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _mapped(docs: DataFrame, rank_path: str, pattern: str, fields: list[T.StructField], columns) -> DataFrame:
    with open(rank_path, "rb") as f:
        rank_file = f.read()  # a fixed file of under a megabyte, sent with the tasks
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(rank_file, pattern)
        for whole in batches:
            sizes = np.array([len(t.as_py() or "") for t in whole.column(at)], np.int64)
            for batch in _parts(whole, sizes, BATCH_CHARS):
                coded = coder.encode([t or "" for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays(batch.columns + columns(coder, coded), names=[*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + fields))


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``docs`` with ``_token_ids`` (array of int)."""

    def columns(coder: Coder, coded: list[bytes]) -> list[pa.Array]:
        ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))]

    return _mapped(docs, rank_path, pattern, [T.StructField("_token_ids", T.ArrayType(T.IntegerType()))], columns)


def decode(docs: DataFrame, rank_path: str, pattern: str, column: str = "_token_ids") -> DataFrame:
    """``docs`` with ``_decoded`` (bytes of the ids in ``column``; null ids give no bytes)."""
    with open(rank_path, "rb") as f:
        rank_file = f.read()
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(rank_file, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                data = coder.decode([np.array(x.as_py() or [], "<u4").tobytes() for x in batch.column(at)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "_decoded"])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField("_decoded", T.BinaryType())]))


def token_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again."""
    fields = [T.StructField("_n_tokens", T.LongType()), T.StructField("_ids_sha256", T.StringType()), T.StructField("_decoded_sha256", T.StringType())]

    def columns(coder: Coder, coded: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(c) // 4 for c in coded], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
            pa.array([hashlib.sha256(d).hexdigest() for d in coder.decode(coded)], pa.string()),
        ]

    out = _mapped(docs.select("doc_id", "text"), rank_path, pattern, fields, columns)
    return out.selectExpr("doc_id", "_n_tokens AS n_tokens", "_ids_sha256 AS ids_sha256", "_decoded_sha256 AS decoded_sha256")
