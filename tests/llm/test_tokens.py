import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from cohortloom.llm import tokens

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return tokens.Coder(open(PATH, "rb").read(), PATTERN)


def _texts():
    rng = random.Random(3)
    odd = [32, 10, 9, 0x301, 0x41, 0x5D0, 0x1F600, 0x37, 0x2E, 0x85, 0xA0, 0x1C, 0x200B, 0x3000]
    return [
        "", " ", "a" * 2000, "ab" * 700, "hello  world\n\n  x\x1c\x1d y\x85z", "<|endoftext|> hi", "don't we'll I'VE 123456789 ½ⅷ",
        "x" * 49 + "y" * 49, "=-" * 400 + "-" * 333, "日本語" * 100, "\x00\x00 \x00",
        "".join(rng.choice("abcdefghij ") for _ in range(3000)), "".join(rng.choice("abcdefgh") for _ in range(400)),
        "".join(chr(rng.choice(odd)) for _ in range(4000)),
    ]


def test_same_ids_as_the_library(library, coder):
    texts = _texts()
    for text, ids in zip(texts, coder.encode(texts)):
        want = library.encode_ordinary(text)
        assert ids == b"".join(i.to_bytes(4, "little") for i in want), text[:40]


def test_decoding_restores_the_bytes(coder, monkeypatch):
    texts = _texts()
    assert coder.decode(coder.encode(texts)) == [t.encode() for t in texts]
    monkeypatch.setattr(tokens, "DECODE_TOKENS", 7)  # long documents are put together from parts
    assert coder.decode(coder.encode(texts)) == [t.encode() for t in texts]


def test_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 3)
    small = tokens.Coder(open(PATH, "rb").read(), PATTERN)
    for text in ["one two three", "two three four five", "one one"]:
        assert small.encode([text])[0] == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text))


def test_report(docs, rows, none, library):
    got = tokens.token_digests(docs, PATH, PATTERN).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.token_digests(none, PATH, PATTERN).count() == 0


def test_tables_of_ids(docs, rows):
    coded = tokens.encode(docs, PATH, PATTERN)
    back = tokens.decode(coded, PATH, PATTERN)
    assert back.columns == [*docs.columns, "_token_ids", "_decoded"]
    assert sorted(((r["text"] or "").encode(), bytes(r["_decoded"])) for r in back.collect()) == sorted(((r[1] or "").encode(), (r[1] or "").encode()) for r in rows)
