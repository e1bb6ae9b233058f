"""BPE with word ends against the tokenizers library, which is only used here."""

import hashlib
import random

import public_tokenizers
import pytest

from cohortloom.llm import wordpieces as W

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as f:
        return W.WordCoder(f.read())


def test_random_texts(coder, library):
    rng = random.Random(3)
    for letters in ("ab", "aab' ", "thinganreoxlmstvw", "Σσςİıéßﬁ ́̂e", "<|endoftext|>startof ", "0123²½ⅷ'sS", "日本語字的 的　 ", "\x1c\x85\x0b !?.,-"):
        for _ in range(400):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
            text += rng.choice(["", "", "<|endoftext|>" + text, "'ve they'Re"])
            ids = library.encode(text, add_special_tokens=False).ids
            assert coder.encode(text).tolist() == ids, text
            assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_letter_of_the_basic_plane(coder, library):
    """Characters whose tables differ between the libraries' Unicode versions are the only ones that may differ."""
    wrong = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and coder.encode(f"a{chr(c)}b").tolist() != library.encode(f"a{chr(c)}b", add_special_tokens=False).ids]
    import unicodedata

    assert len(wrong) < 40 and all(unicodedata.category(chr(c)) == "Cn" for c in wrong)  # not assigned in Unicode 15


def test_long_words(coder, library):
    rng = random.Random(4)
    for text in ("x" * 300_000, "".join(rng.choice("abcdefghij") for _ in range(60_000)), "ab" * 50_000):
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_does_not_change_results(coder, monkeypatch):
    monkeypatch.setattr(W, "MEMORY_WORDS", 3)
    monkeypatch.setattr(W, "MEMORY_PAIRS", 2)
    with open(PATH, "rb") as f:
        small = W.WordCoder(f.read())
    text = "several words, unheardof wordforms and several wordforms again"
    assert small.encode(text).tolist() == coder.encode(text).tolist() == small.encode(text).tolist()


def test_documents(docs, rows, library):
    found = sorted((tuple(r) for r in W.token_digests(docs, PATH).collect()), key=str)
    expected = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert found == sorted(expected, key=str)


def test_round_trip_keeps_columns(docs, rows, library):
    coded = W.decode(W.encode(docs.withColumnRenamed("copy", "ids"), PATH), PATH)
    assert coded.columns == [*docs.withColumnRenamed("copy", "ids").columns, "_word_ids", "_decoded"]
    for r in coded.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["_word_ids"] == ids and r["_decoded"] == library.decode(ids, skip_special_tokens=False)


def test_nothing(none):
    assert W.token_digests(none, PATH).collect() == []


def test_other_files_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        W.WordCoder(f.read())
