import weakref
from types import SimpleNamespace

import public_tokenizers
import pytest

from cohortloom.llm import blocks as B, quality, tokens

PATTERN = public_tokenizers.PATTERN


class Frame:
    """Stands for a DataFrame; gives back what a task would run."""

    schema = SimpleNamespace(fields=[])
    columns = ["block", "payload", "text"]

    def mapInArrow(self, fn, schema):
        return fn


def _quality():
    return quality._with_stats(Frame())


def _block():
    blocks = object.__new__(B.Blocks)
    blocks.spark, blocks.name = SimpleNamespace(table=lambda name: Frame()), "blocks"
    return blocks.map(None, "x long")


@pytest.mark.parametrize("other", [_quality, _block])
def test_a_worker_lets_the_coder_go_when_it_takes_up_other_work(other):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    coder = weakref.ref(tokens._coder(ranks, PATTERN))
    assert tokens._coder(ranks, PATTERN) is coder()  # kept for later tasks of its own
    assert list(other()(iter([]))) == []
    assert coder() is None
    assert tokens._coder(ranks, PATTERN).encode(["a b"])  # made again
