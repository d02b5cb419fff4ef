from __future__ import annotations

import random

import pytest

from relaykit.llm import bpe


@pytest.fixture(scope="session")
def ranks():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture
def chance():
    return random.Random(7)
