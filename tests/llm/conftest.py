from __future__ import annotations

import os
import random

import pytest

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "s")]


@pytest.fixture(scope="session")
def prose():
    """Random prose: prose(n words, seed)."""

    def make(n: int, seed: int) -> str:
        r = random.Random(seed)
        return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def small():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
