"""Small tables with the cases every operator defines: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

WORDS = (
    "river garden letter bridge market window answer history silver morning engine theory pattern village museum council kitchen journey station season school library harbour valley picture method "
    "signal teacher factory surface project budget winter summer quiet narrow early simple modern careful broken painted planned measured opened carried walked showed gathered repaired"
).split()


@pytest.fixture(scope="session")
def prose():
    def make(seed: int, words: int = 120) -> str:
        r = random.Random(seed)
        return ". ".join(" ".join(r.choice(WORDS) for _ in range(12)).capitalize() for _ in range(words // 12)) + "."

    return make
