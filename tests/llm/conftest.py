from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in "ka lo mi ne pu ra si to vu we".split() for b in "b d f g k l m n".split()]


@pytest.fixture(scope="session")
def prose():
    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def messy_rows(prose):
    """Nulls, empty and long texts, repeated rows and keys, odd characters; then columns whose names operators use themselves."""
    base = prose(1, 120)
    texts = [None, "", "   ", "\n\t", "one", "a b c", base, base, base.upper(), base + " tail", "x" * 5000, prose(2, 20000), "é ▁ 𠮷\x00ß",
             base.replace(" ", "  \n"), prose(3, 60), prose(3, 60) + " " + prose(4, 3)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [(None, base, "en", "s0"), (None, None, None, None), (6, base, "en", "s0"), (6, base, "en", "s0"), (-3, prose(5, 40), "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    clash = "row long, block int, size long, key long, score double, shard int, token long, comp long, arc int, target double, kept boolean, " \
            "_row long, _id string, _hash long, due double, _due int, _score string, evidence int, held_out string, text_hash long, _0 int"
    own = (*range(4), 0.5, 1, 2, 3, 4, 0.1, True, 5, "6", 7, 0.8, 9, "x", 10, "y", 11, 12)
    return spark.createDataFrame([(*r, *own) for r in messy_rows],
                                 f"doc_id long, text string, lang string, source string, {clash}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
