"""Texts for the tests of this folder."""

import random

WORDS = [a + b + c for a in "tor bel kan mu ri sol fen".split() for b in "a e i o un".split() for c in "dle st m ver rik".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(texts, lang="en", source="s"):
    return [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
