"""Texts made for the tests."""

import random


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    made = ["".join(rng.choice(["ka", "lo", "mi", "ten", "sur", "ba"]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    lines = [" ".join(made[i : i + 12]) + "." for i in range(0, words, 12)]
    return "\n".join(lines)
