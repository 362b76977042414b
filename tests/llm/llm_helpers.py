"""Invented texts for the tests."""

import random


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 7))) for _ in range(n)]
    return " ".join(words)


def edited(text: str, seed: int, share: float) -> str:
    """Some words replaced."""
    draw = random.Random(seed)
    return " ".join(f"new{seed}x{i}" if draw.random() < share else w for i, w in enumerate(text.split(" ")))
