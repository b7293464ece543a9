"""Made-up prose for tests."""

import random

VOCABULARY = "river stone light green winter garden paper silver quiet morning window bridge summer market letter harbour".split()


def prose(seed: int, n: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + (f"{rng.randrange(99)}" if rng.random() < 0.2 else "") for _ in range(n))
