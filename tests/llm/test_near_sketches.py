import random

import numpy as np

from skein.llm import near_copies


def test_sketches_rule_out_pairs_without_losing_similar_ones():
    """Most pairs that only share a common passage need no texts; none that is similar is lost, however many shingles a bucket has."""
    rng, shingles = random.Random(5), near_copies.Shingles()
    kept = unlike = 0
    for size in (3, 60, 400, 60_000):
        words = [f"w{rng.randrange(size * 5)}" for _ in range(size)]
        one = shingles.of(" ".join(words).encode())
        for changed in (0, 1, size // 60, size // 25, size // 4, size // 2):
            other = list(words)
            for k in rng.sample(range(size), min(changed, size)):
                other[k] = f"x{rng.randrange(size)}"
            two = shingles.of(" ".join(other).encode())
            may = bool(near_copies.may_be_similar([near_copies.sketch(one)], [near_copies.sketch(two)])[0])
            assert may or not near_copies.similar(one, two)
            if size in (60, 400) and changed >= size // 4:
                unlike, kept = unlike + 1, kept + may
    assert unlike == 4 and not kept
    assert near_copies.sketch(np.zeros(256, np.int64)) == b"" and near_copies.may_be_similar([b""], [b"\1" * near_copies.BUCKETS])[0]
