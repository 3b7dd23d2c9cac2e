"""Digests made side by side are those of hashlib, and permutation counts those of plain draws."""

from hashlib import md5

import numpy as np
import pytest

from votelake.functions import draws
from votelake.operators import spatial


@pytest.mark.parametrize("length", [0, 1, 3, 4, 20, 51, 52, 55, 56, 70])
def test_digests_are_md5(length):
    texts = np.random.default_rng(length).integers(0, 256, (9, length), dtype=np.uint8)
    want = np.frombuffer(b"".join(md5(t.tobytes()).digest() for t in texts), ">u4").reshape(9, 4)
    assert (draws.digests(texts) == want).all()


@pytest.mark.parametrize("star", [False, True])
@pytest.mark.parametrize("deg, perms", [(1, 999), (4, 100), (5, 1001), (45, 12)])
def test_permuted_counts_of_several_nodes(star, deg, perms):
    values = np.random.default_rng(1).normal(size=50)
    src, z, stat = ["123", "-45", "777"], np.array([0.5, -1.0, 2.0]), np.array([0.1, 0.0, -0.2])
    above, below = spatial._permuted(values, perms, 7, star, src, z, stat, deg)
    for i, s in enumerate(src):
        a = b = 0
        for perm in range(perms):
            raw = b"".join(md5(f"7|{perm}|{s}|{four}".encode()).digest() for four in range((deg + 3) // 4))
            drawn = values[np.floor((np.frombuffer(raw, ">u4")[:deg] + 0.5) / 2.0**32 * 50).astype(int)]
            if star:
                drawn[0] = z[i]
            made = drawn.sum() / deg if star else z[i] * (drawn.sum() / deg)
            a, b = a + (made >= stat[i]), b + (made <= stat[i])
        assert (above[i], below[i]) == (a, b)
