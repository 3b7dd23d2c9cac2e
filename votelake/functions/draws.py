"""The keyed draws of ``maths`` for tasks that make many at a time: the same numbers from the same digests, in numpy."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import md5
from math import sin

import numpy as np


def uniforms(keys: Iterable[str]) -> np.ndarray:
    """``maths.uniform`` of every text ``seed|key|...``."""
    raw = b"".join(md5(k.encode()).digest()[:8] for k in keys)
    return ((np.frombuffer(raw, ">u8") >> np.uint64(16)).astype(float) + 0.5) / 2.0**48


#: MD5's shifts and constants (RFC 1321), the longest text of one block, and texts that are digested side by side.
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(int(abs(sin(i + 1)) * 2**32)) for i in range(64)]
_BEGIN = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
ONE_BLOCK, ABREAST = 55, 1 << 16


def digests(texts: np.ndarray) -> np.ndarray:
    """MD5 of rows of bytes, all of one length: four unsigned 32-bit numbers a row, as ``maths.uniform_part`` reads them.

    Texts of one block go through the rounds side by side, several times faster
    than one call a text; longer ones are digested one by one.
    """
    n, length = texts.shape
    if length > ONE_BLOCK:
        return np.frombuffer(b"".join(md5(t.tobytes()).digest() for t in texts), ">u4").reshape(n, 4).astype(np.uint32)
    filled = length // 4 + 1
    padded = np.zeros((n, 4 * filled), np.uint8)
    padded[:, :length], padded[:, length] = texts, 128
    words = [*np.ascontiguousarray(padded.view("<u4").T), *[None] * (16 - filled)]
    if words[14] is None:
        words[14] = np.uint32(8 * length)
    else:
        words[14] = words[14] + np.uint32(8 * length)
    a, b, c, d = (np.full(n, x) for x in _BEGIN)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = 7 * i % 16
        f += a
        f += _SINES[i]
        if words[at] is not None:
            f += words[at]
        np.right_shift(f, 32 - _SHIFTS[i], out=t)
        np.left_shift(f, _SHIFTS[i], out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + y for x, y in zip((a, b, c, d), _BEGIN)], 1).byteswap()


def normals(keys: list[str]) -> np.ndarray:
    """``maths.normal`` of every text ``seed|key|...``."""
    u, v = uniforms(f"{k}|u" for k in keys), uniforms(f"{k}|v" for k in keys)
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2 * np.pi * v)


def poissons(keys: Iterable[str], most: int = 8) -> np.ndarray:
    """``maths.poisson_one`` of every text ``seed|key|...``."""
    steps, total, p = [], 0.0, 0.36787944117144233
    for k in range(most):
        total += p
        p /= k + 1
        steps.append(total)
    return np.searchsorted(np.array(steps), uniforms(keys), "left")
