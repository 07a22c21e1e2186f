"""Vectorised word hashing over a block of texts (numpy, used inside tasks).

A block is a list of UTF-8 texts laid end to end.  Word boundaries come from a
byte class table and word hashes from one prefix sum, so no Python object is
made per word.  All classes used by the operators are unions of ASCII classes
and "every byte above 0x7F", so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)          # odd, hence invertible modulo 2**64
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# byte classes: words of letters/digits (op 4 and the shingles), and runs of
# anything but ASCII white space (op 9)
ALNUM = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
NONSPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
# A-Z to a-z
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a bijection on 64-bit integers)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    key = "inv" if inverse else "fwd"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        p = np.full(m, _BASE_INV if inverse else _BASE, dtype=_U)
        p[0] = 1
        have = _POWERS[key] = np.cumprod(p, dtype=_U)
    return have[:n]


def words(texts: list[bytes], table: np.ndarray, lower: bool = True):
    """Hashes of the words of every text, in order.

    Returns ``(hashes, doc, starts, ends)``: one entry per word, ``doc`` the
    index of its text, ``starts``/``ends`` byte offsets in the joined block.
    """
    sep = b" "                           # in neither class
    buf = np.frombuffer(sep.join(texts) + sep, dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    inside = table[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    lens = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.cumsum(lens)
    doc = np.searchsorted(bounds, starts, side="right")
    if not len(starts):
        return np.zeros(0, _U), doc, starts, ends
    prefix = np.zeros(len(buf) + 1, dtype=_U)
    np.multiply(_BYTE[buf], _powers(len(buf), False), out=prefix[1:])
    np.cumsum(prefix, dtype=_U, out=prefix)
    h = (prefix[ends] - prefix[starts]) * _powers(len(buf), True)[starts]
    return mix(h ^ (ends - starts).astype(_U)), doc, starts, ends


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-aware hashes of every ``n`` consecutive entries."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, dtype=_U)
    for i in range(n):
        out = mix(out * _BASE + hashes[i:i + m])
    return out
