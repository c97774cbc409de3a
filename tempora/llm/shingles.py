"""Words of a text as 64-bit hashes, and hashes of runs of words; all in whole arrays."""

from __future__ import annotations

import sys
import types

import numpy as np

from tempora.llm.common import ship

ship(__name__)

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1


def _tables() -> dict:
    """Tables that a worker process makes once: which code points belong to words, powers of _P and of its inverse."""
    kept = sys.modules.setdefault("_tempora_shingles", types.ModuleType("_tempora_shingles")).__dict__
    if "word" not in kept:
        kept["word"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        kept["up"] = kept["down"] = np.ones(1, np.uint64)
    return kept


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a text: runs of letters and digits, compared without case.

    Starts and ends are character positions in the text.
    """
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = (text or "").lower()
    if len(low) == len(cp):
        cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = _tables()
    if len(t["up"]) <= len(cp):
        n = 1 << int(len(cp) + 1).bit_length()
        t["up"], t["down"] = _powers(_P, n), _powers(pow(_P, -1, 1 << 64), n)
    inside = np.zeros(len(cp) + 2, np.int8)
    inside[1:-1] = t["word"][cp]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * t["up"][: len(cp)], out=total[1:])
    return mix((total[ends] - total[starts]) * t["down"][starts]), starts, ends


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; a shorter text is one run, an empty one has none."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    h = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - k + 1 + i]
    return mix(h + np.uint64(k))
