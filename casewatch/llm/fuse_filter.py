"""Static three-wise binary-fuse filters with one byte a key (Graf and Lemire, 2022)."""

from __future__ import annotations

import math

import numpy as np

U = np.uint64


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over key + seed."""
    h = keys + U(seed & (2**64 - 1))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> U(33))) * U(factor)
    return h ^ (h >> U(33))


def slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three slots of each hash, in three consecutive segments."""
    start = ((h >> U(32)) * U(segments * segment)) >> U(32)
    low = U(segment - 1)
    return np.stack([start, (start + U(segment)) ^ ((h >> U(18)) & low), (start + U(2 * segment)) ^ (h & low)]).astype(np.int64)


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> U(32))).astype(np.uint8)


def peel(at: np.ndarray, n_slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, slot that each has alone) in which all keys can be taken off; None if some are left."""
    n = at.shape[1]
    held = np.bincount(at.ravel(), minlength=n_slots)
    which = np.bincount(at.ravel(), np.tile(np.arange(n, dtype=np.float64), 3), n_slots)  # the key, where one is left
    rounds, taken, look = [], 0, np.flatnonzero(held == 1)
    while len(look):
        keys, first = np.unique(which[look].astype(np.int64), return_index=True)
        rounds.append((keys, look[first]))
        taken += len(keys)
        for row in at[:, keys]:
            np.subtract.at(held, row, 1)
            np.subtract.at(which, row, keys)
        look = np.unique(at[:, keys])
        look = look[held[look] == 1]
    return rounds if taken == n else None


def build(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(seed, segment length, table) over distinct 64-bit keys; about 9 to 10 bits a key for large sets."""
    n = len(keys)
    logs = math.log(max(n, 2))
    segment = 1 << max(2, min(18, int(logs / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / logs)
    for seed in range(1, 1000):
        if seed % 20 == 0:
            factor *= 1.1
        segments = max(1, math.ceil(n * factor / segment) - 2)
        h = hashed(keys, seed)
        at = slots(h, segment, segments)
        n_slots = (segments + 2) * segment
        if (rounds := peel(at, n_slots)) is None:
            continue
        table, prints = np.zeros(n_slots, np.uint8), fingerprints(h)
        for who, own in reversed(rounds):
            a, b, c = at[:, who]
            table[own] = prints[who] ^ table[a] ^ table[b] ^ table[c]  # the own slot is still 0
        return seed, segment, table.tobytes()
    raise ValueError("keys are not distinct")


def contains(keys: np.ndarray, seed: int, segment: int, table: bytes) -> np.ndarray:
    """Whether each key may be in the filter: always where it is, in about one of 256 cases where it is not."""
    cells = np.frombuffer(table, np.uint8)
    h = hashed(keys, seed)
    a, b, c = slots(h, segment, len(cells) // segment - 2)
    return fingerprints(h) == cells[a] ^ cells[b] ^ cells[c]
