"""The gap-weighted subsequence kernel, over many pairs of short strings at once."""

from __future__ import annotations

import numpy as np

#: Length of the subsequences compared, and the weight of each character that one spans.
LENGTH = 3
DECAY = 0.7
#: Pairs computed at once.
PAIRS = 1 << 15


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings, padded with zeros, and their lengths."""
    n = np.array([len(s) for s in strings], np.int64)
    out = np.zeros((len(strings), max(1, int(n.max(initial=0)))), np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), np.int32)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat
    return out, n


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kernel of each row of a with the same row of b (padded code points)."""
    decay = np.float32(DECAY)
    n, width = a.shape[1], b.shape[1]
    rows = len(a)
    # carried[p][:, j]: weight of common subsequences of length p in the prefixes so far, decayed to their ends.
    carried = [np.ones((rows, width + 1), np.float32)] + [np.zeros((rows, width + 1), np.float32) for _ in range(LENGTH - 1)]
    total = np.zeros(rows, np.float32)
    for i in range(n):
        same = ((a[:, i : i + 1] == b) & (b != 0)).astype(np.float32)
        total += decay**2 * (same * carried[LENGTH - 1][:, :-1]).sum(1)
        for p in range(LENGTH - 1, 0, -1):
            step = decay**2 * same * carried[p - 1][:, :-1]
            run = np.zeros(rows, np.float32)
            for j in range(width):
                run = decay * run + step[:, j]
                carried[p][:, j + 1] = decay * carried[p][:, j + 1] + run
    return total


def pair_sets(c: np.ndarray, reach: int) -> np.ndarray:
    """For each row of code points the ordered pairs of characters at most ``reach`` apart, as a set of 256 classes."""
    out = np.zeros((len(c), 4), np.uint64)
    rows = np.arange(len(c))
    x = c.astype(np.uint32)
    for d in range(1, min(reach, c.shape[1] - 1) + 1):
        one, two = x[:, :-d], x[:, d:]
        kind = ((one * np.uint32(2654435761) + two * np.uint32(2246822519)) >> np.uint32(13)) & np.uint32(255)
        for j in range(kind.shape[1]):
            bit = np.where(two[:, j] != 0, np.uint64(1) << (kind[:, j] & np.uint32(63)).astype(np.uint64), np.uint64(0))
            out[rows, kind[:, j] >> np.uint32(6)] |= bit
    return out


#: A string is compared with a landmark if this share of the landmark's neighbouring characters recur in it, in order
#: and with at most GAP characters put between them; otherwise their kernel counts as zero.
RECUR = 0.6
GAP = 2


def similarities(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernels (0 to 1) of strings with landmarks."""
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    if not strings or not landmarks:
        return out
    a, _ = codes(strings)
    b, _ = codes(landmarks)
    own_b = kernel(b, b)
    sets_a, sets_b = pair_sets(a, GAP + 1), pair_sets(b, 1)
    needed = np.maximum(1, np.ceil(RECUR * np.bitwise_count(sets_b).sum(1))).astype(np.int64)
    for at in range(0, len(strings), PAIRS):
        part = slice(at, at + PAIRS)
        shared = np.zeros((len(a[part]), len(landmarks)), np.int16)
        for k in range(4):
            shared += np.bitwise_count(sets_a[part, None, k] & sets_b[None, :, k])
        i, j = np.nonzero(shared >= needed)
        if not len(i):
            continue
        some, of = np.unique(i, return_inverse=True)
        own_a = kernel(a[part][some], a[part][some])
        for to in range(0, len(i), PAIRS):
            x, y = i[to : to + PAIRS], j[to : to + PAIRS]
            out[at + x, y] = kernel(a[part][x], b[y]) / np.sqrt(np.maximum(own_a[of[to : to + PAIRS]] * own_b[y], 1e-12))
    return out
