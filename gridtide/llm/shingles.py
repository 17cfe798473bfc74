"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the hashes.
_POWER = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.Philox(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[np.frombuffer(_LOWER, np.uint8)]
_STEP = np.random.Generator(np.random.Philox(21)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _POWER), ("_inverses", pow(_POWER, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (runs of non-blanks, A-Z as a-z), and each text's number of words."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends_of_text = np.cumsum([len(x) + 1 for x in texts]) if texts else np.zeros(0, np.int64)
    inside = ~_BLANK[data]
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = change[::2], change[1::2]
    _grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * _powers[: len(data)], out=total[1:])
    words = _mixed((total[ends] - total[starts]) * _inverses[starts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends_of_text)]))
    return words, counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, sorted; with fewer words the whole sequence is the only one."""
    words, counts = word_hashes(texts)
    if len(words) >= k:
        n = len(words) - k + 1
        rolled = np.zeros(n, np.uint64)
        for i in range(k):
            rolled += words[i : i + n] * _STEP[i]
        rolled = _mixed(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(rolled[at : at + c - k + 1]))
        elif c:
            out.append(_mixed((words[at : at + c] * _STEP[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signature_steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.Philox(22))
    return draw.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash values (uint32), a row for each set that isn't empty."""
    sets = [x for x in sets if len(x)]
    out = np.empty((len(sets), n), np.uint32)
    if sets:
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        times, plus = signature_steps(n)
        for j in range(n):
            values = ((flat * times[j] + plus[j]) >> np.uint64(32)).astype(np.uint32)
            out[:, j] = np.minimum.reduceat(values, starts)
    return out
