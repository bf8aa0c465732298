"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from ._common import LOWER, UPPER

_FOLD = np.frombuffer(bytes.maketrans(UPPER.encode(), LOWER.encode()), np.uint8)
_WS = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are hashed at a time, and powers that a worker keeps: arrays of 64-bit numbers are 8 times the text.
PIECE = 1 << 18
KEPT = 1 << 20
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    out = np.ones(max(1, n), np.uint64)
    have, top = 1, base % 2**64
    with np.errstate(over="ignore"):
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * np.uint64(top)
            have += take
            top = top * top % 2**64
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    global _POWERS, _INVERSE
    if n > KEPT:
        return _power(int(_BASE), n)[:n], _power(pow(int(_BASE), -1, 2**64), n)[:n]
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS = _power(int(_BASE), size)
        _INVERSE = _power(pow(int(_BASE), -1, 2**64), size)
    return _POWERS[:n], _INVERSE[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i], times the inverse power of i, a hash of data[i:j] alone."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUE[data] * p[: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes that end before white space."""
    at = 0
    while len(text) - at > 2 * PIECE:
        end = next((m.start() for m in _WS.finditer(text, at + PIECE)), len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, number of words of each text); fold: A-Z lower-cased."""
    out, n = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        data = np.frombuffer(b" ".join([b"", *(x for _, x in held), b""]), np.uint8)
        data = _FOLD[data] if fold else data
        edge = np.diff((~_SPACE[data]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        out.append(range_hashes(prefix_hashes(data), starts, ends))
        first = np.searchsorted(starts, np.cumsum([1, *(len(x) + 1 for _, x in held)]))
        np.add.at(n, [i for i, _ in held], np.diff(first))
        held.clear()

    for i, text in enumerate(texts):
        for part in _parts(text):
            if held and size + len(part) > PIECE:
                flush()
                size = 0
            held.append((i, part))
            size += len(part) + 1
    if held:
        flush()
    return np.concatenate(out), n


def shingle_hashes(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in text order, number of shingles of each text).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than ``width`` words has its whole word
    sequence as one shingle, a text without words none.
    """
    hashes, n_words = word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(n_words)])
    n_shingles = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    if not len(hashes):
        return hashes, n_shingles
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width):
            full = mix(full + hashes[k : len(hashes) - width + 1 + k] + np.uint64(k + 1)) if len(full) else full
        owner = np.repeat(np.arange(len(texts)), n_words)
        inside = np.arange(len(hashes)) - first[owner]
        begins = np.flatnonzero(inside + width <= n_words[owner])
        out = np.zeros(int(n_shingles.sum()), np.uint64)
        at = np.cumsum(n_shingles) - n_shingles
        out[at[owner[begins]] + inside[begins]] = full[begins]
        for i in np.flatnonzero((n_words > 0) & (n_words < width)):
            h = np.zeros(1, np.uint64)
            for k in range(n_words[i]):
                h = mix(h + hashes[first[i] + k : first[i] + k + 1] + np.uint64(k + 1))
            out[at[i]] = mix(h + np.uint64(97 + n_words[i]))[0]
    return out, n_shingles
