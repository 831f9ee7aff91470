"""Word shingles of many texts at once, as 64-bit hashes, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes after lower-casing A-Z; all six separators
are single bytes, so bytes and code points split alike. A text's shingle set holds the hashes of its
distinct runs of ``width`` words; a text with fewer words has one shingle, the whole sequence, and a
text without words (or null) has none. Work is done over the joined bytes of a batch, so the cost a
byte doesn't depend on how the bytes are dealt to texts.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
#: Bytes that are worked on at once, about.
PIECE = 1 << 20
#: The separators of words.
BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_SEED = np.random.default_rng(20240607)
#: Random odd multipliers and byte values: fixed, so that hashes agree between executors.
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = _SEED.integers(1, 2**63, 16, dtype=np.uint64) | _U(1)
_POWER = (_SEED.integers(1, 2**60, dtype=np.uint64) << _U(3)) | _U(5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1 << 16, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the base, kept between calls."""
    global _POWERS
    if n > len(_POWERS) or _POWERS[1] != _POWER:
        size = max(n, len(_POWERS))
        out = np.full(size, _POWER, dtype=np.uint64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (shifts and odd multipliers)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pieces(raw: bytes):
    """Parts of a text's bytes of about PIECE, cut at a separator; a longer word stays whole."""
    at = 0
    while len(raw) - at > PIECE:
        cut = max(raw.rfind(c, at + 1, at + PIECE) for c in BLANKS)
        if cut <= at:
            after = [k for c in BLANKS if (k := raw.find(c, at + PIECE)) >= 0]
            if not after:
                break
            cut = min(after)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text) for a list of texts, nulls as empty.

    Work arrays are bounded: texts are joined up to PIECE bytes, and longer ones are taken in parts.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        found, n = _joined_hashes(parts)
        hashes.append(found)
        np.add.at(counts, owners, n)
        parts.clear()
        owners.clear()
        held = 0

    for k, t in enumerate(texts):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        for part in pieces(raw) if len(raw) > PIECE else (raw,):
            if parts and held + len(part) > PIECE:
                flush()
            parts.append(part)
            owners.append(k)
            held += len(part)
    if parts:
        flush()
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), counts


def _joined_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    joined = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.cumsum(sizes + 1)
    data = _LOWER[joined]
    solid = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid)).view(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(raw), np.int64)
    lengths = stops - starts
    at = np.flatnonzero(solid)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.arange(len(at)) - np.repeat(first, lengths)
    value = _BYTE[data[at]] * _powers(int(lengths.max()))[inside]
    hashes = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    return hashes, counts


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    if len(words) >= width:
        rolled = words[: len(words) - width + 1] * _STEP[0]
        for k in range(1, width):
            rolled = rolled + words[k : len(words) - width + 1 + k] * _STEP[k]
        rolled = mix(rolled)
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            run = _U(n)
            for k in range(n):
                run = run + words[at + k : at + k + 1] * _STEP[8 + k % 8]
            out.append(mix(run))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that identify a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def batches(texts: list, most_bytes: int):
    """Ranges of texts of at most most_bytes each (or one longer text), so that memory stays bounded."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if held + n > most_bytes and k > start:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
