"""Words of whole texts as numpy arrays: positions, hashes and windows, many texts at a time.

A word is a run of bytes outside space and 0x09-0x0D. Its hash is a polynomial in random 64-bit
values of its bytes, taken from one running sum over the whole batch, so that a batch costs a few
passes over its bytes whatever its words are. All arithmetic wraps at 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ODD = _RANDOM.integers(2**62, 2**63, 4, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a run of letters: A-Z, a-z and whatever is not ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
#: A batch of texts is cut into pieces of about so many bytes, so that memory does not follow the batch.
PIECE_BYTES = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, at least ``size`` of them."""
    known = _POWERS.get("base")
    if known is None or len(known) < size:
        length = max(size, PIECE_BYTES)
        with np.errstate(over="ignore"):
            for name, base in (("base", _BASE), ("inverse", pow(_BASE, -1, 2**64))):
                steps = np.full(length, base, dtype=np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["base"], _POWERS["inverse"]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values: odd products, and the upper half folded on the lower."""
    half = np.uint64(32)
    with np.errstate(over="ignore"):
        out = values * _ODD[0]
        for factor in _ODD[1:]:
            out ^= out >> half
            out *= factor
        out ^= out >> half
    return out


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts and the offsets of each (nulls are empty)."""
    texts = texts.cast(pa.large_binary()) if len(texts) else pa.array([], pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int]]:
    """Cut an array of texts into ranges of about PIECE_BYTES; a longer text is a range of its own."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, length in enumerate(lengths):
        if held and held + length > PIECE_BYTES:
            yield start, at
            start, held = at, 0
        held += int(length)
    if start < len(lengths):
        yield start, len(lengths)


def words(
    texts: pa.Array, fold: bool = False, letters: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the number of words before each text, and where each word starts and ends.

    ``fold`` takes A-Z as a-z; ``letters`` takes runs of letters for words. Entry i of the counts is
    the number of words before text i, with the total at the end.
    """
    data, offsets = utf8(texts)
    space = ~LETTER[data] if letters else _SPACE[data]
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[:-1] = ~space
    inside[-1] = False
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins = inside[:-1].copy()
    begins[1:] &= space[:-1]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    ends_at = inside[:-1] & ~inside[1:]
    ends_at[edge - 1] = inside[edge - 1]
    ends = np.flatnonzero(ends_at) + 1
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        running = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[data] * power[: len(data)], out=running[1:])
        hashes = mix((running[ends] - running[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, offsets), starts, ends


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hashes of ranges of one batch: of its bytes, or of 64-bit values such as word hashes."""
    if values.dtype == np.uint8:
        values = (_FOLDED if fold else _BYTE)[values]
    power, inverse = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        running = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * power[: len(values)], out=running[1:])
        return mix((running[ends] - running[starts]) * inverse[starts])


def windows(hashes: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` words in a row within a text, and the number of them before each text.

    A text with fewer words, but at least one, has its whole sequence as one window.
    """
    counts = np.diff(before)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
    if not len(hashes):
        return hashes, first
    at = np.arange(first[-1]) - np.repeat(first[:-1] - before[:-1], number)
    ends = np.repeat(before[1:], number)
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), dtype=np.uint64)
        for step in range(size):
            inside = at + step
            held = np.where(inside < ends, hashes[np.minimum(inside, len(hashes) - 1)], np.uint64(0))
            out = mix(out * np.uint64(_BASE) + held)
    return out, first
