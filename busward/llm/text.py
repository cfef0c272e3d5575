"""Word and shingle arithmetic on NumPy arrays, for use inside tasks."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import xxhash

# Only these bytes separate words; other Unicode spaces belong to words.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Of terms, all other ASCII characters than letters and digits separate.
_TERMS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_IS_BLANK = np.isin(np.arange(256), list(BLANKS))
#: Masks of the first 0 to 8 bytes of a little-endian long.
_FRONT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed eight at a time for all words together; what is beyond goes word by word.
_FAR = 512
_TOGETHER = 1 << 19


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8; bytes.split() parts at exactly the six BLANKS."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII in UTF-8, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of `words_of` of all texts in a row, and where each text's words begin (one more than texts).

    Words of all texts are hashed together, eight bytes in each pass, so that none becomes an object of its own.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begin[1:])
    data = b" ".join(parts).translate(_LOWER) + b" " * 9
    blank = _IS_BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = edges if blank[0] else np.concatenate([[0], edges])
    at, length = edges[::2], edges[1::2] - edges[::2]
    longs = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mixed((longs[at] & _FRONT[np.minimum(length, 8)]) + length.astype(np.uint64) * _MULTIPLIER)
    more, done = np.flatnonzero(length > 8), 8
    while len(more) and done < _FAR:
        rest = length[more] - done
        out[more] = mixed(out[more] * _MULTIPLIER + (longs[at[more] + done] & _FRONT[np.minimum(rest, 8)]))
        more, done = more[rest > 8], done + 8
    if len(more):
        far = [xxhash.xxh3_64_intdigest(data[a + _FAR : a + n]) for a, n in zip(at[more].tolist(), length[more].tolist(), strict=True)]
        out[more] = mixed(out[more] * _MULTIPLIER + np.array(far, np.uint64))
    return out, np.searchsorted(at, begin)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` words, in text order; fewer words are one run, none is empty."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = out * _MULTIPLIER + hashes[k : k + n]
    return mixed(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique takes four times as long."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_sets(texts: Iterable[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct window hashes of its words; texts of about _TOGETHER characters are hashed at once."""
    texts = list(texts)
    ends = np.cumsum([len(t or "") + 1 for t in texts]) // _TOGETHER
    for _, run in itertools.groupby(range(len(texts)), key=ends.__getitem__):
        run = list(run)
        hashes, begin = word_hashes(texts[run[0] : run[-1] + 1])
        whole = windows(hashes, width) if len(hashes) >= width else hashes
        for a, b in itertools.pairwise(begin.tolist()):
            yield distinct(whole[a : b - width + 1] if b - a >= width else windows(hashes[a:b], width))


def batched(arrays: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated arrays with their offsets, one more than the arrays."""
    arrays = list(arrays)
    offsets = np.zeros(len(arrays) + 1, np.int64)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return (np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)), offsets
