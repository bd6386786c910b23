"""Words and their 64-bit hashes for a slice of documents at once, in numpy and Arrow.

Words are told apart exactly (Arrow's dictionary), and each distinct one is hashed by BLAKE2b; windows of words
are hashed from their words' hashes. Texts are looked at in blocks that end between words, so a text of any length takes
some bytes a word besides itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes that are looked at together.
BLOCK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_LAG = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
#: The white space of every contract here: space and \t \n \v \f \r.
WHITE = b" \t\n\x0b\x0c\r"
SPACE = np.zeros(256, bool)
SPACE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Hashes of short words met before; emptied when full, so a worker keeps some 40 MB at most.
_known: dict[bytes, bytes] = {}
_KNOWN_WORDS, _KNOWN_BYTES = 1 << 18, 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets in them, first document): whole documents up to `most` bytes, or part of a longer one.

    A longer one is cut at places that rest on itself alone, so what is summed over blocks doesn't depend on its neighbours.
    """
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1, row + 1)
        a, z = int(offsets[row]), int(offsets[end])
        if z - a <= most:
            yield data[a:z], offsets[row : end + 1] - a, row
        else:
            while a < z:
                b = _word_end(data, min(a + most, z), z)
                yield data[a:b], np.array([0, b - a]), row
                a = b
        row = end


def _word_end(data: np.ndarray, at: int, stop: int) -> int:
    while at < stop:
        some = np.flatnonzero(SPACE[data[at : min(at + (1 << 16), stop)]])
        if len(some):
            return at + int(some[0])
        at += 1 << 16
    return stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of bytes that aren't white space."""
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= SPACE[data[:-1]]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]  # a document's edge parts words even where no space stands
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    doc = (np.searchsorted(offsets, start, side="right") - 1).astype(np.int32)
    packed = data[solid]
    edge = np.empty(len(start) + 1, np.int32)
    edge[:-1] = np.cumsum(solid, dtype=np.int32)[start] - 1
    edge[-1] = len(packed)
    told = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(packed)]).dictionary_encode()
    return np.frombuffer(b"".join(map(word_hash, told.dictionary.to_pylist())), np.uint64)[told.indices.to_numpy()], doc


def word_hash(word: bytes) -> bytes:
    out = _known.get(word)
    if out is None:
        out = blake2b(word, digest_size=8).digest()
        if len(word) <= _KNOWN_BYTES:
            if len(_known) >= _KNOWN_WORDS:
                _known.clear()
            _known[word] = out
    return out


def grams(word: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows and the index of each one's first word."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(word) - n + 1
    out = word[:last] * _LAG[0]
    for k in range(1, n):
        out = out + word[k : k + last] * _LAG[k]
    first = np.flatnonzero(doc[:last] == doc[n - 1 :])
    return mix(out[first] + _U(n)), first


def windows(parts: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, document and place (counted from the first word of all) of the n-word windows, for words that come in parts; a window may reach into the next."""
    word, doc, at = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
    for more, of in parts:
        word, doc = np.concatenate([word, more]), np.concatenate([doc, of])
        key, first = grams(word, doc, n)
        yield key, doc[first], first + at
        gone = max(len(word) - n + 1, 0)
        at += gone
        word, doc = word[gone:], doc[gone:]


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags (one for each byte) between the offsets."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(flags.view(np.uint8), offsets[:-1][full], dtype=np.int64)
    return out


def repeated(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which (document, key) pairs stand there more than once."""
    both = mix(key ^ (doc.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    ranked = np.sort(both)
    many = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    del ranked
    if not len(many):
        return np.zeros(len(key), bool)
    return many[np.minimum(np.searchsorted(many, both), len(many) - 1)] == both
