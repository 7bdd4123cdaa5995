"""Words and shingles of Arrow batches, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def string_array(column) -> pa.Array:
    """One large_string array without nulls. Slices are copied first: their
    cast to long offsets has been seen to go wrong."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.offset:
        column = column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(column.cast(pa.large_string()), "")


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in one array, and the place where each text's begin
    (one more than texts). A word is a run of bytes but 0x20 and 0x09 to 0x0D."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        flat = flat.filter(pa.array(real))
    return flat, ends


def coded(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of the words, and the distinct words."""
    if not len(flat):
        return np.zeros(0, np.int64), []
    d = flat.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.to_pylist()


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    flat, ends = words(texts, lower)
    codes, distinct = coded(flat)
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct))
    return table[codes] if len(distinct) else np.zeros(0, np.uint64), ends


def shingle_hashes(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the k words from each place on; the last k-1 places have none."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mixed(out)


def shingle_sets(hashes: np.ndarray, ends: np.ndarray, k: int = 5):
    """The sorted set of each text's shingle hashes; of fewer than k words the
    whole sequence is one shingle, no words give the empty set."""
    all_ = shingle_hashes(hashes, k)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= k:
            yield np.unique(all_[a : b - k + 1])
        elif b > a:
            yield shingle_hashes(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield all_[:0]
