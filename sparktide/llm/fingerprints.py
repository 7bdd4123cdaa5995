"""Order MinHash fingerprints, sensitive to edit distance.

The k-mers (K words) of a text are numbered by occurrence, so that repeats
count. Each of ``SLOTS`` hash functions selects its ``PICK`` least numbered
k-mers, which are put back into text order; the hash of that tuple is the
slot's value. Equal slots mean equal k-mers in equal order, so the share of
equal slots falls with edits and with reordering alike.

Each document meets its successor by id: ids are cut into ranges of about equal
row counts, the first document of a range is also sent to the range before, and
sorted ranges stream through a task with one row held back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, partitions_for, read_table, small_batches
from ._words import mixed, string_array, word_hashes

K, SLOTS, PICK = 2, 64, 2
_rng = np.random.default_rng(1999)
XORS = _rng.integers(0, 2**64, SLOTS, dtype=np.uint64)[:, None]
ODDS = _rng.integers(0, 2**64, SLOTS, dtype=np.uint64)[:, None] | np.uint64(1)
#: Hash values held at a time for one text.
CELLS = 1 << 21
STEP = np.uint64(0x9E3779B97F4A7C15)


def kmers(hashes: np.ndarray) -> np.ndarray:
    """Hash of each K words; fewer words are one k-mer, none have none."""
    k = min(K, len(hashes))
    if not k:
        return hashes
    n = len(hashes) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out = out * STEP + hashes[j : j + n]
    return mixed(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """16-bit value of each slot for a text's word hashes; empty without words."""
    own = kmers(hashes)
    n = len(own)
    if not n:
        return np.zeros(0, np.uint16)
    order = np.argsort(own, kind="stable")
    run = own[order]
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    times = np.empty(n, np.uint64)
    times[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    numbered = mixed(own + times * STEP)
    pick = min(PICK, n)
    chosen = np.empty((SLOTS, pick), np.int64)
    for a in range(0, SLOTS, step := max(1, CELLS // n)):
        values = (numbered[None, :] ^ XORS[a : a + step]) * ODDS[a : a + step]
        rows = np.arange(len(values))
        for j in range(pick):
            least = values.argmin(axis=1)
            chosen[a : a + step, j] = least
            values[rows, least] = np.uint64(2**64 - 1)
    chosen.sort(axis=1)  # text order
    out = np.zeros(SLOTS, np.uint64)
    for j in range(pick):
        out = mixed(out * STEP + own[chosen[:, j]])
    return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots; texts without words are like each other alone."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def _sketches(texts: list[str]) -> list[np.ndarray]:
    hashes, ends = word_hashes(pa.array(texts, pa.large_string()))
    return [sketch(hashes[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@lean
def _pairs(batches):
    held = None  # (range, id, text, sketch): the last row, whose successor is still to come

    def rows(batch):
        texts = string_array(batch.column("text")).to_pylist()
        return list(zip(batch.column("p").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), texts, _sketches(texts)))

    for batch in batches:
        out, changed = [], []
        for p, guest, doc_id, text, own in rows(batch):
            if held is not None and held[0] == p:
                out.append((held[1], held[2], held[3], own))
                changed.append(edited(held[2], text))
            held = None if guest else (p, doc_id, text, own)
        other = _sketches(changed)
        hexed = lambda s: s.astype(">u2").tobytes().hex()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([o[0] for o in out], batch.schema.field("doc_id").type), pa.array([len(o[1]) for o in out], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array([hexed(o[2]) for o in out], pa.string()), pa.array([hexed(s) for s in other], pa.string()),
                pa.array([likeness(o[2], s) for o, s in zip(out, other)], pa.float64()), pa.array([likeness(o[2], o[3]) for o in out], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def _ranges(bounds: list, before: dict):
    """``[range]`` of an id, or ``[range, the range before]`` if it is a range's first."""
    cuts = np.array(bounds, np.int64)

    # Without nulls, so that large ids stay whole numbers.
    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series, null: pd.Series) -> pd.Series:
        unknown = null.to_numpy(bool)
        place = np.where(unknown, 0, np.searchsorted(cuts, ids.to_numpy(np.int64), side="right") if len(cuts) else 0)
        keys = [None if k else i for i, k in zip(ids.tolist(), unknown)]
        return pd.Series([np.array([p, before[i]] if i in before else [p], np.int32) for p, i in zip(place.tolist(), keys)])

    return lambda c: ranges(F.coalesce(c, F.lit(0)), F.col(c).isNull())


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited versions, a row per document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint
    (hex), near_edited, near_next. The edited text ends with the start of the
    next document by id (after the last: the first). A null text is empty and
    has an empty fingerprint. Rows with equal ids follow each other by text;
    null ids come first. Other columns are ignored; an empty table gives an
    empty result. Ids are whole numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = 4 * partitions_for(spark)
    cuts = sorted(set(slim.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)))
    cuts = [int(c) for c in cuts]
    place = F.element_at(_ranges(cuts, {})("doc_id"), 1)
    first = slim.select("doc_id").withColumn("p", place).groupBy("p").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.count("doc_id").alias("known")).orderBy("p").collect()  # a row per range
    starts = [None if r["known"] < r["n"] else r["first"] for r in first]
    before = {start: first[k - 1]["p"] for k, start in enumerate(starts)}  # of the first range: the last
    own = slim.select("doc_id", "text", F.posexplode(_ranges(cuts, before)("doc_id")).alias("guest", "p"))
    own = own.select("doc_id", "text", (F.col("guest") > 0).alias("guest"), "p")
    dealt = own.repartitionByRange(partitions_for(spark), "p").sortWithinPartitions("p", "guest", F.asc_nulls_first("doc_id"), "text")
    return dealt.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of all documents and their edited texts."""
    return with_successors(read_table(spark, sf_dir, "documents"))
