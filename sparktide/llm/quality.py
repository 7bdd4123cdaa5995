"""Quality classification by nearest-neighbour voting in a latent space.

Terms of a text are its words (hashed) and the shapes of its words: runs of
capitals, small letters and digits each become one sign, other signs stay. Square
roots of relative frequencies, weighted by inverse document frequency, are
reduced by a singular value decomposition of the labelled rows. The labelled
vectors are broadcast; every document's cosines with all of them are computed
exactly, block by block, and its nearest neighbours vote with their likeness.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the least
hash of their id, whatever the number of labels; this bounds the broadcast
(``SAMPLE * RANK`` floats). All documents are scored, on their whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, read_table, small_batches, trim
from ._words import coded, string_array, words

SAMPLE, RANK, NEIGHBOURS = 4096, 64, 25
WORDS, SHAPES = 1024, 1023
WIDTH = WORDS + SHAPES + 1  # the last one counts words that repeat the word before
SHAPE_WEIGHT = 2.0
THRESHOLD = 0.7
#: Texts whose counts are held at a time.
ROWS = 500


def _shapes(distinct: pa.Array) -> pa.Array:
    for pattern, sign in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "9")):
        distinct = pc.replace_substring_regex(distinct, pattern, sign)
    return distinct


def counts(texts: pa.Array) -> np.ndarray:
    """Term counts, a row per text."""
    flat, ends = words(texts, lower=False)
    n = len(texts)
    if not len(flat):
        return np.zeros((n, WIDTH), np.float32)
    codes, distinct = coded(flat)
    distinct = pa.array(distinct, pa.large_string())
    digest = xxhash.xxh3_64_intdigest
    word = np.fromiter((digest(w) % WORDS for w in pc.ascii_lower(distinct).to_pylist()), np.int64, len(distinct))
    shape_codes, shapes = coded(_shapes(distinct))
    shape = np.fromiter((WORDS + digest(s) % SHAPES for s in shapes), np.int64, len(shapes))[shape_codes]
    row = np.repeat(np.arange(n), np.diff(ends)) * WIDTH
    out = np.bincount(row + word[codes], minlength=n * WIDTH) + np.bincount(row + shape[codes], minlength=n * WIDTH)
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (row[1:] == row[:-1])) + 1
    out += np.bincount(row[again] + WIDTH - 1, minlength=n * WIDTH)
    return out.reshape(n, WIDTH).astype(np.float32)


@dataclass
class Model:
    weight: np.ndarray  # of terms
    axes: np.ndarray  # terms by latent dimensions
    vectors: np.ndarray  # labelled rows, of length 1
    labels: np.ndarray

    def latent(self, count: np.ndarray) -> np.ndarray:
        total = count[:, :WORDS].sum(axis=1, keepdims=True)
        x = (np.sqrt(count / np.maximum(total, 1)) * self.weight) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, count: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, by likeness; texts without
        words, which are like nothing, get the share of all labelled rows."""
        if not len(self.labels):
            return np.full(len(count), 0.5)
        k = min(NEIGHBOURS, len(self.labels))
        cosines = self.latent(count) @ self.vectors.T
        near = np.argpartition(cosines, -k, axis=1)[:, -k:]
        vote = np.clip(np.take_along_axis(cosines, near, axis=1), 0, None) ** 2
        total = vote.sum(axis=1)
        score = (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-9, score, self.labels.mean()), 0, 1)


@lean
def _features(batches):
    for batch in batches:
        texts = string_array(batch.column("text"))
        sparse = []
        for a in range(0, len(texts), ROWS):
            for x in counts(texts.slice(a, ROWS)):
                at = np.flatnonzero(x)
                sparse.append(at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(sparse, pa.binary())], names=["label", "counts"])


def _dense(sparse: list[bytes]) -> np.ndarray:
    out = np.zeros((len(sparse), WIDTH), np.float32)
    for row, data in zip(out, sparse):
        n = len(data) // 6
        row[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from labelled rows. Of several labels of an id the least holds;
    rows without an id, label or text are no examples."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    chosen = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(chosen), "id").select("label", "text").mapInArrow(_features, "label int, counts binary")
    rows = rows.orderBy(F.xxhash64("counts"), "counts").limit(sample).collect()  # ids that repeat don't add rows without end
    x = _dense([bytes(r["counts"]) for r in rows])
    label = np.array([r["label"] for r in rows], np.float32)
    n = max(1, len(rows))
    del rows
    weight = (np.log((1 + n) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    weight[WORDS:] *= SHAPE_WEIGHT
    x /= np.maximum(x[:, :WORDS].sum(axis=1, keepdims=True), 1)
    np.sqrt(x, out=x)
    x *= weight
    _, axes = np.linalg.eigh(x.T @ x)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :RANK])
    latent = x @ axes
    del x
    trim()
    return Model(weight, axes, latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12), label)


def _score(shared):
    @lean
    def run(batches):
        model = shared.value
        for batch in batches:
            texts = string_array(batch.column("text"))
            found = [model.scores(counts(texts.slice(a, ROWS))) for a in range(0, len(texts), ROWS)]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names) if n != "text"), pa.array(score.astype(np.float64))], names=[*(n for n in batch.schema.names if n != "text"), "score"])

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row, score`` for each row of ``docs``; ``row`` is a struct of all its
    columns. A null or empty text gets the share of label 1 among the model's
    rows (0.5 if there are none). An empty table gives an empty result."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_score(shared), base.select("row").schema.add("score", "double"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def op7_knn_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents; rows with crc32(doc_id) mod 4 = 2 teach nothing."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    found = scored(docs.select("doc_id", "text").withColumn("held_out", held_out()).select("doc_id", "held_out", "text"), model)
    return found.select("row.doc_id", "row.held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    return scored(docs, fit(docs, labels.where(~held_out()))).where(F.col("score") >= THRESHOLD).select("row.*")
