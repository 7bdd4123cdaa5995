"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A mask names the token positions that count; the others are ignored, so a
substituted word at an ignored place leaves the hash as it was. Hashes of all
training positions meet those of the benchmark in a join. Around each hit the
two texts are laid over each other and words are compared place by place: a
document is contaminated by an item if some ``WINDOW`` consecutive places (the
whole item if that is shorter) hold at least ``LEAST`` of ``WINDOW`` equal words.

Tokens are runs of letters and digits, lower-cased. The training text is split,
zipped with itself at the mask's offsets, exploded and hashed within one
code-generated stage; only hits leave it. Texts with a hit are then read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, read_table

MASKS = ("11011001", "10110101", "11100011")
SPAN = 8
WINDOW, LEAST = 13, 10
#: Benchmark seeds up to this number are broadcast (32 bytes each); beyond it the join is shuffled.
BROADCAST_SEEDS = 1_000_000
#: Hits (an alignment of an item with a text, 20 bytes) up to this number are broadcast; beyond it the join is shuffled.
BROADCAST_HITS = 500_000
#: Name of a column that is added and removed.
KEY = "_decontaminate_row_key"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(col: str):
    return F.array_remove(F.split(F.lower(F.col(col)), TOKEN_SPLIT), "")


def seeded(df: DataFrame, *keep: str) -> DataFrame:
    """A row per place of the array ``t``: ``keep``, pos (from 0), seeds (one per mask)."""
    shifted = F.arrays_zip(*(F.col("t") if k == 0 else F.slice("t", F.lit(k + 1), F.greatest(F.size("t") - k, F.lit(0)))for k in range(SPAN)))
    rows = df.where(F.size("t") >= SPAN).select(*keep, F.posexplode(shifted).alias("pos", "w"))
    word = lambda k: F.col("w").getField("t" if k == 0 else str(k))  # noqa: E731  # arrays_zip names what has no name by its place
    rows = rows.where(word(SPAN - 1).isNotNull())
    hashes = (F.xxhash64(F.lit(m), *(word(k) for k in range(SPAN) if mask[k] == "1")) for m, mask in enumerate(MASKS))
    return rows.select(*keep, "pos", F.array(*hashes).alias("seeds"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, matched, best_window`` for each contaminated document
    and each benchmark item found in it.

    ``matched``: equal words of the best alignment; ``best_window``: the most
    equal words in a window. Rows with equal ids count as one document, and so
    do all rows with a null id. Null or empty texts, and texts or items of fewer
    than 8 tokens, have no seed and are never contaminated. Texts of any length
    are searched whole. Other columns are ignored; empty tables give an empty
    result.
    """
    ws = Workspace(docs.sparkSession, "seeds")
    items = benchmark.select(F.col("item_id"), tokens("text").alias("it"))
    places = seeded(items.select("item_id", F.col("it").alias("t")), "item_id")
    seeds = places.select("item_id", F.col("pos").alias("at"), F.explode("seeds").alias("seed")).distinct()
    n_items, n_seeds = items.where(F.col("it").isNotNull()).agg(F.count("*"), F.sum(F.size("it"))).first()
    if (n_seeds or 0) * len(MASKS) <= BROADCAST_SEEDS:
        seeds, items = F.broadcast(seeds), F.broadcast(items)
    train = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("t"))
    hits = seeded(train, "doc_id").select("doc_id", "pos", F.explode("seeds").alias("seed")).join(seeds, "seed")
    hits = ws.table(hits.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "hits")
    # Only texts with a hit are looked at again.
    hit = hits.select(F.col("doc_id").alias("hit_id"), "item_id", "shift")
    if hits.count() <= BROADCAST_HITS:
        hit = F.broadcast(hit)
    found = train.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id"))).join(items, "item_id")
    # Lay the item over the text: its first word is at place ``shift``.
    shift = F.col("shift")
    lo = F.greatest(-shift, F.lit(0))
    long = F.least(F.size("it"), F.size("t") - shift) - lo
    found = found.where(long > 0).select("doc_id", "item_id", F.size("it").alias("n"), F.slice("t", F.greatest(shift, F.lit(0)) + 1, long).alias("mine"), F.slice("it", lo + 1, long).alias("its"))
    same = found.select("doc_id", "item_id", "n", F.zip_with("mine", "its", lambda x, y: (x == y).cast("int")).alias("same"))
    width = F.least(F.lit(WINDOW), "n", F.size("same"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    windows = F.transform(F.sequence(F.lit(1), F.size("same") - width + 1), lambda i: total(F.slice("same", i, width)))
    scored = same.select("doc_id", "item_id", "n", total("same").alias("matched"), F.array_max(windows).alias("best"))
    hit = F.col("best") * WINDOW >= F.least(F.lit(WINDOW), "n") * LEAST
    return scored.where(hit).groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("best").cast("long").alias("best_window"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates. A row is known by
    its id and text: rows with equal or null ids are judged one by one."""
    keyed = docs.withColumn(KEY, F.struct("doc_id", F.xxhash64("text").alias("text")))
    found = overlaps(keyed, benchmark, KEY).select(F.col("doc_id").alias("found_key")).distinct()
    return keyed.join(found, F.col(KEY) == F.col("found_key"), "left_anti").drop(KEY)


def op9_spaced_seed_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contaminated documents and the items found in them."""
    return overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _seed_sql(mask: str, x: str, y: str) -> str:
    return " AND ".join(f"{x}.t[{x}.i + {k}] = {y}.t[{y}.i + {k}]" for k in range(SPAN) if mask[k] == "1")


def _sql() -> str:
    split = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    hits = " UNION ".join(f"SELECT p.doc_id, q.item_id, p.i - q.i AS shift FROM p JOIN q ON {_seed_sql(m, 'p', 'q')}" for m in MASKS)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {split("text")} AS t FROM documents WHERE text IS NOT NULL),
b AS MATERIALIZED (SELECT item_id, {split("text")} AS t FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT doc_id, t, unnest(range(1, len(t) - {SPAN - 2})) AS i FROM d WHERE len(t) >= {SPAN}),
q AS (SELECT item_id, t, unnest(range(1, len(t) - {SPAN - 2})) AS i FROM b WHERE len(t) >= {SPAN}),
hits AS MATERIALIZED ({hits}),
laid AS (SELECT h.doc_id, h.item_id, h.shift, len(b.t) AS n, greatest(-h.shift, 0) AS lo, least(len(b.t), len(d.t) - h.shift) AS hi, d.t AS dt, b.t AS bt
  FROM hits h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id),
places AS (SELECT doc_id, item_id, shift, n, hi - lo AS long, unnest(range(lo + 1, hi + 1)) AS k, dt, bt FROM laid),
same AS (SELECT doc_id, item_id, shift, n, long, k, CAST(dt[k + shift] = bt[k] AS INT) AS s FROM places),
w AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS win FROM same),
g AS (SELECT doc_id, item_id, shift, any_value(n) AS n, sum(s) AS matched, max(win) AS best FROM w GROUP BY doc_id, item_id, shift)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(best) AS BIGINT) AS best_window
FROM g WHERE best * {WINDOW} >= least({WINDOW}, n) * {LEAST} GROUP BY doc_id, item_id"""


ORACLE = _sql()
