"""Near duplicates by one-permutation MinHash.

One hash of each shingle serves all slots: its top bits name a slot, the least
hash in a slot is its value. Empty slots take over the value of a filled one by
optimal densification: each empty slot probes slots in an order of its own,
drawn from a 2-universal family, until it meets a filled one. ``rows`` slots
form a band; equal bands meet in a bucket.

A bucket yields a star: its centre against each member, so ``n`` members give
``n - 1`` candidates. The centre is the member that shares the most places in
buckets, as a text does from which others derive. Candidates are confirmed on
full sets. Links that no star can see (two members alike, the centre unlike one
of them) are found where different components still meet in a bucket: by what
the members do not share with the centre, see ``_rest``. Members of one
component need no further link: nothing is lost and nothing is capped.

Texts with equal shingle sets are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Workspace, lean, read_table, small_batches
from ._words import mixed, shingle_sets, string_array, word_hashes
from .components import connected_components

SHINGLE, PERCENT = 5, 75
SLOTS, ROWS = 128, 4
#: Sets of up to SMALL shingles get the bands of MORE further hashes.
SMALL, MORE = 48, 3
#: In stars of up to so many members all open pairs are tried.
SMALL_STAR = 24


def probe_orders(slots: int, tries: int) -> np.ndarray:
    """Slot that empty slot j probes at try t, from a 2-universal family."""
    rng = np.random.default_rng(20170806)
    a, b = rng.integers(1, 2**31, tries), rng.integers(0, 2**31, tries)
    j = np.arange(slots)
    return np.stack([((a[t] * (j * tries + t + 1) + b[t]) % 2147483647) % slots for t in range(tries)])


PROBES = probe_orders(SLOTS, 64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Densified signature of a non-empty sorted set of 64-bit hashes."""
    bits = np.uint64(64 - SLOTS.bit_length() + 1)
    slot = (hashes >> bits).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    out, full = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, bool)
    out[slot[head]], full[slot[head]] = hashes[head], True
    todo = np.flatnonzero(~full)
    for probe in PROBES:
        if not len(todo):
            return out
        at = probe[todo]
        hit = full[at]
        out[todo[hit]] = out[at[hit]]
        todo = todo[~hit]
    filled = np.flatnonzero(full)  # after all tries: a filled slot by a hash of the place
    out[todo] = out[filled[(mixed(todo.astype(np.uint64)) % np.uint64(len(filled))).astype(np.int64)]]
    return out


BAND_SALT = mixed(np.arange(1, SLOTS // ROWS + 1, dtype=np.uint64))


def bands(sig: np.ndarray) -> np.ndarray:
    """Bucket of each band."""
    grid = sig.reshape(-1, ROWS)
    out = BAND_SALT.copy()
    for j in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return out.view(np.int64)


def buckets(hashes: np.ndarray) -> np.ndarray:
    """All buckets of a non-empty set. In a small set the slots depend on each
    other, so it gets the bands of MORE further hashes as well."""
    found = [bands(signature(hashes))]
    if len(hashes) <= SMALL:
        for salt in range(1, MORE + 1):
            again = np.sort(mixed(hashes + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)))
            found.append(mixed(bands(signature(again)).view(np.uint64) + np.uint64(salt)).view(np.int64))
    return np.concatenate(found)


def _sets(batch: pa.RecordBatch):
    hashes, ends = word_hashes(string_array(batch.column("text")))
    return shingle_sets(hashes, ends, SHINGLE)


@lean
def _sketch(batches):
    for batch in batches:
        n, node, keys = [], [], []
        for s in _sets(batch):
            n.append(len(s))
            node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(buckets(s) if len(s) else None)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, kind)], names=["doc_id", "n", "digest", "bands"])


@lean
def _full(batches):
    for batch in batches:
        node, sets = [], []
        for s in _sets(batch):
            node.append(xxhash.xxh3_128_digest(s.tobytes()))
            sets.append(s.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "set"])


def _confirmed(pairs: DataFrame, sets: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Of ``pairs(a, b)`` those with a Jaccard index of at least PERCENT."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    linked = both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u")).where(F.col("i") * 100 >= F.col("u") * PERCENT)
    return ws.table(linked.select("a", "b"), name)


def _near_size(x: str, y: str):
    return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _meeting(met: DataFrame, part: DataFrame | None, ws: Workspace, name: str) -> DataFrame:
    """Members of buckets in which different components meet."""
    placed = met.withColumn("label", F.col("node")) if part is None else met.join(part, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = ws.table(placed.select("bucket", "node", "n", "fame", "label"), f"{name}-placed")
    open_ = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    out = ws.table(placed.join(open_, "bucket"), f"{name}-meeting")
    ws.drop(f"{name}-placed")
    return out


def _stars(meeting: DataFrame) -> DataFrame:
    """``c, cn, cl, node, n, label``: the centre of each bucket, its most shared
    member, with each other member."""
    centres = meeting.groupBy("bucket").agg(F.max(F.struct("fame", F.xxhash64("node").alias("h"), "node", "n", "label")).alias("c"))
    centres = centres.select("bucket", F.col("c.node").alias("c"), F.col("c.n").alias("cn"), F.col("c.label").alias("cl"))
    return meeting.join(centres, "bucket").where("node != c").select("c", "cn", "cl", "node", "n", "label").distinct()


def _rest(meeting: DataFrame, sets: DataFrame, ws: Workspace) -> DataFrame:
    """Pairs ``a, b`` of bucket members that may be linked though no star says so.

    With ``D`` the symmetric difference to the centre c of the bucket, x and y
    differ in ``|Dx| + |Dy| - 2 |Dx & Dy|`` shingles, which a link bounds by
    ``(|x| + |y|) / 7``. So Dx and Dy share a known least number of shingles, and
    of their rarest-first orders a prefix is enough to find one. Two texts that
    are both linked with c need no link. What all members have in common drops
    out of D: members that differ from c each in their own way never meet.
    """
    stars = ws.table(_stars(meeting), "stars")
    mixed_ = stars.groupBy("c").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("n").alias("most"), F.count("*").alias("size"))
    mixed_ = ws.table(mixed_.where("lo != hi").select("c", "most", "size"), "mixed")
    own = stars.join(mixed_, "c").join(sets.select(F.col("node").alias("c"), F.col("set").alias("sc")), "c").join(sets, "node")
    delta = F.concat(F.array_except("set", "sc"), F.array_except("sc", "set"))
    own = own.select("c", "node", "n", "label", "most", "size", delta.alias("delta"), (F.size(delta) * 7 <= F.col("n") + F.col("cn")).alias("linked"))
    own = ws.table(own.withColumn("d", F.size("delta")), "deltas")
    small = own.where(F.col("size") <= SMALL_STAR).select("c", "node", "n", "label", "linked")
    other = small.where("not linked").select("c", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("label").alias("xl"))
    pairs = small.join(other, "c").where("label != xl and (linked or x < node)").where(_near_size("n", "xn")).select(*_pair("node", "x"))
    large = own.where(F.col("size") > SMALL_STAR)
    least = large.where("not linked").groupBy("c").agg(F.min("d").alias("least"))
    flat = large.select("c", "node", F.explode("delta").alias("e"))
    rare = flat.groupBy("c", "e").agg(F.count("*").alias("times")).where("times > 1")
    order = Window.partitionBy("c", "node").orderBy("times", "e")
    # Shingles of one member alone are first in every order and meet nothing: only their number counts.
    ranked = flat.join(rare, ["c", "e"]).select("c", "node", "e", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("c", "node")).alias("shared"))
    ranked = ranked.join(large.join(least, "c").select("c", "node", "n", "label", "linked", "d", "most", "least"), ["c", "node"])
    ranked = ranked.withColumn("k", F.col("k") + F.col("d") - F.col("shared"))
    reach = F.col("n") + F.least(F.col("most"), F.floor(F.col("n") * 4 / 3))
    # Least overlap with a member of no smaller, and with one of no larger difference.
    as_less = F.ceil((F.col("d") + F.when(F.col("linked"), F.greatest("d", "least")).otherwise(F.col("d")) - reach / 7) / 2 - 1e-9)
    as_more = F.ceil(F.col("d") - reach / 7 - 1e-9)
    ranked = ws.table(ranked.select("c", "e", "node", "n", "label", "linked", "d", (F.col("d") - F.col("k")).alias("after"), (F.col("k") <= F.col("d") - F.greatest(as_less, F.lit(1)) + 1).alias("less"), (F.col("k") <= F.col("d") - F.greatest(as_more, F.lit(1)) + 1).alias("more")), "ranked")
    less = ranked.where("less").select("c", "e", "node", "n", "label", "linked", "d", "after")
    more = ranked.where("more").select("c", "e", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("label").alias("xl"), F.col("linked").alias("xk"), F.col("d").alias("xd"), F.col("after").alias("xafter"))
    # The first shingle that x and y share: what comes after it in both orders must suffice for a link.
    enough = F.least("after", "xafter") + 1 >= (F.col("d") + F.col("xd") - (F.col("n") + F.col("xn")) / 7) / 2 - 1e-9
    met = less.join(more, ["c", "e"]).where("label != xl and not (linked and xk) and (d < xd or d = xd and node < x)").where(_near_size("n", "xn") & enough)
    return pairs.unionByName(met.select(*_pair("node", "x"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each input row.

    component_id is the smallest id reachable over links of a Jaccard index of
    0.75 or more of 5-word shingles. A text without words, or null, is linked
    with nothing. Rows with equal ids share their fate; a row with a null id
    takes the smallest id of its component, if any. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "near")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    sketch = ws.table(slim.mapInArrow(_sketch, f"doc_id {kind}, n long, digest binary, bands array<long>"), "sketch")
    # Rows of equal sets have equal bands: any row's will do. A number stands for the digest from here on.
    nodes = sketch.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("n").cast("int").alias("n"), F.min("bands").alias("bands"))
    nodes = ws.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    member = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = ws.table(member.groupBy("bucket").count().where("count > 1"), "shared")
    met = ws.table(member.join(shared, "bucket"), "shared-members")
    # A text that others derive from shares the most places in buckets: as a centre it sees all of them.
    fame = met.groupBy("node").agg(F.sum("count").alias("fame"))
    met = ws.table(met.join(fame, "node").select("bucket", "node", "n", "fame"), "members")
    ws.drop("shared", "shared-members")
    # Full sets of all nodes that share a bucket with another one.
    wanted = ws.table(nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "digest", "first"), "wanted")
    again = slim.join(wanted.select("first").distinct(), slim["doc_id"].eqNullSafe(F.col("first")), "left_semi")
    full = again.mapInArrow(_full, "digest binary, set array<long>").join(wanted.select("node", "digest"), "digest")
    sets = ws.table(full.select("node", "set").dropDuplicates(["node"]), "sets")
    first = _meeting(met, None, ws, "all")
    pairs = ws.table(_stars(first).where(_near_size("n", "cn")).select(*_pair("node", "c")).distinct(), "pairs")
    links = _confirmed(pairs, sets, ws, "links")
    part = ws.table(connected_components(links, ws, "part"), "part-labels")
    again = _meeting(met, part, ws, "open")
    rest = ws.table(_rest(again, sets, ws), "rest")
    more = _confirmed(rest, sets, ws, "more")
    part = ws.table(connected_components(links.unionByName(more), ws, "whole"), "labels")
    ws.drop("sets", "members", "wanted", "pairs", "rest", "ranked", "deltas", "stars", "all-meeting", "open-meeting", "part-labels")
    labelled = nodes.join(part, "node", "left").select("digest", "first", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component"))
    named = ws.table(labelled.join(least, "label").select("digest", "component"), "named")
    own = sketch.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    out = own.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of near duplicates over all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(t[i : i + 4], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM w WHERE len(t) >= 5)
  UNION ALL SELECT doc_id, array_to_string(t, ' ') FROM w WHERE len(t) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id, d.doc_id = coalesce(c.least, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
