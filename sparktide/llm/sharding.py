"""Sharding by longest processing time (LPT).

Documents with equal texts form a group that stays together. Groups sorted by
size go, largest first, to the least-loaded shard, which a heap yields.

The heap runs on the driver, so what it sees has a fixed bound: a group of more
than ``1/n_bundles`` of all bytes is an item of its own (there are fewer than
``n_bundles`` such groups), all other groups are hashed into ``n_bundles``
bundles, each an item. A corpus of few groups has about one group in each
bundle; in a large one a bundle holds about ``1/n_bundles`` of the bytes, which
bounds the difference between shards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Workspace, local_table, read_table, text_or_empty

N_BUNDLES = 65536
#: Rows that are numbered together in one window partition.
NUMBERED = 20_000


def lpt(sizes: list[int], n_shards: int) -> list[int]:
    """Shard of each item: by falling size to the least-loaded shard; ties go
    to the lower item and the lower shard."""
    heap = [(0, s) for s in range(n_shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heap[0]
        out[i] = shard
        heapq.heapreplace(heap, (load + sizes[i], shard))
    return out


def shard_balanced(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", n_bundles: int = N_BUNDLES) -> DataFrame:
    """Deal documents to shards of near equal bytes, equal texts together.

    Returns a row per input row: ``doc_id, size, text_crc32, shard, slot``.
    ``size`` is the text's UTF-8 bytes plus 1, ``slot`` numbers a shard's rows
    from 0 without gaps. A null text counts as empty. Repeated rows keep a row
    each; null ids are allowed; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shard")
    text = text_or_empty("t")
    slim = ws.table(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp"),
        ),
        "slim",
    )
    totals = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bundle = F.pmod(F.xxhash64("grp"), F.lit(n_bundles)).cast("int")
    heavy = F.col("bytes") * n_bundles > totals[0]
    units = (
        slim.groupBy("grp").agg(F.sum("size").alias("bytes"))
        .select(F.when(heavy, F.col("grp")).alias("grp"), F.when(~heavy, bundle).alias("bundle"), "bytes")
        .groupBy("grp", "bundle").agg(F.sum("bytes").alias("bytes")).collect()
    )  # fmt: skip  # fewer than 2 * n_bundles rows
    units.sort(key=lambda u: (u["bundle"] is None, u["bundle"] or 0, bytes(u["grp"] or b"")))
    shards = lpt([u["bytes"] for u in units], n_shards)
    whole = [(bytes(u["grp"]), s) for u, s in zip(units, shards) if u["grp"] is not None]
    parts = [(u["bundle"], s) for u, s in zip(units, shards) if u["grp"] is None]
    own = local_table(spark, {"grp": [g for g, _ in whole], "own": [s for _, s in whole]}, "grp binary, own int")
    light = local_table(spark, {"bundle": [b for b, _ in parts], "shared": [s for _, s in parts]}, "bundle int, shared int")
    n_sub = max(1, -(-totals[1] // (n_shards * NUMBERED)))
    dealt = (
        slim.withColumn("bundle", bundle)
        .join(F.broadcast(own), "grp", "left").join(F.broadcast(light), "bundle", "left")  # both within the bound above
        .select("rid", "doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"), F.pmod(F.xxhash64("rid"), F.lit(n_sub)).alias("sub"))
    )
    first = dealt.groupBy("shard", "sub").count()
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "sub").orderBy("doc_id", "rid")
    return (
        dealt.withColumn("place", F.row_number().over(place) - 1).join(first, ["shard", "sub"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"))
    )


def op1_lpt_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards; law ``bytes``."""
    out = shard_balanced(read_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
