"""Best-fit packing of token sequences by a grouping genetic algorithm.

A document longer than a sequence is cut: its first piece takes what is left
over, all others fill a sequence of their own. The rest is bin packing.
Documents are dealt into blocks of about ``BLOCK``; each block is a problem of
its own with ``ISLANDS`` islands. An island keeps a population of packings;
crossover injects whole well-filled bins of one parent into another, drops the
receiver's bins that hold documents now placed twice, and best-fits the
displaced documents, longest first. After each epoch the elite of an island
migrates to the next one. The best packing of a block stands; what its poorly
filled bins hold goes on to a smaller set of blocks, and so on.

A packing is a list of bins of lengths: documents of equal length are alike, so
only lengths travel between islands. A block's size does not depend on the
corpus; every step is a group per block.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, lean, read_table, small_batches
from ._words import string_array

CAPACITY, BLOCK, ISLANDS, EPOCHS = 2048, 4096, 3, 2
POPULATION, GENERATIONS = 4, 5
#: A bin filled to this share is well filled: worth injecting, and final after its block.
WELL = 0.995
VOCABULARY, END = "byte_bpe_50k", 0


# --- the genetic algorithm: lists of lengths -------------------------------


def best_fit(lengths, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Puts each length, in the given order, in the fullest bin that takes it."""
    by_space: dict[int, list[int]] = {}
    mask = 0
    for b, own in enumerate(bins):
        if space := capacity - sum(own):
            by_space.setdefault(space, []).append(b)
            mask |= 1 << space
    for x in lengths:
        fits = mask >> x
        if fits:
            space = x + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask ^= 1 << space
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(x)
        if space := space - x:
            by_space.setdefault(space, []).append(b)
            mask |= 1 << space
    return bins


def fitness(bins: list[list[int]], capacity: int) -> tuple:
    """Fewer bins are better, then fuller ones."""
    return -len(bins), sum(sum(b) ** 2 for b in bins) / capacity**2


def repack(kept: list[list[int]], left: list[int], capacity: int) -> list[list[int]]:
    """``kept`` bins and the lengths that ``left`` still counts."""
    return best_fit((x for x in range(capacity, 0, -1) for _ in range(left[x])), kept, capacity)


def crossover(giver: list[list[int]], taker: list[list[int]], counts: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    left, kept = counts.copy(), []
    well = [b for b in giver if sum(b) >= WELL * capacity] or giver
    a, b = sorted((rng.randrange(len(well) + 1), rng.randrange(len(well) + 1)))
    for own in well[a:b]:
        for x in own:
            left[x] -= 1
        kept.append(own.copy())
    for own in taker:
        for x in own:
            left[x] -= 1
        if any(left[x] < 0 for x in own):  # holds a document that was injected: dissolve
            for x in own:
                left[x] += 1
        else:
            kept.append(own.copy())
    return repack(kept, left, capacity)


def mutation(bins: list[list[int]], counts: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Dissolves the emptiest bins and some others."""
    order = sorted(range(len(bins)), key=lambda i: sum(bins[i]))
    gone = set(order[: max(1, len(bins) // 50)]) | set(rng.sample(range(len(bins)), max(1, len(bins) // 20)))
    left, kept = counts.copy(), []
    for i, own in enumerate(bins):
        if i not in gone:
            kept.append(own.copy())
            for x in own:
                left[x] -= 1
    loose = [x for x in range(capacity, 0, -1) for _ in range(left[x])]
    if rng.random() < 0.5:  # a little disorder: best fit decreasing alone repeats itself
        for _ in range(len(loose) // 4):
            i, j = rng.randrange(len(loose)), rng.randrange(len(loose))
            loose[i], loose[j] = loose[j], loose[i]
    return best_fit(loose, kept, capacity)


def evolve(lengths: list[int], population: list[list[list[int]]], capacity: int, seed: int, generations: int = GENERATIONS) -> list[list[list[int]]]:
    """A population after some generations, the elite first."""
    rng = random.Random(seed)
    counts = [0] * (capacity + 1)
    for x in lengths:
        counts[x] += 1
    if not population:
        population = [repack([], counts, capacity)]
        while len(population) < POPULATION:
            population.append(mutation(population[0], counts, capacity, rng))
    bound = -(-sum(lengths) // capacity)
    key = lambda p: fitness(p, capacity)
    population = sorted(population, key=key, reverse=True)[:POPULATION]
    for _ in range(generations):
        if len(population[0]) <= bound:
            break
        giver, taker = rng.sample(population, 2) if len(population) > 1 else population * 2
        child = crossover(giver, taker, counts, capacity, rng)
        if rng.random() < 0.5:
            child = mutation(child, counts, capacity, rng)
        population = sorted([*population, child, mutation(population[0], counts, capacity, rng)], key=key, reverse=True)[:POPULATION]
    return population


def _flat(population: list[list[list[int]]]) -> list[list[int]]:
    return [[x for own in p for x in (*own, 0)] for p in population]


def _bins(flat) -> list[list[int]]:
    out, own = [], []
    for x in flat:
        if x:
            own.append(int(x))
        else:
            out.append(own)
            own = []
    return out


def _island(capacity: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = (int(k) for k in key)
        lengths = [int(x) for x in rows["lengths"].iloc[0]]
        population = [_bins(p) for row in rows["population"] for p in row]
        epoch = int(rows["epoch"].iloc[0])
        found = evolve(lengths, population, capacity, (block * 1009 + island) * 31 + epoch)
        return pd.DataFrame({"block": [block], "island": [island], "epoch": [epoch + 1], "lengths": [lengths], "population": [_flat(found)]})

    return run


def _settle(level: int, last: bool, capacity: int):
    """Puts a block's documents into the bins of its best packing."""

    def run(key, items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        items = items.sort_values(["length", "rid"], kind="stable")
        waiting: dict[int, list[int]] = {}
        for rid, x in zip(items["rid"].tolist(), items["length"].tolist()):
            waiting.setdefault(x, []).append(rid)
        out = []
        for b, own in enumerate(_bins(best["packing"].iloc[0]) if len(best) else []):
            done, at = last or sum(own) >= WELL * capacity, 0
            for x in own:
                rid = waiting[x].pop()
                out.append((rid, x, (level << 54) | (block << 22) | b if done else None, at if done else None))
                at += x
        return pd.DataFrame({"rid": [o[0] for o in out], "length": np.array([o[1] for o in out], np.int32), "sequence_id": pd.array([o[2] for o in out], "Int64"), "offset": pd.array([o[3] for o in out], "Int64")})

    return run


def pack(items: DataFrame, ws: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """``rid, sequence_id, offset`` for ``items(rid long, length int)``, with
    unique rids and lengths of 1 to capacity."""
    done, level = None, 0
    left = items.select("rid", "length")
    n = left.count()
    while True:
        blocks = max(1, -(-n // BLOCK))
        own = ws.table(left.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(blocks))), f"items{level}")
        state = own.groupBy("block").agg(F.sort_array(F.collect_list("length")).alias("lengths"))
        state = state.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).alias("epoch"), "lengths", F.array().cast("array<array<int>>").alias("population"))
        schema = "block long, island int, epoch int, lengths array<int>, population array<array<int>>"
        for epoch in range(EPOCHS + 1):
            state = ws.table(state.groupBy("block", "island").applyInPandas(_island(capacity), schema), f"state{level}-{epoch}")
            if epoch < EPOCHS:
                elite = state.select("block", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), "epoch", "lengths", F.slice("population", 1, 1).alias("population"))
                state = state.unionByName(elite)
        # Fewest bins (a 0 ends each), then the lower island.
        packing = F.col("population")[0]
        size = F.size(F.filter(packing, lambda x: x == 0))
        best = state.groupBy("block").agg(F.min(F.struct(size.alias("size"), "island", packing.alias("packing"))).alias("best")).select("block", "best.packing")
        last = blocks == 1
        settled = ws.table(own.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(_settle(level, last, capacity), "rid long, length int, sequence_id long, offset long"), f"settled{level}")
        fixed = settled.where("sequence_id is not null").select("rid", "sequence_id", "offset")
        done = fixed if done is None else done.unionByName(fixed)
        ws.drop(f"items{level}", *(f"state{level}-{e}" for e in range(EPOCHS + 1)))
        if last:
            return done
        left = settled.where("sequence_id is null").select("rid", "length")
        before, n = n, left.count()
        if n > before // 2:  # lengths that don't combine: another round of blocks would leave as many
            rest = ws.table(left.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(level + 1)), F.lit(max(1, -(-n // BLOCK))))), f"rest{level}")
            lengths = rest.groupBy("block").agg(F.sort_array(F.collect_list("length")).alias("lengths"))
            best = lengths.groupBy("block").applyInPandas(_plain(capacity), "block long, packing array<int>")
            final = ws.table(rest.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(_settle(level + 1, True, capacity), "rid long, length int, sequence_id long, offset long"), f"last{level}")
            return done.unionByName(final.select("rid", "sequence_id", "offset"))
        level += 1


def _plain(capacity: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = [int(x) for x in rows["lengths"].iloc[0]]
        best = evolve(lengths, [], capacity, int(key[0]))[0]
        return pd.DataFrame({"block": [int(key[0])], "packing": [_flat([best])[0]]})

    return run


# --- tokens ----------------------------------------------------------------


def encoder(name: str = VOCABULARY):
    """Ordinary encoding by the vocabulary; the ids are those of the library
    ``tokenizers`` with the vocabulary's JSON file (tested), in half the time."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _encode(name: str, capacity: int):
    @lean
    def run(batches):
        encode = encoder(name)
        for batch in batches:
            lengths, crcs = [], []
            for text in string_array(batch.column("text")).to_pylist():
                ids = np.array([*encode(text), END], "<u4")
                raw = memoryview(ids).cast("B")
                lengths.append(len(ids))
                crcs.append([zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in cuts(len(ids), capacity)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("rid"), pa.array(lengths, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["row", "rid", "n", "crcs"])

    return run


def packed(docs: DataFrame, text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per piece: ``row, piece, start, length, ids_crc32, sequence_id, offset``.

    ``row`` is a struct of the input's columns but the text. A null or empty
    text is the end token alone. Repeated rows are packed as rows of their own;
    columns may have any names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "pack")
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(0).alias("none"))
    base = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).cast("string").alias("text"))
    schema = base.select("row", "rid").schema.add("n", "long").add("crcs", _longs())
    coded = ws.table(base.mapInArrow(_encode(vocabulary, capacity), schema), "coded")
    first = F.when(F.col("n") <= capacity, F.col("n")).when(F.col("n") % capacity == 0, F.lit(capacity)).otherwise(F.col("n") % capacity).cast("int")
    sized = coded.withColumn("first", first)
    # A piece that fills a sequence needs no place. Its number: the row's, then the piece's.
    places = pack(sized.where(F.col("first") < capacity).select("rid", F.col("first").alias("length")), ws, capacity)
    full = ws.table(sized.where((F.size("crcs") > 1) | (F.col("first") == capacity)).select("rid", F.size("crcs").alias("k")), "full")
    numbered = _numbers(full)
    out = sized.join(places, "rid", "left").join(numbered, "rid", "left")
    out = out.select("row", "n", "first", "sequence_id", "offset", "base", F.posexplode("crcs").alias("piece", "ids_crc32"))
    head = (F.col("piece") == 0) & F.col("sequence_id").isNotNull()
    start = F.when(F.col("piece") == 0, 0).otherwise(F.col("first") + (F.col("piece") - 1) * capacity).cast("long")
    length = F.when(F.col("piece") == 0, F.col("first")).otherwise(F.lit(capacity)).cast("long")
    number = F.when(head, F.col("sequence_id")).otherwise(-1 - F.col("base") - F.col("piece"))
    return out.select("row", "piece", start.alias("start"), length.alias("length"), "ids_crc32", number.alias("sequence_id"), F.when(head, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"))


def _longs():
    from pyspark.sql.types import ArrayType, LongType

    return ArrayType(LongType())


def _numbers(full: DataFrame) -> DataFrame:
    """``rid, base``: gapless numbers for the pieces of rows, k each."""
    from pyspark.sql.window import Window

    n_sub = max(1, -(-full.count() // 20_000))
    full = full.withColumn("sub", F.pmod(F.xxhash64("rid"), F.lit(n_sub)))
    first = full.groupBy("sub").agg(F.sum("k").alias("k"))
    before = Window.partitionBy(F.lit(0)).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("sub", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("sub").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    return full.withColumn("own", F.coalesce(F.sum("k").over(own), F.lit(0))).join(first, "sub").select("rid", (F.col("first") + F.col("own")).alias("base"))


def op6_grouping_ga_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    out = packed(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
