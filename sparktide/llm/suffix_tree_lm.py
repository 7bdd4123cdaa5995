"""Language-model scores by a probabilistic suffix tree over bytes.

A text is its lower-cased words, each followed by a space, then an end sign.
The tree holds contexts of up to ``DEPTH`` bytes. A context is retained if the
next-symbol distribution after it diverges from that after its own longest
suffix: count times relative entropy, at least ``DIVERGENCE`` nats. All that pass
are retained, so the model grows with the corpus; ``contexts`` can bound it to
those of largest divergence, which no query does. Contexts seen fewer than
``LEAST_COUNT`` times give no evidence and are not tested. Distributions are
smoothed by those of the suffix (Witten-Bell), down to the symbol counts with
additive smoothing. A text is scored by the longest retained suffix at each
place; the tree is compiled into an automaton, and many stretches of text go
through it in step. A tree that outgrows a broadcast is dealt by the last two
bytes of its contexts into parts that don't, and each text is read for each part.

Corpus counts are exact. One pass over the texts yields, per block of documents,
the counts of (DEPTH + 1)-grams and of distinct words; both are summed by
Spark. Word counts go back to the blocks that share the word, which gives the
base scores without a row per token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, lean, read_table, small_batches, tidy, trim
from ._words import coded, string_array, words

DEPTH, DIVERGENCE, LEAST_COUNT = 6, 4.0, 8
SPACE, END = 0x20, 0x0A
#: Values a symbol can have: all bytes but white space, the space and the end sign.
SYMBOLS = 256 - 6 + 2
ADDITIVE = 0.5
STRETCH = 512
#: Documents of a block, documents laid out as bytes at a time, and grams held before they are handed on.
BLOCK_ROWS, PART_ROWS, HELD = 2000, 200, 1 << 21
#: Documents of which the distinct grams are scored at a time.
SCORED_ROWS = 1000
#: Cells of the largest automaton (8 bytes each) that is broadcast: its states, about as
#: many as contexts, times its symbols. A larger tree is scored in parts of at most
#: about PART_GRAMS counts (16 bytes each), one after the other.
CELLS, PART_GRAMS = 8_000_000, 6_000_000
END_WORD = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


def stream(flat: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, DEPTH end signs before each, and the place where each
    text begins (one more than texts: there the next one would)."""
    size = np.diff(flat.buffers()[1] and np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]) if len(flat) else np.zeros(0, np.int64)
    data = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) and flat.buffers()[2] else np.zeros(0, np.uint8)
    base = int(np.frombuffer(flat.buffers()[1], np.int64)[flat.offset]) if len(flat) else 0
    data = data[base : base + int(size.sum())]
    texts = len(ends) - 1
    word_ends = np.concatenate([[0], np.cumsum(size + 1)])  # with a space each
    length = word_ends[ends[1:]] - word_ends[ends[:-1]] + 1  # and the end sign
    starts = np.concatenate([[0], np.cumsum(length + DEPTH)]) + DEPTH
    out = np.full(int(starts[-1]), END, np.uint8)
    if len(size):
        text = np.repeat(np.arange(texts), np.diff(ends))
        first = starts[text] + word_ends[:-1] - word_ends[ends[text]]
        shift = np.repeat((first - np.concatenate([[0], np.cumsum(size)[:-1]])).astype(np.int32), size)
        shift += np.arange(len(data), dtype=np.int32)
        out[shift] = data
        out[first + size] = SPACE
    return out, starts


def grams(data: np.ndarray, starts: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (DEPTH + 1)-grams that end in the texts told by ``use``, and their counts."""
    key = np.zeros(max(0, len(data) - DEPTH), np.uint64)
    for j in range(DEPTH + 1):
        key = key << np.uint64(8) | data[j : j + len(key)]
    own = np.zeros(len(key) + 1, np.int8)  # a gram belongs to the place of its last byte
    np.add.at(own, starts[:-1][use] - DEPTH, 1)
    np.add.at(own, starts[1:][use] - 2 * DEPTH, -1)
    return np.unique(key[np.cumsum(own[:-1]).astype(bool)], return_counts=True)


@lean
def _survey(batches):
    """Rows of three kinds: (gram, n), (block, word, pos, n), (block, blob)."""
    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    held_keys, held_counts, held = [], [], 0
    schema = pa.schema([("block", pa.int64()), ("word", pa.int64()), ("pos", pa.int32()), ("n", pa.int64()), ("gram", pa.int64()), ("blob", pa.binary())])

    def rows(height, /, **given):
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(height, f.type) for f in schema], schema=schema)

    def summed():
        keys, counts = np.concatenate(held_keys), np.concatenate(held_counts)
        order = np.argsort(keys, kind="stable")  # runs that are sorted already
        keys, counts = keys[order], counts[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[head], np.add.reduceat(counts, head)

    for whole in batches:
        for a in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(a, BLOCK_ROWS)
            flat, ends = words(string_array(batch.column("text")))
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for b in range(0, batch.num_rows, PART_ROWS):
                e = ends[b : b + PART_ROWS + 1]
                keys, counts = grams(*stream(flat.slice(e[0], e[-1] - e[0]), e - e[0]), train[b : b + PART_ROWS])
                held_keys.append(keys)
                held_counts.append(counts)
                held += len(keys)
            if held > HELD:
                keys, counts = summed()
                held_keys, held_counts, held = [keys], [counts], len(keys)
                if held > HELD // 2:
                    yield rows(held, gram=pa.array(keys.view(np.int64)), n=pa.array(counts))
                    held_keys, held_counts, held = [], [], 0
            codes, distinct = coded(flat)
            digest = xxhash.xxh3_64_intdigest
            table = np.append(np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct)), END_WORD)
            text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            pair, times = np.unique(text * len(table) + codes, return_counts=True)
            row, code = pair // len(table), pair % len(table)
            local = np.bincount(code, times * train[row], minlength=len(table)).astype(np.int64)
            local[-1] = train.sum()
            dk = batch.column("dk").to_numpy()
            parts = (dk.astype("<i8"), np.bincount(row, minlength=len(dk)).astype("<i4"), code.astype("<i4"), times.astype("<i4"), local.astype("<i8"))
            blob = np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(p.tobytes() for p in parts)
            block += 1
            n = len(table)
            yield rows(n, block=pa.array(np.full(n, block)), word=pa.array(table.view(np.int64)), pos=pa.array(np.arange(n, dtype=np.int32)), n=pa.array(local))
            yield rows(1, block=pa.array([block], pa.int64()), blob=pa.array([blob], pa.binary()))
    if held_keys:
        keys, counts = summed()
        yield rows(len(keys), gram=pa.array(keys.view(np.int64)), n=pa.array(counts))


def _base(total: int, kinds: int):
    @lean
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                blob, pos, c = batch.column("blob")[k].as_buffer(), batch.column("pos")[k].values, batch.column("c")[k].values
                sizes = np.frombuffer(blob, "<i8", 5)
                at, parts = 40, []
                for size, kind in zip(sizes.tolist(), ("<i8", "<i4", "<i4", "<i4", "<i8")):
                    parts.append(np.frombuffer(blob, kind, size, at))
                    at += parts[-1].nbytes
                dk, distinct, code, times, local = parts
                count = local.copy()
                if pos is not None:
                    count[pos.to_numpy()] = c.to_numpy()
                value = np.log10((count + 0.1) / (total + 0.1 * (kinds + 1)))
                text = np.repeat(np.arange(len(dk)), distinct)
                score = np.bincount(text, times * value[code], minlength=len(dk)) + value[-1]
                known = np.bincount(text, times * (count[code] > 0), minlength=len(dk)) + (count[-1] > 0)
                n = np.bincount(text, times, minlength=len(dk)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(dk), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(score)], names=["dk", "n_tokens", "n_known", "base_score"])

    return run


# --- the tree --------------------------------------------------------------


@dataclass
class Automaton:
    symbol: np.ndarray  # of a byte; the last symbol stands for each byte never seen
    log: np.ndarray  # states by symbols, flat
    follow: np.ndarray  # states by symbols, flat: the next state, times symbols
    start: int  # after end signs, times symbols


def compiled(retained: dict[bytes, dict[int, int]]) -> Automaton:
    """The automaton of a suffix-closed set of contexts with next-symbol counts."""
    rows = [(len(c), int.from_bytes(c, "big"), x, n) for c, own in retained.items() for x, n in own.items()]
    return automaton(*(np.array(column, np.int64) for column in (zip(*rows) if rows else [()] * 4)))


def automaton(k: np.ndarray, ctx: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> Automaton:
    """As ``compiled``, of rows: context length, context, next symbol, count. States
    are the contexts and their prefixes, level by level; a prefix that is no context
    has the distribution of its suffix."""
    seen = np.unique(np.concatenate([symbol[k == 0], [SPACE, END]])).astype(np.int64)
    width = len(seen) + 1
    code = np.full(256, width - 1, np.int16)
    code[seen] = np.arange(len(seen))
    deepest = int(k.max(initial=0))
    states, closed = [], np.zeros(0, np.int64)
    for level in range(deepest, -1, -1):  # a prefix of a state is a state
        closed = np.unique(np.concatenate([ctx[k == level], closed >> 8, np.zeros(int(level == 0), np.int64)]))
        states.insert(0, closed)
    base = np.concatenate([[0], np.cumsum([len(own) for own in states])])
    follow, log = np.zeros((base[-1], width), np.int32), np.zeros((base[-1], width), np.float32)
    for level, own in enumerate(states):
        at = slice(base[level], base[level + 1])
        rows = k == level
        place, x, times = np.searchsorted(own, ctx[rows]), code[symbol[rows]], n[rows]
        total = np.bincount(place, times, minlength=len(own)).astype(np.float32)
        if level == 0:
            log[at] = ADDITIVE / (total[0] + ADDITIVE * SYMBOLS)
            log[0, x] = (times + ADDITIVE) / (total[0] + ADDITIVE * SYMBOLS)
        else:
            up = base[level - 1] + np.searchsorted(states[level - 1], own & ((1 << 8 * (level - 1)) - 1))
            follow[at] = follow[up]
            spread = np.bincount(place, minlength=len(own)).astype(np.float32)
            log[at] = log[up]
            log[at] *= (np.maximum(spread, 1e-30) / np.maximum(total + spread, 1e-30))[:, None]
            log[base[level] + place, x] += times / (total + spread)[place]
        if level < deepest:
            after = states[level + 1]
            follow[base[level] + np.searchsorted(own, after >> 8), code[after & 255]] = base[level + 1] + np.arange(len(after))
    np.log10(log, out=log)
    state = 0
    for _ in range(DEPTH):
        state = follow[state, code[END]]
    follow *= np.int32(width)
    return Automaton(code, log.ravel(), follow.ravel(), int(state) * width)


def log10_probabilities(model: Automaton, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log10 probability of each text of a stream."""
    lengths = starts[1:] - DEPTH - starts[:-1]
    pieces = -(-lengths // STRETCH)
    text = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = starts[:-1][text] + nth * STRETCH
    size = np.minimum(STRETCH, lengths[text] - nth * STRETCH)
    order = np.argsort(-size, kind="stable")
    first, size, text = first[order], size[order], text[order]
    symbols = model.symbol[data]
    total = np.zeros(len(text))
    state = np.zeros(len(text), np.int64)  # start of the automaton's row
    for j in range(-DEPTH, 0):  # the DEPTH bytes before tell the state
        state = model.follow[state + symbols[first + j]]
    live = len(text)
    alive = np.searchsorted(-size, -np.arange(STRETCH), side="left")  # stretches longer than j
    for j in range(int(size.max(initial=0))):
        live = int(alive[j])
        at = state[:live] + symbols[first[:live] + j]
        total[:live] += model.log[at]
        state[:live] = model.follow[at]
    return np.bincount(text, total, minlength=len(lengths))


def _scores(shared):
    @lean
    def run(batches):
        model = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, PART_ROWS):
                batch = whole.slice(a, PART_ROWS)
                score = log10_probabilities(model, *stream(*words(string_array(batch.column("text")))))
                keep = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(score)], names=[*keep, "score"])

    return run


def turned(ctx: np.ndarray, k: int) -> np.ndarray:
    """Contexts of k bytes with their bytes turned round: the suffixes of a context
    become its prefixes, so what is in order is so at each level."""
    return (ctx.astype(np.int64).byteswap().view(np.uint64) >> np.uint64(64 - 8 * k)).view(np.int64) if k else ctx.astype(np.int64)


class Sparse:
    """A part of a tree that is too large for an automaton: for each context length
    the grams (turned context, symbol) in order and their counts. Contexts, their totals
    and numbers of symbols follow from them, in the worker that scores."""

    def __init__(self, part: int, parts: int, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.part, self.parts, self.levels = part, parts, levels
        self.contexts: list[tuple[np.ndarray, ...]] = []

    def _contexts(self):
        for gram, n in self.levels if not self.contexts else ():
            ctx = gram >> 8
            head = heads(ctx)
            total = np.add.reduceat(n.astype(np.float64), head) if len(head) else np.zeros(0)
            self.contexts.append((ctx[head], total, np.diff(np.append(head, len(ctx))).astype(np.float32)))
        return self.contexts

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of the last symbol of each gram; grams of DEPTH turned
        bytes and a symbol, in order. A context is there only if its suffixes are, so
        each level looks at what is left, and once for each of its contexts."""
        p, left = np.zeros(len(keys)), np.arange(len(keys))
        context, symbol = keys >> 8, keys & 255
        for k, ((own, times), (contexts, total, spread)) in enumerate(zip(self.levels, self._contexts())):
            if k:
                if not len(contexts):
                    break
                mine = context >> 8 * (DEPTH - k)
                head = heads(mine)
                at = np.minimum(np.searchsorted(contexts, mine[head]), len(contexts) - 1)
                hit = contexts[at] == mine[head]
                size = np.diff(np.append(head, len(mine)))
                stays = np.repeat(hit, size)
                left, context, symbol, at = left[stays], context[stays], symbol[stays], np.repeat(at[hit], size[hit])
                gram = mine[stays] << 8 | symbol
            else:
                gram = symbol
            place = np.minimum(np.searchsorted(own, gram), max(0, len(own) - 1))
            n = np.where(own[place] == gram, times[place], 0) if len(own) else np.zeros(len(gram))
            p[left] = (n + spread[at] * p[left]) / (total[at] + spread[at]) if k else (n + ADDITIVE) / (times.sum() + ADDITIVE * SYMBOLS)
        return np.log10(p)


def heads(run: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)


def sparse(rows: DataFrame, part: int, parts: int) -> Sparse:
    """A part of the tree, collected level by level: 16 bytes a count."""
    levels, mine = [], (F.col("k") < 2) | (part_of(F.col("ctx"), parts) == part)
    for level in range(DEPTH + 1):
        own = rows.where(mine & (F.col("k") == level)).select("ctx", "symbol", "n").toArrow()
        gram, n = turned(own.column("ctx").to_numpy(), level) << 8 | own.column("symbol").to_numpy(), own.column("n").to_numpy()
        del own
        order = np.argsort(gram)
        levels.append((gram[order], n[order]))
        del gram, n, order
        trim()
    return Sparse(part, parts, levels)


def part_of(ctx, parts: int):
    """The part of a context of two bytes and more (a column or numbers): its last two bytes tell."""
    two = ctx.bitwiseAND(65535) if hasattr(ctx, "bitwiseAND") else ctx & 65535
    return two * 40503 % 65521 % parts


def _part_scores(shared):
    @lean
    def run(batches):
        model = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(a, SCORED_ROWS)
                data, starts = stream(*words(string_array(batch.column("text"))))
                seen = np.flatnonzero(np.bincount(data, minlength=256))
                bits = max(1, int(len(seen) - 1).bit_length())
                rows = min(batch.num_rows, 1 << 64 - (DEPTH + 1) * bits)  # 256 or all
                score = []
                for b in range(0, batch.num_rows, rows):
                    own = starts[b : b + rows + 1]
                    score.append(part_scores(model, data[own[0] - DEPTH : own[-1]], own - own[0] + DEPTH, seen, bits))
                yield pa.RecordBatch.from_arrays([batch.column("dk"), pa.array(np.concatenate(score))], names=["dk", "score"])

    return run


def part_scores(model: Sparse, data: np.ndarray, starts: np.ndarray, seen: np.ndarray, bits: int) -> np.ndarray:
    """Log10 probability, under a part of a tree, of each text of the stream. A gram,
    its bytes told by their place among those seen, and the number of its text share
    one number of 64 bits, so that a plain sort brings equal grams together."""
    texts = len(starts) - 1
    code = np.zeros(256, np.uint64)
    code[seen] = np.arange(len(seen))
    codes = code[data]
    keys = codes[DEPTH:].copy()
    for j in range(DEPTH):
        keys |= codes[j : j + len(keys)] << np.uint64(bits * (j + 1))
    length = starts[1:] - DEPTH - starts[:-1]
    text = np.repeat(np.arange(texts, dtype=np.uint64), length)
    # The grams that end in a text; the end signs between texts are no symbols.
    keys = keys[np.arange(len(text)) + np.repeat(starts[:-1] - DEPTH - (np.cumsum(length) - length), length)]
    room = np.uint64(64 - (DEPTH + 1) * bits)
    keys = keys << room | text
    keys.sort()
    packed = keys >> room
    head = heads(packed)
    packed, gram, byte = packed[head], np.zeros(len(head), np.int64), seen.astype(np.int64)
    for j in range(DEPTH + 1):
        gram |= byte[(packed >> np.uint64(bits * j) & np.uint64((1 << bits) - 1)).astype(np.int64)] << 8 * j
    each = np.zeros(len(gram))
    if model.parts > 1:
        own = part_of(gram >> 8 * DEPTH | gram >> 8 * (DEPTH - 2) & 0xFF00, model.parts) == model.part
        each[own] = model.log10(gram[own])
    else:
        each = model.log10(gram)
    each = np.repeat(each, np.diff(np.append(head, len(keys))))
    return np.bincount((keys & np.uint64((1 << int(room)) - 1)).astype(np.int64), each, minlength=texts)


def _cut(column, level):
    """The last ``level`` bytes of a gram."""
    return column.bitwiseAND(F.expr(f"shiftleft(1L, 8 * ({level})) - 1"))


def tree(counts: DataFrame, ws: Workspace, contexts: int | None = None) -> DataFrame:
    """``k, ctx, symbol, n``: the next-symbol counts of the retained contexts, k
    bytes long, of the corpus whose (DEPTH + 1)-grams are counted."""
    own, levels = counts, None
    for k in range(DEPTH, -1, -1):
        if k < DEPTH:
            own = own.groupBy(_cut(F.col("gram"), k + 1).alias("gram")).agg(F.sum("n").alias("n"))
            if k == DEPTH - 1:
                own = ws.table(own, "shorter")
        each = own.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("gram", "n")).alias("own"))
        # No suffix of a context is rarer than it.
        each = each.where(F.col("total") >= (LEAST_COUNT if k else 0)).select(F.lit(k).alias("k"), "ctx", "total", F.inline("own"))
        levels = each if levels is None else levels.unionByName(each)
    levels = ws.table(levels, "levels")
    tidy(counts.sparkSession)
    lower = levels.select((F.col("k") + 1).alias("k"), F.col("gram").alias("g"), F.col("n").alias("m"), F.col("total").alias("t"))
    both = levels.where("k > 0").withColumn("g", _cut(F.col("gram"), "k")).join(lower, ["k", "g"])
    gain = F.sum(F.col("n") * (F.log(F.col("n") / F.col("total")) - F.log(F.col("m") / F.col("t"))))
    passed = both.groupBy("k", "ctx").agg(gain.alias("gain")).where(F.col("gain") >= DIVERGENCE)
    if contexts is not None:
        passed = passed.orderBy(F.desc("gain"), "k", "ctx").limit(contexts)
    kept = passed.select("ctx", F.explode(F.sequence(F.lit(1), "k")).alias("k")).select("k", _cut(F.col("ctx"), "k").alias("ctx")).distinct()
    rows = levels.where("k > 0").join(kept, ["k", "ctx"], "left_semi").unionByName(levels.where("k = 0"))
    out = ws.table(rows.select("k", "ctx", F.col("gram").bitwiseAND(255).alias("symbol"), "n"), "tree")
    ws.drop("levels", "shorter")
    return out


def _arrays(rows: DataFrame) -> list[np.ndarray]:
    table = rows.select("k", "ctx", "symbol", "n").toArrow()
    return [table.column(c).to_numpy().astype(np.int64) for c in ("k", "ctx", "symbol", "n")]


def fit(counts: DataFrame, ws: Workspace, contexts: int | None = None) -> Automaton:
    """The automaton of the corpus whose (DEPTH + 1)-grams are counted."""
    return automaton(*_arrays(tree(counts, ws, contexts)))


def _scored(base: DataFrame, rows: DataFrame) -> DataFrame:
    """``base`` without its text, with the score of each row under the tree."""
    spark = base.sparkSession
    size, contexts, symbols = rows.agg(F.count("*"), F.count_distinct("k", "ctx"), F.count_distinct("symbol")).first()
    if contexts * (symbols + 1) <= CELLS:
        shared = spark.sparkContext.broadcast(automaton(*_arrays(rows)))
        keep = [f"{n} {t}" for n, t in base.dtypes if n != "text"]
        return base.mapInArrow(_scores(shared), ", ".join([*keep, "score double"]))
    parts, each = -(-size // PART_GRAMS), None
    for part in range(parts):
        shared = spark.sparkContext.broadcast(sparse(rows, part, parts))
        found = base.select("dk", "text").mapInArrow(_part_scores(shared), "dk long, score double").withColumn("part", F.lit(part))
        each = found if each is None else each.unionByName(found)
    # Repeated rows have equal scores.
    total = each.groupBy("dk", "part").agg(F.first("score").alias("score")).groupBy("dk").agg(F.sum("score").alias("score"))
    return base.drop("text").join(total, "dk")


def lm_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", contexts: int | None = None) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    ``train`` is a condition on the input's columns; the rows that it holds for
    teach. A null text is empty: its only token is the end. Equal rows each
    count. Without training rows every symbol is as likely as any other. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "lm")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("dk", F.xxhash64("doc_id", "text"))
    found = ws.table(base.select("dk", "train", "text").mapInArrow(_survey, "block long, word long, pos int, n long, gram long, blob binary"), "survey")
    counts = ws.table(found.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    tidy(spark)
    rows = tree(counts, ws, contexts)
    ws.drop("grams")
    tidy(spark)
    word = found.where("word is not null")
    count = ws.table(word.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")).where("c > 0"), "words")
    tidy(spark)
    total, kinds = count.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Counts go back to the blocks that share a word; others know them already.
    spread = word.join(count.where("blocks > 1").select("word", "c"), "word").groupBy("block").agg(F.collect_list("pos").alias("pos"), F.collect_list("c").alias("c"))
    blobs = found.where("blob is not null").select("block", "blob").join(spread, "block", "left").select("blob", "pos", "c")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a block
    bases = ws.table(blobs.mapInArrow(_base(int(total), int(kinds)), "dk long, n_tokens long, n_known long, base_score double").dropDuplicates(["dk"]), "base")
    small_batches(spark)
    ws.drop("survey", "words")
    tidy(spark)
    scored = _scored(base, rows)
    return scored.join(bases, "dk").select("doc_id", "train", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op3_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; those with crc32(doc_id) mod 10 = 0 teach nothing."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    out = lm_scores(read_table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
