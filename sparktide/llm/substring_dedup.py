"""Removal of byte strings that repeat anywhere in the corpus.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else goes. Texts are parsed prefix-free: a rolling hash of ``GRAM`` bytes
triggers the cuts, so equal strings are cut alike wherever they stand. Each
window of LENGTH bytes is addressed by its first trigger and its distance from
it; windows at distances of one class of ``CLASS`` share an entry.

An entry has two names: ``core`` for the bytes that all of its windows have in
common, ``whole`` for all bytes they cover. Windows that repeat have cores that
repeat, so an entry with a core of its own is done with. An entry whose whole
repeats is a run of repeated windows. The few entries between (the ends of
matches) are settled window by window. Runs of entries form the phrases: what
is found out about an entry holds wherever its phrase stands, so it is found
once, in the dictionary, and the parse takes it to the texts. Names are counted
by partial aggregates: a passage that a third of all rows share costs no more
than any other.

Names (64-bit hashes) stand for intervals of the suffix arrays of dictionary
and parse: strings with equal names are neighbours in corpus order for at
least LENGTH bytes. The order between different names is never read, so
dictionary and parse are grouped, not sorted; see README.

Strings of a number of words are found in the same way, with ``CODE`` bytes (the
word's hash) in place of each word.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Workspace, lean, read_table, small_batches, tidy
from ._words import string_array, word_hashes

LENGTH, GRAM, CLASS = 400, 12, 64
#: Bytes that stand for a word.
CODE = 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: One place of so many is a trigger, for windows that have none at the first level on the second.
RATES = (128, 16)
#: One entry of so many ends a phrase.
PHRASE = 8
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
MULTIPLIER = np.uint32(0x01000193)


def trigger_places(data: np.ndarray) -> list[np.ndarray]:
    """Places at which the hash of GRAM bytes is a trigger, for each level."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * len(RATES)
    h = np.zeros(n, np.uint32)
    for j in range(GRAM):
        h *= MULTIPLIER
        h += data[j : j + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    fine = np.flatnonzero((h & np.uint32(RATES[1] - 1)) == 0)
    return [fine[(h[fine] & np.uint32(RATES[0] - 1)) == 0], fine]


def entries(n: int, places: list[list[int]], length: int = LENGTH):
    """``(level, class, core start, first window, last window)`` for a text of
    n bytes: each window is in one entry. ``core start`` is None for a window
    without triggers, which is an entry of its own."""
    last, reach = n - length, length - GRAM

    def at(level: int, x: int, y: int):
        """Entries of the windows x..y, which have no trigger of a lower level."""
        if level == len(places):
            for i in range(x, y + 1):
                yield level, 0, None, i, i
            return
        cuts = places[level]
        k = int(np.searchsorted(cuts, x))
        while x <= y and k < len(cuts):
            t = int(cuts[k])
            k += 1
            lo, hi = max(x, t - reach), min(t, y)
            if lo > x:
                yield from at(level + 1, x, min(lo - 1, y))
                x = lo
            if lo > hi:
                continue
            for c in range((t - hi) // CLASS, (t - lo) // CLASS + 1):
                yield level, c, t - CLASS * c, max(lo, t - CLASS * c - CLASS + 1), min(hi, t - CLASS * c)
            x = hi + 1
        if x <= y:
            yield from at(level + 1, x, y)

    return at(0, 0, last) if last >= 0 else ()


def _cut_blocks(view: memoryview, length: int = LENGTH) -> list[tuple[int, int, tuple]]:
    """Phrases of a text: ``(name, first window, entries)``. A phrase ends with
    an entry whose core says so, hence equal runs of entries are equal phrases."""
    digest, span = xxhash.xxh3_64_intdigest, length - CLASS + 1
    out, own, start = [], ([], [], [], []), None

    def close():
        arrays = tuple(np.array(x, kind) for x, kind in zip(own, (np.uint64, np.uint64, np.int32, np.int16)))
        out.append((digest(b"".join(a.tobytes() for a in arrays)), start, arrays))
        for x in own:
            x.clear()

    for level, c, core, lo, hi in entries(len(view), trigger_places(np.frombuffer(view, np.uint8)), length):
        start = lo if not own[0] else start
        whole = digest(view[lo : hi + length], seed=1)
        core = whole if core is None else digest(view[core : core + span], seed=level << 8 | c)
        for x, value in zip(own, (core, whole, lo - start, hi - lo + 1)):
            x.append(value)
        if core % PHRASE == 0:
            close()
    if own[0]:
        close()
    return out


NAMES = "dk long, phrases array<long>, starts array<array<int>>, phrase long, times long, start int, core array<long>, whole array<long>, lo array<int>, n array<smallint>"


def _raw(column, words: int | None):
    """The bytes of each text in which strings are looked for."""
    texts = string_array(column)
    if words is None:
        for text in texts.cast(pa.large_binary()):
            yield memoryview(text.as_buffer())
    else:
        hashes, ends = word_hashes(texts, lower=False)
        view = memoryview(hashes.view(np.uint8))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield view[a * CODE : b * CODE]


def _name_entries(batches, words: int | None = None):
    """Two kinds of rows: the parse (dk, phrases, starts) of each text, its distinct
    phrases and the places of each (a line that fills a text is one phrase of many
    places), and the dictionary: each distinct phrase of a batch with one place."""
    length = CODE * words if words else LENGTH
    ints, small = pa.list_(pa.int64()), pa.list_(pa.int32())
    places_kind = pa.list_(small)
    kinds = (pa.int64(), ints, places_kind, pa.int64(), pa.int64(), pa.int32(), ints, ints, small, pa.list_(pa.int16()))
    names = [part.split()[0] for part in NAMES.split(", ")]

    def rows(height, given):
        return pa.RecordBatch.from_arrays([given[n] if n in given else pa.nulls(height, k) for n, k in zip(names, kinds)], names=names)

    for batch in batches:
        dks, phrases, starts, known = batch.column("dk").to_pylist(), [], [], {}
        for dk, raw in zip(dks, _raw(batch.column("text"), words)):
            found = _cut_blocks(raw, length) if len(raw) >= length else []
            own: dict[int, list[int]] = {}
            for p, at, arrays in found:
                own.setdefault(p, []).append(at)
                known.setdefault(p, [0, dk, at, arrays])[0] += 1
            phrases.append(np.array(list(own), np.uint64).view(np.int64))
            starts.append(list(own.values()))
        if dks:
            yield rows(len(dks), {"dk": pa.array(dks, pa.int64()), "phrases": pa.array(phrases, ints), "starts": pa.array(starts, places_kind)})
        if known:
            times, places, at, arrays = zip(*known.values())
            core, whole, lo, n = zip(*arrays)
            given = {"dk": pa.array(places, pa.int64()), "phrase": pa.array(np.array(list(known), np.uint64).view(np.int64)), "times": pa.array(times, pa.int64()), "start": pa.array(at, pa.int32())}
            given |= {"core": pa.array([x.view(np.int64) for x in core], ints), "whole": pa.array([x.view(np.int64) for x in whole], ints), "lo": pa.array(lo, small), "n": pa.array(n, pa.list_(pa.int16()))}
            yield rows(len(known), given)


def _name_windows(batches, words: int | None = None):
    digest, length = xxhash.xxh3_64_intdigest, CODE * words if words else LENGTH
    for batch in batches:
        keys, places = [], []
        for view, runs in zip(_raw(batch.column("text"), words), batch.column("look").to_pylist()):
            own = sorted({i for r in runs for i in range(r["lo"], r["lo"] + r["n"])})
            keys.append(np.array([digest(view[i : i + length], seed=2) for i in own], np.uint64).view(np.int64))
            places.append(np.array(own, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("dk"), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["dk", "key", "at"])


def spans(n: int, runs: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows; runs: first window, number."""
    out: list[list[int]] = []
    for lo, k in sorted(runs):
        a, b = lo, min(n, lo + k - 1 + length)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def word_spans(text: bytes, runs: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes of words covered by strings of so many words; runs
    as for ``spans``, in the bytes that stand for the words."""
    places = [m.span() for m in WORD.finditer(text)]
    whole = [(-(-lo // CODE), (lo + k - 1) // CODE + 1) for lo, k in runs]
    cover = spans(len(places), [(a, b - a) for a, b in whole if b > a], words)
    return [(places[a][0], places[b - 1][1]) for a, b in cover]


def _cut_all(batches, whole_characters: bool = False, words: int | None = None):
    for batch in batches:
        found, rest = [], []
        raw = string_array(batch.column("text")).cast(pa.large_binary()).to_pylist()
        for text, marks, places in zip(raw, batch.column("marks").to_pylist(), batch.column("places").to_pylist()):
            runs = [(m["lo"], m["n"]) for m in marks or ()] + [(i, 1) for i in places or ()]
            own = word_spans(text, runs, words) if words else spans(len(text), runs)
            found.append([{"start": a, "stop": b} for a, b in own])
            ends = [0, *(x for s in own for x in s), len(text)]
            parts = [text[a:b] for a, b in zip(ends[::2], ends[1::2])]
            rest.append(b"".join(p.decode("utf-8", "ignore").encode() for p in parts) if whole_characters else b"".join(parts))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_bytes"), pa.array(found, kind), pa.array(rest, pa.binary())], names=["row", "n_bytes", "spans", "kept"])


def _marks(slim: DataFrame, ws: Workspace, words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``dk, marks``: the runs of repeated windows of each text, and ``dk, look``:
    runs of windows that have to be looked at one by one."""
    spark = slim.sparkSession
    named = ws.table(slim.mapInArrow(lean(partial(_name_entries, words=words)), NAMES), "names")
    dictionary = named.where("phrase is not null").select("phrase", "times", "dk", "start", F.inline(F.arrays_zip("core", "whole", "lo", "n")))
    twice = ws.table(dictionary.groupBy("core").agg(F.sum("times").alias("times")).where("times > 1").select("core"), "twice")
    tidy(spark)
    some = dictionary.join(twice, "core").select("phrase", "times", "core", "whole", "lo", "n", F.struct("dk", (F.col("start") + F.col("lo")).alias("lo")).alias("one"))
    some = ws.table(some, "entries")
    tidy(spark)
    wholes = ws.table(some.groupBy("core", "whole").agg(F.sum("times").alias("all"), F.min("one").alias("first")), "wholes")
    # Cores with an entry of which the whole is unique: its windows may repeat in other entries of the core.
    open_ = ws.table(wholes.groupBy("core").agg(F.min("all").alias("least"), F.count("*").alias("kinds")).where("least = 1 and kinds > 1").select("core", F.lit(True).alias("open")), "open")
    wholes = ws.table(wholes.join(open_, "core", "left").where("all > 1 or open"), "wholes-marked")
    run = F.struct("lo", F.col("n").cast("int").alias("n")).alias("run")
    full = some.join(wholes.where("all > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("phrase", run)
    full = ws.table(full.groupBy("phrase").agg(F.collect_set("run").alias("runs")), "full")
    look = some.join(wholes.where("open").select("core", "whole", "first"), ["core", "whole"]).where(F.col("one") == F.col("first"))
    look = look.select(F.col("one.dk").alias("dk"), F.struct(F.col("one.lo").alias("lo"), F.col("n").cast("int").alias("n")).alias("run"))
    look = ws.table(look.groupBy("dk").agg(F.collect_set("run").alias("look")), "look")
    ws.drop("entries", "wholes", "open", "wholes-marked", "twice")
    parse = named.where("phrases is not null").select("dk", F.inline(F.arrays_zip(F.col("phrases").alias("phrase"), F.col("starts").alias("starts"))))
    placed = parse.join(full, "phrase").groupBy("dk").agg(F.collect_set(F.struct("starts", "runs")).alias("placed"))
    moved = F.transform("placed", lambda p: F.flatten(F.transform(p["runs"], lambda r: F.transform(p["starts"], lambda at: F.struct((r["lo"] + at).alias("lo"), r["n"].alias("n"))))))
    marks = placed.select("dk", F.flatten(moved).alias("marks"))
    marks = ws.table(marks, "marks")
    ws.drop("names", "full")
    tidy(spark)
    return marks, look


def repeated_spans(docs: DataFrame, text_col: str = "text", whole_characters: bool = False, words: int | None = None) -> DataFrame:
    """``row, n_bytes, spans, kept`` for each input row.

    ``row`` is a struct of the input's columns but the text; ``spans`` are the
    maximal removed byte runs, ``kept`` the remaining bytes. Strings are judged
    on the input (with ``whole_characters`` a character that a cut would split
    goes whole), overlaps and repetitions within one text count. A null text
    is empty. Equal rows are rows of their own, so each repeats the other. Any
    further columns may have any names. An empty table gives an empty result.

    With ``words`` strings are of so many words (white space may differ) in
    place of LENGTH bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "substring")
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The key is that of row and text: rows that share it are equal, and so are their marks.
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(0).alias("none"))
    base = docs.select(row.alias("row"), text.alias("text")).withColumn("dk", F.xxhash64(F.to_json("row"), "text"))
    marks, look = _marks(base.select("dk", "text"), ws, words)
    both = ws.table(marks.join(look, "dk", "full"), "both")
    # The one shuffle of texts. Texts without marks are done with.
    all_ = ws.table(base.join(both, "dk", "left").withColumn("n_bytes", F.octet_length("text").cast("long")), "texts")
    hit = all_.where("marks is not null or look is not null")
    named = ws.table(hit.where("look is not null").select("dk", "text", "look").dropDuplicates(["dk"]).mapInArrow(lean(partial(_name_windows, words=words)), "dk long, key array<long>, at array<int>"), "windows")
    twice = ws.table(named.select(F.explode("key").alias("key")).groupBy("key").count().where("count > 1").select("key"), "windows-twice")
    tidy(spark)
    places = named.select("dk", F.inline(F.arrays_zip("key", "at"))).join(twice, "key").groupBy("dk").agg(F.collect_set("at").alias("places"))
    places = ws.table(places, "places")
    ws.drop("windows", "windows-twice", "marks", "look", "both")
    tidy(spark)
    cut = hit.join(places, "dk", "left").select("row", "n_bytes", "text", "marks", "places")
    schema = all_.select("row", "n_bytes").schema.add("spans", SPANS).add("kept", T.BinaryType())
    done = cut.mapInArrow(lean(partial(_cut_all, whole_characters=whole_characters, words=words)), schema)
    rest = all_.where("marks is null and look is null").select("row", "n_bytes", F.array().cast(SPANS).alias("spans"), F.col("text").cast("binary").alias("kept"))
    return done.unionByName(rest)


def op2_pfp_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings."""
    found = repeated_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; a character that
    a cut would split goes whole. ``n_chars`` follows the text."""
    found = repeated_spans(docs, whole_characters=True, words=words)
    out = found.select("row.*", F.decode("kept", "UTF-8").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
