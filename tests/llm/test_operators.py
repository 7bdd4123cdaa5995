"""The training-data operators against brute force, with awkward rows."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").encode().lower())


# --- 1 ---


def test_lpt_takes_the_least_loaded_shard():
    from sparktide.llm.sharding import lpt

    sizes = [7, 7, 6, 5, 5, 4]
    assert lpt(sizes, 2) == [0, 1, 0, 1, 1, 0]


def test_sharding(spark, docs, doc_rows, empty):
    from sparktide.llm.sharding import shard_balanced

    out = shard_balanced(docs, 4).collect()
    assert len(out) == len(doc_rows)
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in doc_rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    by_shard, shard_of = collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        by_shard[r.shard].append(r.slot)
        shard_of[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in shard_of.values())
    loads = collections.Counter()
    for r in out:
        loads[r.shard] += r.size
    groups = collections.Counter()
    for r in doc_rows:
        groups[r[1] or ""] += len((r[1] or "").encode()) + 1
    ideal = sum(groups.values()) / 4
    assert max(loads.values()) <= max(ideal * 4 / 3 + 2, max(groups.values()))
    assert shard_balanced(empty).count() == 0


# --- 2 ---


def removed(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append(bytes(b for b, m in zip(t, mark) if not m))
    return out


def test_substring_dedup(spark, docs, doc_rows, empty):
    from sparktide.llm.substring_dedup import LENGTH, repeated_spans, without_repeats

    got = collections.Counter((r.row.doc_id, r.n_bytes, bytes(r.kept)) for r in repeated_spans(docs).collect())
    texts = [(r[1] or "").encode() for r in doc_rows]
    want = collections.Counter((r[0], len(t), k) for r, t, k in zip(doc_rows, texts, removed(texts, LENGTH)))
    assert got == want
    assert repeated_spans(empty).count() == 0
    kept = without_repeats(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == len(doc_rows)


def test_every_window_has_one_entry():
    from sparktide.llm.substring_dedup import LENGTH, entries, trigger_places

    rng = np.random.default_rng(3)
    for data in (rng.integers(97, 101, 3000).astype(np.uint8), np.full(1500, 97, np.uint8), np.tile(np.frombuffer(b"abcdefg ", np.uint8), 200)):
        places = sorted(i for *_, lo, hi in entries(len(data), trigger_places(data)) for i in range(lo, hi + 1))
        assert places == list(range(len(data) - LENGTH + 1))


# --- 3 ---


def test_suffix_tree(spark, docs, doc_rows, empty):
    from pyspark.sql import functions as F

    from sparktide.llm.suffix_tree_lm import lm_scores

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    out = lm_scores(docs, ~held).collect()
    is_held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    counts = collections.Counter(w for r in doc_rows if not is_held(r[0]) for w in [*words(r[1]), b"\n"])
    total, kinds = sum(counts.values()), len(counts)
    want = collections.Counter()
    for r in doc_rows:
        ws = [*words(r[1]), b"\n"]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        want[(r[0], len(ws), sum(counts[w] > 0 for w in ws), round(base, 4))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == want
    assert all(r.train_tokens == total and r.score < 0 for r in out)
    assert lm_scores(empty, ~held).count() == 0


def test_tree_is_a_distribution_and_takes_the_longest_suffix():
    import pyarrow as pa

    from sparktide.llm import suffix_tree_lm as lm
    from sparktide.llm._words import words as split

    texts = ["the cat sat on the mat", "a cat", "", "zebra! the"]
    counted = collections.defaultdict(collections.Counter)
    data, starts = lm.stream(*split(pa.array(texts, pa.large_string())))
    for a, b in zip(starts[:-1], starts[1:] - lm.DEPTH):
        for i in range(a, b):
            for k in range(lm.DEPTH + 1):
                counted[bytes(data[i - k : i])][int(data[i])] += 1
    retained = {c: dict(n) for c, n in counted.items() if len(c) <= 2}
    model = lm.compiled(retained)
    width = len(set(model.symbol.tolist()))
    seen = np.bincount(model.symbol, minlength=width)
    prob = 10.0 ** model.log.reshape(-1, width)
    unseen = lm.SYMBOLS - (width - 1)
    assert seen[-1] >= unseen
    np.testing.assert_allclose(prob[:, :-1].sum(axis=1) + prob[:, -1] * unseen, 1, rtol=1e-5)

    def p(context, byte):
        own = retained.get(context)
        if not context:
            return (own.get(byte, 0) + lm.ADDITIVE) / (sum(own.values()) + lm.ADDITIVE * lm.SYMBOLS)
        if own is None:
            return p(context[1:], byte)
        return (own.get(byte, 0) + len(own) * p(context[1:], byte)) / (sum(own.values()) + len(own))

    score = lm.log10_probabilities(model, data, starts)
    for k, (a, b) in enumerate(zip(starts[:-1], starts[1:] - lm.DEPTH)):
        assert score[k] == pytest.approx(sum(math.log10(p(bytes(data[i - 2 : i]), int(data[i]))) for i in range(a, b)), rel=1e-4)


def test_all_contexts_that_pass_are_retained(spark):
    """More contexts than 32768 pass the test of divergence, and all are states."""
    from sparktide.llm import suffix_tree_lm as lm
    from sparktide.llm._common import Workspace

    # Each context of two symbols with its own next symbol, and suffixes that tell nothing.
    rng = np.random.default_rng(1)
    a, b = np.meshgrid(np.arange(33, 243), np.arange(33, 243))
    follow = rng.integers(33, 243, a.size)
    grams = [(int(x) << 16 | int(y) << 8 | int(z), 20) for x, y, z in zip(a.ravel(), b.ravel(), follow)]
    counts = spark.createDataFrame(grams, "gram long, n long")
    model = lm.fit(counts, Workspace(spark, "test"))
    width = int(model.symbol.max()) + 1
    assert len(model.log) // width > 44100 > 32768


def test_contexts_of_six_bytes_tell(spark):
    """The sixth byte back decides the next one."""
    import pyarrow as pa

    from sparktide.llm import suffix_tree_lm as lm
    from sparktide.llm._common import Workspace
    from sparktide.llm._words import words as split

    keys, n = lm.grams(*lm.stream(*split(pa.array(["xabcdey zabcdew " * 500], pa.large_string()))), np.array([True]))
    model = lm.fit(spark.createDataFrame(list(zip(keys.tolist(), n.tolist())), "gram long, n long"), Workspace(spark, "test"))
    state = model.start
    for byte in b"xabcde":
        state = model.follow[state + model.symbol[byte]]
    assert 10 ** model.log[state + model.symbol[ord("y")]] > 0.9 > 0.1 > 10 ** model.log[state + model.symbol[ord("w")]]


def test_trees_that_outgrow_a_broadcast_are_scored_in_parts(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    from sparktide.llm import suffix_tree_lm as lm

    train = F.col("doc_id") % 5 != 0
    whole = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, train).collect()}
    monkeypatch.setattr(lm, "CELLS", 0)
    monkeypatch.setattr(lm, "PART_GRAMS", 2000)
    parts = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, train).collect()}
    assert parts.keys() == whole.keys()
    for k, v in whole.items():
        assert parts[k] == pytest.approx(v, rel=1e-4)


def test_parts_score_texts_of_many_bytes():
    """More than 128 byte values leave room for 256 texts at a time; empty and long texts among them."""
    import pyarrow as pa

    from sparktide.llm import suffix_tree_lm as lm
    from sparktide.llm._words import words as split

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.choice(np.r_[32:127, 161:700, 20000:20300], rng.integers(0, 40)))) for _ in range(600)]
    texts[7], texts[300] = "", "ab " * 5000
    data, starts = lm.stream(*split(pa.array(texts, pa.large_string())))
    assert len(set(data.tolist())) > 128
    counted = collections.defaultdict(collections.Counter)
    for a, b in zip(starts[:-1], starts[1:] - lm.DEPTH):
        for i in range(a, b):
            for k in range(4):
                counted[bytes(data[i - k : i])][int(data[i])] += 1
    levels = []
    for k in range(lm.DEPTH + 1):
        own = sorted((int.from_bytes(c[::-1], "big") << 8 | x, n) for c, follow in counted.items() if len(c) == k for x, n in follow.items())
        levels.append((np.array([g for g, _ in own], np.int64), np.array([n for _, n in own], np.int64)))

    class Shared:
        value = lm.Sparse(0, 1, levels)

    batch = pa.RecordBatch.from_pydict({"dk": np.arange(600), "text": texts})
    found = np.concatenate([b.column("score").to_numpy() for b in lm._part_scores(Shared)([batch])])
    np.testing.assert_allclose(found, lm.log10_probabilities(lm.compiled(counted), data, starts), rtol=1e-4)


# --- 4 ---


def test_main_text(spark):
    from sparktide.llm.html_text import main_texts

    boiler = "<div>Read our latest stories about gardens and rivers every single morning here</div>"
    rows = [
        (1, "http://a.org/1", "<html><head><title>t</title></head><nav>menu</nav><article><h1>One &amp; two</h1><p>Hel<b>lo</b> wor\n ld<p>next<br>line</article><footer>f</footer>"),
        (2, None, None), (3, "http://a.org/3", ""), (4, "x", "plain &lt;text&gt; <script>var a='</p>'</script> end"),
        (5, "http://b.org/5", boiler + "<p>Alone I stand among the tall green trees of the quiet valley tonight my friend</p><div class='comments'>hi</div>"),
        (6, "http://b.org/6", boiler + "<p>Something else entirely was written on this other page about mountains and snow</p><form>q</form>"),
        (7, "http://c.org/7", "<main><p>Kept</p><aside>side</aside><div class=\"ad\">buy</div><div hidden>no</div></main>"),
    ]
    df = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, rid int")
    got = {r.row.page_id: r.text for r in main_texts(df).collect()}
    assert got == {
        1: "One & two Hello wor ld next line", 2: "", 3: "", 4: "plain <text> end", 7: "Kept",
        5: "Alone I stand among the tall green trees of the quiet valley tonight my friend", 6: "Something else entirely was written on this other page about mountains and snow",
    }
    assert main_texts(df.where("page_id < 0")).count() == 0


def test_strings_that_repeat_inside_articles(spark):
    """Boilerplate that an article element holds goes too; pages of equal text repeat nothing for each other."""
    from sparktide.llm.html_text import main_texts

    own = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(4)]
    notice = "Write to us every week and we will send you all our stories for free"
    rows = [(k, f"http://d.org/{k}", f"<nav>menu</nav><article><p>{own[k]}</p><p>{notice}</p></article>") for k in range(3)]
    rows += [(k, f"http://e.org/{k}", f"<nav>menu {k}</nav><main><p>{own[3]}</p></main>") for k in (4, 5)]
    got = {r.row.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: own[0], 1: own[1], 2: own[2], 4: own[3], 5: own[3]}


def test_short_texts_under_long_boilerplate(spark):
    """Strings that cover most of a page go; an edited copy of a page stays."""
    from sparktide.llm.html_text import main_texts

    boiler = " ".join(f"menu{j}" for j in range(60))
    own = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(3)]
    text = [f"t{j}" for j in range(80)]
    edited = [*text[:20], "edit", *text[21:50], "edits", *text[51:]]
    notice = " ".join(f"n{j}" for j in range(10))
    rows = [(k, f"http://g.org/{k}", f"<div>{boiler}</div><p>{own[k]}</p>") for k in range(3)]
    rows += [(3, "http://g.org/3", f"<div>{boiler}</div>")]
    long = [" ".join(f"l{k}x{j}" for j in range(40)) for k in range(2)]
    rows += [(10 + k, f"http://h.org/{k}", f"<p>{long[k]}<p>{notice}") for k in range(2)]
    rows += [(12 + k, f"http://h.org/{2 + k}", f"<p>{' '.join(t)}<p>{notice}") for k, t in enumerate((text, edited))]
    got = {r.row.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: own[0], 1: own[1], 2: own[2], 3: "", 10: long[0], 11: long[1], 12: " ".join(text), 13: " ".join(edited)}


def test_strings_of_large_hosts(spark, monkeypatch):
    """The bound of an array does not change what repeats on a host."""
    import random

    from sparktide.llm import html_text

    rng = random.Random(9)
    shared = [" ".join(f"s{k}x{j}" for j in range(rng.randint(8, 14))) for k in range(20)]
    rows = []
    for k in range(40):
        own = [" ".join(f"w{k}x{j}x{i}" for j in range(15)) for i in range(3)]
        rows.append((k, f"http://f.org/{k}", f"<nav>{shared[k % 7]}</nav><article><p>{own[0]}<p>{shared[k // 2]}<p>{own[1]}<p>{own[2]}</article>", " ".join(own)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    for size in (html_text.ARRAY, 150):
        monkeypatch.setattr(html_text, "ARRAY", size)
        assert all(r.text == r.row.want for r in html_text.main_texts(pages).collect())


def test_main_texts_by_brute_force(spark, monkeypatch):
    """Every string of LONG words that two pages of a host share goes, however names are held."""
    import random

    from sparktide.llm import html_text

    rng = random.Random(5)
    shared = [" ".join(f"s{k}x{j}" for j in range(rng.randint(8, 30))) for k in range(6)]
    rows, words = [], {}
    for k in range(30):
        parts = [" ".join(f"w{k}x{j}x{i}" for j in range(rng.randint(9, 20))) for i in range(4)]
        parts.insert(2, shared[rng.randrange(6)])
        rows.append((k, f"http://h{k % 3}.org/{k}", f"<nav>{shared[k % 2]}</nav><article>{''.join(f'<p>{p}' for p in parts)}</article>"))
        words[k] = [" ".join(parts).split(), shared[k % 2].split()]
    rows += [(k + 100, *rows[k][1:]) for k in range(3)] + [rows[4]]  # copies are one page

    def strings(k):
        return {tuple(run[i : i + 8]) for run in words[k] for i in range(len(run) - 7)}

    want = {}
    for k in range(30):
        other = set().union(*(strings(x) for x in range(30) if x != k and x % 3 == k % 3))
        main = words[k][0]
        gone = {i + j for i in range(len(main) - 7) if tuple(main[i : i + 8]) in other for j in range(8)}
        want[k] = " ".join(w for i, w in enumerate(main) if i not in gone)
    want |= {k + 100: want[k] for k in range(3)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for known, held, array in ((html_text.KNOWN, html_text.HELD, html_text.ARRAY), (0, 50, 60)):
        for name, value in (("KNOWN", known), ("HELD", held), ("ARRAY", array)):
            monkeypatch.setattr(html_text, name, value)
        got = html_text.main_texts(pages).collect()
        assert len(got) == len(rows) and all(r.text == want[r.row.page_id] for r in got)


def test_repeated_strings_by_brute_force():
    from sparktide.llm.html_text import LONG, repeated_strings

    rng = np.random.default_rng(5)
    hashes, page = rng.integers(0, 2, 400).astype(np.uint64), np.repeat(np.arange(8), 50)
    windows = collections.defaultdict(list)
    for i in range(len(hashes) - LONG + 1):
        if page[i] == page[i + LONG - 1]:
            windows[tuple(hashes[i : i + LONG])].append(i)
    want = sorted(i for own in windows.values() if len({page[i] for i in own}) > 1 for i in own)
    assert repeated_strings(hashes, page).tolist() == want


# --- 5 ---


def test_fingerprints(spark, docs, doc_rows, empty):
    from sparktide.llm.fingerprints import with_successors

    out = with_successors(docs).collect()
    rows = sorted(((r[0], r[1] or "") for r in doc_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = collections.Counter()
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        want[(i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    text_of = {i: t for i, t in rows}
    by_text = collections.defaultdict(set)
    for r in out:
        by_text[text_of[r.doc_id]].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    plain = [r for r in out if r.doc_id is not None and 2 < r.doc_id < 55]  # no copies
    assert np.mean([r.near_edited for r in plain]) > 0.05 > np.mean([r.near_next for r in plain])
    assert with_successors(empty).count() == 0


def test_fingerprints_of_large_and_null_ids(spark):
    """Ids beyond 2**53 beside null ids lose no row and meet their successors; fingerprints by brute force."""
    from sparktide.llm import fingerprints as fp

    ids = [None, None, *(2**53 + k for k in range(1, 60))]
    texts = {i: f"w{k} w{k + 1} w{k % 7} some words of text {k}" for k, i in enumerate(ids[2:])}
    rows = [(None, "a b"), (None, "a c"), *texts.items()]
    got = fp.with_successors(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    order = ["a b", "a c", *(texts[i] for i in ids[2:])]
    by_text = {}
    for k, text in enumerate(order):
        following = order[(k + 1) % len(order)]
        half = len(text) // 2
        by_text[(ids[k], hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest())] = text

    def brute(text):
        words = [np.uint64(xxhash.xxh3_64_intdigest(w)) for w in text.split()]
        pairs = fp.kmers(np.array(words, np.uint64)).tolist()
        seen, numbered = collections.Counter(), []
        for x in pairs:
            numbered.append(int(fp.mixed(np.array([(x + seen[x] * int(fp.STEP)) % 2**64], np.uint64))[0]))
            seen[x] += 1
        out = []
        for xor, odd in zip(fp.XORS[:, 0].tolist(), fp.ODDS[:, 0].tolist()):
            best = sorted(range(len(pairs)), key=lambda i: (numbered[i] ^ xor) * odd % 2**64)[: fp.PICK]
            value = 0
            for i in sorted(best):
                value = int(fp.mixed(np.array([(value * int(fp.STEP) + pairs[i]) % 2**64], np.uint64))[0])
            out.append(value >> 48)
        return "".join(f"{v:04x}" for v in out)

    for r in got:
        assert r.fingerprint == brute(by_text[(r.doc_id, r.edited_sha256)])


def test_order_counts():
    from sparktide.llm.fingerprints import likeness, sketch

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    moved, edited = np.concatenate([a[150:], a[:150]]), a.copy()
    edited[::60] += np.uint64(1)
    assert likeness(sketch(a), sketch(a.copy())) == 1
    assert likeness(sketch(a), sketch(moved)) < likeness(sketch(a), sketch(edited))
    assert likeness(sketch(a), sketch(a + np.uint64(5))) < 0.1


# --- 6 ---


def test_packing(spark, docs, doc_rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparktide.llm.packing import packed

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    out = packed(docs).collect()
    ids = {(r[0], r[1]): np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in doc_rows}
    pieces = collections.Counter()
    for r in doc_rows:
        own = ids[(r[0], r[1])]
        first = len(own) if len(own) <= 2048 else len(own) % 2048 or 2048
        for k, (s, n) in enumerate([(0, first), *((s, 2048) for s in range(first, len(own), 2048))]):
            pieces[(r[0], k, s, n, zlib.crc32(own[s : s + n].tobytes()))] += 1
    assert collections.Counter((r.row.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(bins) <= -(-total // 2048) + 1
    assert packed(empty).count() == 0


def test_genetic_algorithm_keeps_all_documents():
    import random

    from sparktide.llm.packing import evolve

    rng = random.Random(4)
    lengths = [rng.randint(1, 2048) for _ in range(500)]
    population = evolve(lengths, [], 2048, 1)
    for bins in population:
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 2048 for b in bins)
    assert len(population[0]) <= 1.05 * sum(lengths) / 2048 + 1


# --- 7 ---


def test_quality(spark, docs, empty):
    from sparktide.llm.quality import fit, held_out, scored

    rows = [(i, ("Good words stand here in line " * 5 if i % 3 else "BUY!! NOW!! CHEAP!! ") + f"w{i}", int(i % 3 > 0)) for i in range(300)]
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = both.select("doc_id", "quality")
    model = fit(both, labels.where(~held_out()))
    got = scored(both, model).collect()
    assert np.mean([(r.score >= 0.7) == bool(r.row.quality) for r in got]) > 0.98
    awkward = scored(docs, model).collect()
    assert len(awkward) == docs.count() and all(0 <= r.score <= 1 for r in awkward)
    assert scored(empty, model).count() == 0
    none = fit(both, labels.where("doc_id < 0"))
    assert {r.score for r in scored(both, none).collect()} == {0.5}


# --- 8 ---


def test_warc(spark, tmp_path):
    from sparktide.llm.warc import read_warc, write_warc

    rows = [(3, "http://a/\r\nX: y", "same"), (1, "http://b", "same"), (2, None, None), (5, "u", ""), (7, "u", "ünï\r\n\r\nWARC/1.1"), (None, "n", "only")]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, payload int, first string")
    path = f"file://{tmp_path}/warc"
    write_warc(pages, path)
    got = {r.page_id: r for r in read_warc(spark, path).collect()}
    for i, _, t in rows:
        data = (t or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert (got[3].record_type, got[3].refers_to, got[1].record_type, got[1].refers_to) == ("revisit", 1, "response", None)
    assert (got[5].refers_to, got[2].record_type, bytes(got[7].payload)) == (2, "response", rows[4][2].encode())
    some = read_warc(spark, path).where("record_type = 'response' and page_id in (1, 7)")
    assert sorted(r.page_id for r in some.collect()) == [1, 7]
    assert all(r.payload is None for r in read_warc(spark, path, payload=False).collect())
    write_warc(pages.where("page_id < 0"), f"file://{tmp_path}/none")
    assert read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_of_repeated_rows(spark, tmp_path):
    """One response for equal rows and for rows without an id; record ids are unique."""
    from sparktide.llm.warc import read_warc, write_warc

    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "same"), (None, "n", "none"), (None, "n", "none"), (9, "n", "none")]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/repeated")
    got = read_warc(spark, f"file://{tmp_path}/repeated").collect()
    kinds = sorted((r.payload_digest, r.record_type, r.page_id or 0, r.refers_to or 0) for r in got)
    same, none = sorted({k[0] for k in kinds}, key=lambda d: d != base64.b32encode(hashlib.sha1(b"same").digest()).decode())
    assert sorted(kinds) == sorted([(same, "response", 1, 0), (same, "revisit", 1, 1), (same, "revisit", 1, 1), (none, "response", 9, 0), (none, "revisit", 0, 9), (none, "revisit", 0, 9)])
    assert len({r.record_id for r in got}) == len(rows)


def test_unwanted_payloads_are_not_inflated():
    import io
    import random

    from sparktide.llm.warc import encode, records

    noise = random.Random(1).randbytes(60000)
    data = [encode({"record_type": "response" if k % 2 else "revisit", "page_id": k, "payload": noise}) for k in range(4)]
    broken = bytearray(data[2])
    broken[5000:5400] = b"?" * 400  # nobody sees it
    for chunk in (700, 1 << 20):
        got = list(records(io.BytesIO(b"".join([data[0], data[1], bytes(broken), data[3]])), lambda r: r["record_type"] == "response", True, chunk=chunk))
        assert [r[4] for r in got] == [1, 3] and all(r[-1] == noise for r in got)


def test_unwanted_payloads_are_skipped():
    import io

    from sparktide.llm.warc import encode, records

    data = b"".join(encode({"record_type": "response" if k % 2 else "revisit", "page_id": k, "payload": bytes([65 + k]) * 5000}) for k in range(6))
    got = list(records(io.BytesIO(data), lambda r: r["record_type"] == "response", True, chunk=777))
    assert [r[4] for r in got] == [1, 3, 5] and all(r[-1] == bytes([65 + r[4]]) * 5000 for r in got)


# --- 9 ---


def test_decontamination(spark, docs, doc_rows, empty):
    from sparktide.llm.decontaminate import decontaminated, overlaps

    item = " ".join(f"token{k}" for k in range(30))
    changed = item.split()
    for k in (4, 13, 22):
        changed[k] = "other"
    far = item.split()
    far[::2] = ["other"] * 15
    rows = [(900, f"before it {item} after", None), (901, "X " + " ".join(changed).upper() + "!", None), (902, " ".join(far), None), (903, " ".join(item.split()[5:20]), None), (904, item[:40], None)]
    more = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "a b", 0)], "item_id long, text string, t int")
    assert {(r.doc_id, r.item_id) for r in overlaps(more, bench).collect()} == {(900, 1), (901, 1), (903, 1)}
    left = decontaminated(more, bench)
    assert left.columns == ["doc_id", "text", "source"] and left.count() == more.count() - 3
    assert overlaps(empty, bench).count() == 0 and overlaps(docs, bench.where("item_id < 0")).count() == 0


# --- 10 ---


def test_near_duplicates(spark, docs, doc_rows, empty):
    from sparktide.llm.near_dedup import near_duplicates

    def shingles(t):
        w = words(t)
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])

    rows = [(r[0], shingles(r[1])) for r in doc_rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(b)] = find(a)
    least = {}
    for k, (i, s) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    want = collections.Counter()
    for k, (i, s) in enumerate(rows):
        ids = [x for x in least[find(k)] if x is not None]
        comp = min(ids) if ids else None
        want[(i, len(s), comp, i == comp)] += 1
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()) == want
    assert near_duplicates(empty).count() == 0


def test_links_that_no_star_sees(spark):
    """A family whose members differ from the centre each in their own way."""
    import random

    from sparktide.llm.near_dedup import near_duplicates

    rng = random.Random(2)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(70):
        own = base.copy()
        for _ in range(rng.randint(2, 9)):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(own)
    texts += [[*t[:-1], "end"] for t in texts[:30]]
    sets = [frozenset(tuple(t[k : k + 5]) for k in range(len(t) - 4)) for t in texts]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == dict(enumerate(label))
