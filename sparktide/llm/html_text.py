"""Main text of web pages by host suffix arrays.

A page is cut into blocks of text; containers that name themselves menus,
headers, footers, sidebars, notices, adverts, forms or comments are marked, and
so is what an ``article`` or ``main`` element holds; on pages with such an
element the rest is left out. The token streams of a host's pages (what is left
out too) are concatenated and their suffix array is sorted to a depth of
``LONG`` tokens: neighbours that agree so far and lie on distinct pages are a
repeated string. What such strings cover is boilerplate, on every page of the
host and inside ``article`` and ``main`` too; unique runs stay. Pages of a host
with equal main text are one page: they repeat nothing for each other.

Most strings stand on one page, and no array needs them: a first pass counts names
of few bits over all pages (a string that is on two pages is never missed, one of
some 256 others is kept in vain), and only the runs of tokens that strings of such
names cover go into the arrays.

A host of many tokens has an array for each ``ARRAY`` tokens. Its arrays count the
pages of each of their strings, and the counts are added up by name (a 64-bit
hash), so what repeats is found on the host as a whole, however it is dealt.

A page of which repeated strings cover more than ``COPY`` is either a short text
under long boilerplate or an edited copy of a page. What is unique tells them
apart: edits are runs of a word or two between repeated strings, a text of its
own has runs of ``LONG`` words and more (on average). A page with text of its own
loses all repeated strings, whatever they cover. A copy loses those that stand on
two pages with texts of their own, and keeps what only copies share.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, lean, read_table, small_batches, tidy
from ._words import mixed, shingle_hashes, string_array, word_hashes

LONG, ARRAY, COPY = 8, 500_000, 0.6
#: Pages whose strings are named at a time, strings held before they are handed on, and strings of a bucket.
SLICE, HELD, NAMED = 500, 1 << 21, 4_000_000
#: Names of strings that can repeat up to this number are broadcast (8 bytes each); beyond it they are joined.
KNOWN = 8_000_000
#: Bytes of the places to cut that are broadcast; with more, the texts are shuffled.
PLACES = 64 << 20

RAW = "script|style|noscript|template|iframe|object|svg|select|textarea|title|button|xmp"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that a new block ends by itself.
LOOSE = frozenset(["p", "li", "dt", "dd", "option", "tr", "td", "th"])
NOISE_TAGS = frozenset("head nav footer aside form menu dialog fieldset".split())
VOUCHED = frozenset(["article", "main"])
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar "
    "footer comment comments commentlist reply replies disqus cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended recommendations widget pagination pager toolbar copyright masthead skip".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def is_noise(tag: str, attrs: str, vouched: bool) -> bool:
    """Whether an element names itself something other than main text."""
    if tag in NOISE_TAGS or (tag == "header" and not vouched):
        return True
    if not attrs or tag in ("html", "body", *VOUCHED):
        return False
    for name, value, hidden in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value in NOISE_ROLES:
            return True
        if name in ("class", "id"):
            for part in value.split():
                words = re.split(r"[^a-z0-9]+", part)
                if {"with", "has", "no", "without"}.isdisjoint(words) and (words[0] in NOISE_NAMES or words[-1] in NOISE_NAMES):
                    return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """``(text, noise, vouched)`` of each block of text, in page order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, noise, vouched: with what stands above
    parts: list[str] = []
    state = (False, False)

    def close():
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((text, *state))
            parts.clear()

    def now():
        return stack[-1][1:] if stack else (False, False)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:-3]))
            continue
        tag = tag.lower()
        noise = not m["end"] and is_noise(tag, m["attrs"], state[1])
        if tag in VOID:
            if tag not in INLINE:
                if tag == "br":
                    parts.append(" ")
                else:
                    close()
            continue
        if tag in INLINE and not noise and not any(s[0] == tag for s in stack[-4:]):
            continue
        if m["end"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            close()
            if depth is not None:
                del stack[depth:]
        else:
            close()
            if tag not in INLINE:
                while stack and stack[-1][0] in LOOSE and (tag == stack[-1][0] or stack[-1][0] == "p"):
                    stack.pop()
            above = now()
            if not m["attrs"].endswith("/"):
                stack.append((tag, above[0] or noise, above[1] or tag in VOUCHED))
        state = now()
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


@lean
def _parse(batches):
    for batch in batches:
        texts, hosts, others, contents = [], [], [], []
        for url, page in zip(string_array(batch.column("url")).to_pylist(), string_array(batch.column("html")).to_pylist()):
            own = blocks(page)
            vouched = any(v and not n for _, n, v in own)
            kept = [not n and (v or not vouched) for _, n, v in own]
            texts.append([t for (t, _, _), k in zip(own, kept) if k])
            others.append("\n".join(t for (t, _, _), k in zip(own, kept) if not k))
            hosts.append(host_of(url))
            contents.append(xxhash.xxh3_64_intdigest("\0".join([hosts[-1], " ".join(texts[-1]) or "\0" + others[-1]])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(hosts, pa.string()), pa.array(np.array(contents, np.uint64).view(np.int64)), pa.array(texts, pa.list_(pa.string())), pa.array(others, pa.string())],
            names=["row", "host", "content", "texts", "others"],
        )


def string_pages(hashes: np.ndarray, page: np.ndarray, run: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of all places at which ``long`` tokens of one run start,
    sorted to that depth; where in it each distinct string begins (and the end);
    and on how many pages it stands. Pages ascend within a string if they do in
    ``page``, runs lie within a page."""
    n = len(hashes)
    if n < long:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(hashes, return_inverse=True)
    rank, depth = rank.astype(np.int64), 1
    while depth < long:
        step = min(depth, long - depth)
        follow = np.full(n, -1, np.int64)
        follow[: n - step] = np.where(run[step:] == run[: n - step], rank[step:], -1)
        _, rank = np.unique(rank * (n + 2) + follow + 1, return_inverse=True)
        depth += step
    order = np.argsort(rank[: n - long + 1], kind="stable")  # equal ranks are in the order of places
    order = order[run[order] == run[order + long - 1]]
    if not len(order):
        return order, np.zeros(1, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[True], rank[order[1:]] != rank[order[:-1]]])
    other = first | np.concatenate([[True], page[order[1:]] != page[order[:-1]]])
    head = np.flatnonzero(first)
    return order, np.append(head, len(order)), np.add.reduceat(other.astype(np.int64), head)


def repeated_strings(hashes: np.ndarray, page: np.ndarray, long: int = LONG) -> np.ndarray:
    """Places at which a string of ``long`` tokens starts that also starts on another page."""
    order, heads, pages = string_pages(hashes, page, page, long)
    return np.sort(order[np.repeat(pages > 1, np.diff(heads))])


def window_names(hashes: np.ndarray) -> np.ndarray:
    return mixed(shingle_hashes(hashes, LONG))


# --- which strings can repeat: names of few bits, counted over all pages -----


def _runs(batch):
    """The words of each row's main text and of what was left out (two runs a row),
    where the runs end, and of each string of LONG words: its place, run and name."""
    main = [" ".join(t) for t in batch.column("texts").to_pylist()]
    other = string_array(batch.column("others")).to_pylist()
    hashes, ends = word_hashes(pa.array([x for pair in zip(main, other) for x in pair], pa.large_string()), lower=False)
    n = np.maximum(np.diff(ends) - LONG + 1, 0)
    run = np.repeat(np.arange(len(n)), n)
    place = ends[:-1][run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    salt = np.array([xxhash.xxh3_64_intdigest(h) for h in batch.column("host").to_pylist()], np.uint64)
    names = window_names(hashes)[place] if len(place) else np.zeros(0, np.uint64)
    return hashes, ends, place, run, mixed(names ^ salt[run // 2])


def _slices(batches):
    for whole in batches:
        for a in range(0, whole.num_rows, SLICE):
            yield whole.slice(a, SLICE)


def packed_steps(values: np.ndarray) -> bytes:
    """Ascending numbers as steps of 16 bits; larger ones stand at the end."""
    step = np.diff(values, prepend=values[:1] * 0)
    long = step >= 0xFFFF
    return np.where(long, 0xFFFF, step).astype("<u2").tobytes() + step[long].astype("<u8").tobytes()


def unpacked_steps(data: bytes, n: int) -> np.ndarray:
    step = np.frombuffer(data, "<u2", n).astype(np.uint64)
    step[step == 0xFFFF] = np.frombuffer(data, "<u8", offset=2 * n)
    return np.cumsum(step, dtype=np.uint64)


def _sketch(bits: int, buckets: int):
    """``bucket, n, names, several``: the distinct names of many pages, cut to
    ``bits``, in ascending order, and which of them are on several of these pages.
    A name's first bits are its bucket."""
    low = np.uint64(bits - buckets)

    @lean
    def run(batches):
        held, size = [], 0

        def rows():
            value, content = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(value, kind="stable")
            value, content = value[order], content[order]
            head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            other = np.concatenate([[False], (value[1:] == value[:-1]) & (content[1:] != content[:-1])])
            several, value = np.maximum.reduceat(other, head), value[head]
            bucket, rest = (value >> low).astype(np.int64), value & ((np.uint64(1) << low) - np.uint64(1))
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(value)]))
            names = [packed_steps(rest[a:b]) for a, b in cuts]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[first]), pa.array([b - a for a, b in cuts], pa.int32()), pa.array(names, pa.binary()), pa.array([np.packbits(several[a:b]).tobytes() for a, b in cuts], pa.binary())],
                names=["bucket", "n", "names", "several"],
            )

        for batch in _slices(batches):
            _, _, _, own, names = _runs(batch)
            held.append((names >> np.uint64(64 - bits), batch.column("content").to_numpy()[own // 2]))
            size += len(names)
            if size > HELD:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return run


def _several(bits: int, buckets: int):
    """The names of a bucket that are on several pages."""

    def run(table: pa.Table) -> pa.Table:
        values, several = [], []
        for n, names, flags in zip(*(table.column(c).to_pylist() for c in ("n", "names", "several"))):
            values.append(unpacked_steps(names, n))
            several.append(values[-1][np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)])
        value = np.sort(np.concatenate(values))
        found = np.unique(np.concatenate([value[1:][value[1:] == value[:-1]], *several]))
        found |= np.uint64(table.column("bucket")[0].as_py()) << np.uint64(bits - buckets)
        return pa.table({"names": pa.array([found.view(np.int64)], pa.list_(pa.int64()))})

    return run


def _exploded(bits: int):
    """``rid, at, name``: a row for each string."""

    @lean
    def run(batches):
        for batch in _slices(batches):
            _, _, _, own, names = _runs(batch)
            row = own // 2
            at = np.arange(len(row)) - np.searchsorted(row, row)
            rid = batch.column("rid").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(at.astype(np.int32)), pa.array((names >> np.uint64(64 - bits)).view(np.int64))], names=["rid", "at", "name"])

    return run


STREAM = "host string, content long, size int, mains int, starts array<int>, lengths array<int>, words binary"


def _repeating(shared, bits: int):
    """The runs of words that strings with names in ``shared`` cover (strings at
    ``hits`` where that is None), of each row with such strings: ``mains`` runs of
    the main text, then of what was left out. A word is 32 bits of its hash."""

    @lean
    def run(batches):
        known = None if shared is None else shared.value
        for batch in _slices(batches):
            hashes, ends, place, own, names = _runs(batch)
            if known is not None:
                value = names >> np.uint64(64 - bits)
                at = np.minimum(np.searchsorted(known, value), max(0, len(known) - 1))
                hit = known[at] == value if len(known) else np.zeros(len(value), bool)
            else:
                hit, first = np.zeros(len(own), bool), np.searchsorted(own, 2 * np.arange(batch.num_rows))
                for a, own_hits in zip(first.tolist(), batch.column("hits").to_pylist()):
                    hit[a + np.asarray(own_hits, np.int64)] = True
            gone = np.zeros(len(hashes) + 1, np.int64)
            gone[: len(hashes)] += np.bincount(place[hit], minlength=len(hashes))
            gone -= np.bincount(place[hit] + LONG, minlength=len(gone))
            inside = np.cumsum(gone)[:-1] > 0
            edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
            # A run of words ends where the row's text does.
            edge = np.unique(np.concatenate([[0], edge, ends[:-1][np.diff(ends) > 0], [len(hashes)]]))
            start, stop = edge[:-1], edge[1:]
            keep = inside[start] if len(hashes) else np.zeros(0, bool)
            start, stop = start[keep], stop[keep]
            of = np.searchsorted(ends, start, side="right") - 1
            relative, length = (start - ends[of]).astype(np.int32), (stop - start).astype(np.int32)
            rows, head = np.unique(of // 2, return_index=True)
            cuts = list(zip(head.tolist(), [*head[1:].tolist(), len(of)]))
            small = pa.list_(pa.int32())
            data = [np.concatenate([hashes[x:y] for x, y in zip(start[a:b].tolist(), stop[a:b].tolist())]).astype("<u4").tobytes() for a, b in cuts]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("host").take(take), batch.column("content").take(take), pa.array(np.diff(ends)[2 * rows].astype(np.int32)), pa.array([int((of[a:b] % 2 == 0).sum()) for a, b in cuts], pa.int32()),
                    pa.array([relative[a:b] for a, b in cuts], small), pa.array([length[a:b] for a, b in cuts], small), pa.array(data, pa.binary()),
                ],
                names=["host", "content", "size", "mains", "starts", "lengths", "words"],
            )

    return run


def _streams(parsed: DataFrame, ws: Workspace) -> DataFrame:
    """The token streams of all pages without what cannot repeat (STREAM)."""
    spark = parsed.sparkSession
    pages = parsed.where((F.size("texts") > 0) | (F.col("others") != "")).select("rid", "host", "content", "texts", "others")
    total = pages.agg(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.length(t)) + F.length("others"))).first()[0] or 0
    bits = min(64, max(8, int(total // 4).bit_length() + 8))  # a name of one page is like another's about once in 256 times
    buckets = max(0, (int(total // 4) // NAMED).bit_length())
    sketch = pages.mapInArrow(_sketch(bits, buckets), "bucket long, n int, names binary, several binary")
    known = ws.table(sketch.groupBy("bucket").applyInArrow(_several(bits, buckets), "names array<long>"), "known")
    tidy(spark)
    size = known.agg(F.coalesce(F.sum(F.size("names")), F.lit(0))).first()[0]
    if size <= KNOWN:
        lists = known.toArrow().column("names").to_pylist() if size else []
        shared = spark.sparkContext.broadcast(np.sort(np.array([x for own in lists for x in own], np.int64).view(np.uint64)))
        return pages.mapInArrow(_repeating(shared, bits), STREAM)
    hits = pages.mapInArrow(_exploded(bits), "rid long, at int, name long").join(known.select(F.explode("names").alias("name")), "name")
    hits = ws.table(hits.groupBy("rid").agg(F.collect_list("at").alias("hits")), "places")
    return pages.join(hits, "rid").mapInArrow(_repeating(None, bits), STREAM)


# --- suffix arrays of hosts ----------------------------------------------------

HITS = "content long, size int, names array<long>, at array<int>, name long, pages int"


def _arrays(table: pa.Table) -> pa.Table:
    """For each main text its words and the places of strings in it that repeat
    in this array, with their names. Where the host has further arrays, also each
    string's name and number of pages; with one page, its places in the main text."""
    table = table.sort_by("content")
    contents, once, page_of = np.unique(table.column("content").to_numpy(), return_index=True, return_inverse=True)
    hashes = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("words").to_pylist()]).astype(np.uint64)
    starts, lengths = (table.column(c).to_pylist() for c in ("starts", "lengths"))
    # Page by page; of rows with equal main texts the first one's main text counts.
    runs = [(p, s if k < mains and r == first else -1, n if k >= mains or r == first else 0) for r, (p, first, mains) in enumerate(zip(page_of.tolist(), once[page_of].tolist(), table.column("mains").to_pylist())) for k, (s, n) in enumerate(zip(starts[r], lengths[r]))]
    page, start, use = (np.array(x, np.int64) for x in zip(*runs))
    length = np.concatenate([np.asarray(x, np.int64) for x in lengths])
    hashes = hashes[np.repeat(use > 0, length)]
    page, start, length = page[use > 0], start[use > 0], length[use > 0]
    run = np.repeat(np.arange(len(length)), length)
    place = np.where(start[run] >= 0, start[run] + np.arange(len(run)) - (np.cumsum(length) - length)[run], -1)  # in the main text
    order, heads, pages = string_pages(hashes, page[run], run)
    host = np.uint64(xxhash.xxh3_64_intdigest(table.column("host")[0].as_py()))
    names = mixed(window_names(hashes) ^ host).view(np.int64) if len(hashes) >= LONG else np.zeros(0, np.int64)
    ints, small = pa.list_(pa.int64()), pa.list_(pa.int32())
    n = len(contents)
    places = np.sort(order[np.repeat(pages > 1, np.diff(heads))])
    places = places[place[places] >= 0]
    cuts = np.searchsorted(page[run][places], np.arange(n + 1))
    own = [places[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    size = table.column("size").to_numpy()[once]
    given = [pa.array(contents), pa.array(size), pa.array([names[x] for x in own], ints), pa.array([place[x].astype(np.int32) for x in own], small), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())]
    out = pa.table(given, names=["content", "size", "names", "at", "name", "pages"])
    if table.column("arrays")[0].as_py() == 1 or not len(pages):
        return out
    n = len(pages)
    inside = np.repeat(pages == 1, np.diff(heads)) & (place[order] >= 0)
    string = np.repeat(np.arange(n), np.diff(heads))
    some = np.bincount(string[inside], minlength=n)
    at = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some)]).astype(np.int32), place[order][inside].astype(np.int32))
    content = pa.array(contents[page[run[order[heads[:-1]]]]], mask=some == 0)
    more = pa.table([content, pa.nulls(n, pa.int32()), pa.nulls(n, ints), at, pa.array(names[order[heads[:-1]]]), pa.array(pages.astype(np.int32))], names=out.column_names)
    return pa.concat_tables([out, more])


def has_own_text(size: int, at: list[int]) -> bool:
    """Whether a main text of ``size`` words is more than an edited copy, given
    the places of its repeated strings."""
    gone = np.zeros(size + 1, np.int64)
    np.add.at(gone, at, 1)
    np.add.at(gone, np.minimum(np.asarray(at, np.int64) + LONG, size), -1)
    own = np.cumsum(gone)[:size] == 0
    runs = np.count_nonzero(own[1:] & ~own[:-1]) + int(own[:1].any())
    return bool(runs) and (own.mean() >= 1 - COPY or own.sum() >= LONG * runs)


@lean
def _own(batches):
    for batch in batches:
        own = [has_own_text(n, at) for n, at in zip(batch.column("size").to_pylist(), batch.column("at").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("content"), batch.column("names"), batch.column("at"), pa.array(own, pa.bool_())], names=["content", "names", "at", "own"])


def unique_runs(texts: list[str], at: list[int] | None) -> str:
    """The blocks' words without those that the windows at ``at`` cover."""
    words = [t.split() for t in texts]
    n = sum(map(len, words))
    gone = np.zeros(n + 1, np.int64)
    for i in at or ():
        gone[i] += 1
        gone[min(n, i + LONG)] -= 1
    covered = np.cumsum(gone)[:n] > 0
    if not covered.any():
        return " ".join(texts)
    return " ".join(w for w, c in zip((w for t in words for w in t), covered) if not c)


def _extract(batches):
    for batch in batches:
        out = [unique_runs(texts, at) for texts, at in zip(batch.column("texts").to_pylist(), batch.column("at").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``row, text`` for each page; ``row`` is a struct of its columns but html.

    A null html is empty, a page without main text has an empty text; a null
    url is a host of its own kind (all such pages share it). Repeated rows are
    pages of their own. Columns may have any names; an empty table gives an
    empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "html")
    others = [c for c in pages.columns if c != "html"]
    row = F.struct(*(F.col(f"`{c}`") for c in others))
    base = pages.select(row.alias("row"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = base.select("row").schema.add("host", "string").add("content", "long").add("texts", _ddl("array<string>")).add("others", "string")
    parsed = ws.table(base.mapInArrow(_parse, schema).withColumn("rid", F.monotonically_increasing_id()), "parsed", level=9)
    streams = ws.table(_streams(parsed, ws), "streams", level=9)
    hosts = streams.groupBy("host").agg(F.ceil(F.sum(F.octet_length("words")) / 4 / ARRAY).alias("arrays"))
    dealt = streams.join(hosts, "host").withColumn("part", F.pmod("content", "arrays"))
    found = ws.table(dealt.groupBy("host", "part").applyInArrow(_arrays, HITS), "found")
    ws.drop("streams", "known", "places")
    tidy(spark)
    names = found.where("name is not null")
    # A string has at most one row an array.
    split = names.groupBy("name").agg(F.sum("pages").alias("pages"), F.collect_list(F.when(F.col("content").isNotNull(), F.struct("content", "at"))).alias("single")).where("pages > 1")
    split = split.select("name", F.inline("single")).select("content", F.lit(0).alias("size"), F.array_repeat("name", F.size("at")).alias("names"), "at")
    hits = found.where("name is null").select("content", "size", "names", "at").unionByName(split)
    hits = hits.groupBy("content").agg(F.max("size").alias("size"), F.flatten(F.collect_list("names")).alias("names"), F.flatten(F.collect_list("at")).alias("at")).where("size(at) > 0")
    hits = ws.table(hits.mapInArrow(_own, "content long, names array<long>, at array<int>, own boolean"), "hits")
    ws.drop("found")
    tidy(spark)
    # Names hold the host's. What copies have in common with two texts of their own:
    each = hits.select("own", F.explode(F.array_distinct("names")).alias("name"))
    common = each.groupBy("name").agg(F.count_if("own").alias("texts"), F.count_if(~F.col("own")).alias("copies")).where("texts > 1 and copies > 0").select("name")
    copies = hits.where("not own").select("content", F.inline(F.arrays_zip(F.col("names").alias("name"), "at")))
    copies = copies.join(common, "name", "left_semi").groupBy("content").agg(F.collect_list("at").alias("at"))
    hits = ws.table(hits.where("own").select("content", "at").unionByName(copies), "gone")
    ws.drop("hits")
    rows, places = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    if 32 * rows + 4 * places <= PLACES:
        hits = F.broadcast(hits)
    out = parsed.select("row", "content", "texts").join(hits.select("content", "at"), "content", "left")
    return out.select("row", "texts", "at").mapInArrow(_extract, base.select("row").schema.add("text", "string"))


def _ddl(kind: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(kind)


def op4_host_suffix_array(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    out = main_texts(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
