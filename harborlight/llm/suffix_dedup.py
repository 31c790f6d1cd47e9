"""Removal of long repeated byte strings by sorting suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else. Sorting every suffix would move ``length`` bytes for every byte of text, so
suffixes are sampled by content: of the K-byte strings in a window of ``length``
bytes the one with the least hash is the window's *anchor*. Equal windows have
equal anchors at one offset, and a run of neighbouring windows shares one, so
sorting the suffixes that start at anchors, with the bytes before them, decides
every window.

1. One pass hashes each anchor (K bytes) and its *context* (all bytes of the
   windows that it stands for). Neighbours with one context (a periodic text has
   one per period) are one row with a count. Contexts are counted by a hash
   aggregate with map-side combining: copies become one row with a count.
   Anchors that occur once are done and dropped before that.
2. For the rest, one context of each kind is cut from the texts. Sampled
   splitters range-partition the suffixes by their leading bytes. Splitters are
   whole keys, so suffixes that agree in the key never fall on two sides of a
   boundary: neighbours across it differ within the key, and no repeat is lost.
3. Each bucket sorts its suffixes by multikey quicksort (three-way splits on
   eight bytes at a time), and the reversed bytes before the anchors likewise.
   Neighbours' common lengths in both orders say for each window offset which
   suffixes agree in the whole window, by bytes.
4. Repeated windows become byte ranges, which go back to every place where the
   context occurs, and are merged and cut out per document.

An anchor that occurs in very many contexts (a common short passage, a large
group of near copies) would load one bucket. Its contexts are split into blocks
of ``NARROW`` windows, whose key is all bytes that the block's windows share;
blocks that still share a key with more than ``WIDE`` others are split into single
windows, where repeats are equal keys: there a count of SHA-2 keys stands for the
sort, with the same result. So no group is capped, and none reaches one task whole.

Which places hold the same anchor and context is told by two 64-bit hashes
together, without comparing their bytes; the result is exact up to a collision of
all 128 bits.

Defined results: null and short texts lose nothing; ties don't arise (all places
of a repeated string lose it); a repeated row's text repeats and goes entirely if
it is long enough; an empty table gives an empty one; documents of any length are
hashed in segments of bounded size. Extra columns, whatever their names, stay as
they are and never meet the operator's own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, freed, partitions, release, sliced, small_batches, stored, with_fields

LENGTH = 400
NARROW = 32
#: Contexts that an anchor may have before it is split.
WIDE = 256
SEGMENT = 1 << 20
BUCKET_ROWS = 4000

_M1, _M2, _ODD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x5851F42D4C957F2D)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


with np.errstate(over="ignore"):
    _BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b)))) for b in (_ODD, inverse))


class Hashes:
    """Hashes of any substrings of one byte string, from running sums."""

    def __init__(self, b: np.ndarray) -> None:
        up, self.down = _powers(1 << max(14, len(b).bit_length()))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)])))

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return _mix(_mix((self.sums[end] - self.sums[start]) * self.down[start]) + np.asarray(salt).astype(np.uint64) * _M2 + (end - start).astype(np.uint64))


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbouring values, from running minima of blocks of w."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((x, pad)).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchor_bytes(length: int) -> int:
    """K for a length: 96 bytes at 400, so there are about five anchors in ``length`` bytes at most."""
    return max(1, length * 24 // 100)


def anchors(raw: bytes, length: int = LENGTH, segment: int = SEGMENT) -> list[np.ndarray]:
    """(at, first window, last window, anchor hash, context hash) of a text's anchors, by place."""
    k = anchor_bytes(length)
    found = [[] for _ in range(5)]
    for base in range(0, max(0, len(raw) - length + 1), segment - length + 1):
        b = np.frombuffer(raw, np.uint8)[base : base + segment]
        h = Hashes(b)
        i = np.arange(len(b) - k + 1)
        grams = h.of(i, i + k)
        # The place in the low bits makes the least value unique, the leftmost of equal strings.
        ranked = (grams & ~np.uint64(SEGMENT - 1)) | i.astype(np.uint64)
        at = (_window_least(ranked, length - k + 1) & np.uint64(SEGMENT - 1)).astype(np.int64)
        lo = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        hi = np.concatenate((lo[1:] - 1, [len(at) - 1]))
        at = at[lo]
        for out, x in zip(found, (at + base, lo + base, hi + base, grams[at], h.of(lo, hi + length, at - lo + 1)), strict=True):
            out.append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def collapsed(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Anchors with neighbours of one context as one, and how many they are. Their windows follow each other, hi - lo + 1 apart."""
    at, lo, hi, h, g = rows
    if not len(at):
        return [at, lo, hi, at, h, g]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
    times = np.diff(np.concatenate((new, [len(at)])))
    return [at[new], lo[new], hi[new], times, h[new], g[new]]


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of words by multikey quicksort, all groups of a level at once.

    A group of rows that agree in their first words is split by the next word
    into those below, at and above a pivot (the middle one of three); the rows at
    the pivot go on with the word after. Groups of one row are done.
    """
    n, width = words.shape
    order, group, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    active = np.arange(n)  # places in the order that aren't final yet
    while len(active) > 1:
        first = np.flatnonzero(np.concatenate(([True], group[active[1:]] != group[active[:-1]])))
        size = np.diff(np.concatenate((first, [len(active)])))
        rows = order[active]
        key = words[rows, depth[active]]
        pivot = np.repeat(np.sort(np.stack([key[first], key[first + size // 2], key[first + size - 1]]), axis=0)[1], size)
        part = 3 * np.repeat(np.arange(len(first)), size) + (key >= pivot) + (key > pivot)
        step = np.argsort(part, kind="stable")
        order[active], part = rows[step], part[step]
        new = np.concatenate(([True], part[1:] != part[:-1]))
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        depth[active] += part % 3 == 1
        alone = new & np.concatenate((new[1:], [True]))
        active = active[~alone & (depth[active] < width)]
    return order


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width)


def _neighbours(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common length of each row in that order with the one before)."""
    m = _padded(parts, width + -width % 8)
    order = multikey_order(m.view(">u8").astype(np.uint64))
    differ = m[order[1:]] != m[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate(([0], common))


def repeated(right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray, copies: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For suffixes and the bytes before each: ranges (first, last) of offsets d, low..high, whose window repeats.

    The window at offset d starts d bytes before the suffix. Two agree in it if
    the suffixes share length - d bytes and the bytes before share d.
    """
    n = len(right)
    r_order, r_common = _neighbours(right, length)
    l_order, l_common = _neighbours([x[::-1] for x in left], length)
    hits = np.zeros((n, int(high.max()) + 2), bool)
    r, lf = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(low.min()), int(high.max()) + 1):
        here = np.flatnonzero((low <= d) & (d <= high))
        if not len(here):
            continue
        r[r_order] = np.cumsum(r_common < length - d)
        lf[l_order] = np.cumsum(l_common < d)
        key = r[here] * (n + 1) + lf[here]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hits[here[order[1:][same]], d] = True
        hits[here[order[:-1][same]], d] = True
    for i in np.flatnonzero(copies > 1):
        hits[i, low[i] : high[i] + 1] = True
    edges = np.diff(np.concatenate((np.zeros((n, 1), np.int8), hits.astype(np.int8)), axis=1), axis=1)
    return [list(zip(np.flatnonzero(e == 1).tolist(), (np.flatnonzero(e == -1) - 1).tolist(), strict=True)) for e in edges]


_RANGES = "array<struct<start:int,end:int>>"
_RANGES_PA = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64), pa.int64())


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, source = [], []
            with np.errstate(over="ignore"):
                for i, t in enumerate(batch.column("text").to_pylist()):
                    rows.append(collapsed(anchors(t.encode(), length)))
                    source.append(np.full(len(rows[-1][0]), i))
            at = pa.array(np.concatenate([*source, np.zeros(0, np.int64)]).astype(np.int64))
            cols = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column("u1").take(at), batch.column("u2").take(at), *[pa.array(c.astype(np.int64)) for c in cols[:4]], _i64(cols[4]), _i64(cols[5])], ["u1", "u2", "at", "lo", "hi", "times", "h", "g"])

    return texts.mapInArrow(work, "u1 bigint, u2 bigint, at bigint, lo bigint, hi bigint, times bigint, h bigint, g bigint")


def _cut_contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (h, g, n, hot, rep) with the bytes of the contexts: before and after the anchor. One row each.

    Of rows that are repeated whole one is kept.
    """
    places = wanted.groupBy("rep.u1", "rep.u2").agg(F.collect_list(F.struct("h", "g", "n", "hot", "rep.at", "rep.lo", "rep.hi")).alias("places"))
    places = stored(places, "suffix-wanted")
    one = texts.join(places.select("u1", "u2").hint("merge"), ["u1", "u2"], "left_semi").groupBy("u1", "u2").agg(F.first("text").alias("text"))

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "g", "n", "hot", "low", "high", "left", "right"]
        kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int32()] * 2 + [pa.binary()] * 2
        for whole in sliced(batches):
            for a in range(0, len(whole), 50):
                batch, rows = whole.slice(a, 50), []
                for t, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                    raw = t.encode()
                    rows += [(p["h"], p["g"], p["n"], p["hot"], p["at"] - p["hi"], p["at"] - p["lo"], raw[p["lo"] : p["at"]], raw[p["at"] : p["hi"] + length]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], names)

    return one.join(places.hint("merge"), ["u1", "u2"]).select("text", "places").mapInArrow(work, "h bigint, g bigint, n bigint, hot boolean, low int, high int, left binary, right binary")


def _narrow_rows(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts cut into blocks of NARROW windows: h2 hashes what all windows of a block share, g2 the whole block.

    A block's suffix starts ``shift`` bytes before the context's; low and high count from there.
    """

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "g", "n", "shift", "h2", "g2", "low", "high", "left", "right"]
        kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.binary()] * 2
        for whole in batches:
            for a in range(0, len(whole), 200):
                rows = []
                for r in whole.slice(a, 200).to_pylist():
                    both, at = r["left"] + r["right"], len(r["left"])
                    for block in range(r["low"] // NARROW, r["high"] // NARROW + 1):
                        shift = block * NARROW
                        low, high = max(r["low"], shift), min(r["high"], shift + NARROW - 1)
                        core = both[at - shift : at - shift - NARROW + 1 + length]
                        part = both[at - high : at - low + length]
                        h2, g2 = (int.from_bytes(hashlib.blake2b(x, digest_size=8, salt=s).digest(), "little", signed=True) for x, s in ((core, b"core"), (part + bytes([low - shift]), b"part")))
                        rows.append((r["h"], r["g"], r["n"], shift, h2, g2, low - shift, high - shift, both[at - high : at - shift], both[at - shift : at - low + length]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(10)], names)

    return contexts.mapInArrow(work, "h bigint, g bigint, n bigint, shift int, h2 bigint, g2 bigint, low int, high int, left binary, right binary")


def _sorted_buckets(rows: DataFrame, length: int) -> DataFrame:
    """(h, g, ranges of repeated offsets) of rows (h, g, n, low, high, left, right, key), sorted in buckets of the key."""
    spark = rows.sparkSession
    # The splitters are sampled by the range partitioner; more buckets than tasks run at once keep each small.
    dealt = rows.repartitionByRange(max(partitions(spark), 1), "key").sortWithinPartitions("key").select("key", "h", "g", "n", "low", "high", "left", "right")

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solved() -> pa.RecordBatch:
            ranges = repeated([r[7] for r in held], [r[6] for r in held], np.array([r[4] for r in held]), np.array([r[5] for r in held]), np.array([r[3] for r in held]), length) if held else []
            got = [[{"start": a, "end": b} for a, b in x] for x in ranges]
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r in held], pa.int64()), pa.array([r[2] for r in held], pa.int64()), pa.array(got, _RANGES_PA)], ["h", "g", "offsets"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                # Runs of one key stay together; a key has WIDE rows at most.
                if len(held) >= BUCKET_ROWS and row[0] != held[-1][0]:
                    yield solved()
                    held = []
                held.append(row)
        yield solved()

    return dealt.mapInArrow(work, f"h bigint, g bigint, offsets {_RANGES}").where("size(offsets) > 0")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(u1, u2, spans): the ranges of bytes to remove, of each text that has some; see ``keyed``."""
    if length <= NARROW:
        raise ValueError(f"length must be over {NARROW} bytes")
    small_batches(docs.sparkSession)
    texts = keyed(docs, id_col, text_col).select("u1", "u2", "text").where(F.octet_length("text") >= length)
    every = stored(_anchor_rows(texts, length), "suffix-anchors")
    # Anchors that occur once are done, and their places go before contexts are made.
    # Stored, so that in the joins both sides come from an exchange of their own and a hot key's partition can be split.
    again = stored(every.groupBy("h").agg(F.sum("times").alias("total")).where("total > 1").select("h"), "suffix-again")
    release(docs.sparkSession)
    places = stored(every.join(again.hint("merge"), "h", "left_semi"), "suffix-places")
    discard(every, again)
    release(docs.sparkSession)
    contexts = places.groupBy("h", "g").agg(F.sum("times").alias("n"), F.min(F.struct("u1", "u2", "at", "lo", "hi")).alias("rep"))
    contexts = stored(contexts, "suffix-contexts")
    totals = stored(contexts.groupBy("h").agg(F.count("*").alias("kinds")), "suffix-shared")
    release(docs.sparkSession)
    shared = contexts.join(totals.hint("merge"), "h").select("h", "g", "n", "rep", (F.col("kinds") > WIDE).alias("hot"))
    cut = stored(_cut_contexts(texts, shared, length), "suffix-cut")
    discard(contexts, totals)
    release(docs.sparkSession)

    # Anchors in very many contexts, by blocks and then by single windows.
    split = stored(_narrow_rows(cut.where("hot"), length), "suffix-split")
    kinds = stored(split.groupBy("h2", "g2").agg(F.sum("n").alias("n"), F.min(F.struct("h", "g", "shift")).alias("rep")), "suffix-kinds")
    agree = stored(kinds.groupBy("h2").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1").select("h2", "kinds"), "suffix-agree")
    blocks = stored(split.drop("n").join(kinds.join(agree.hint("merge"), "h2").hint("merge"), ["h2", "g2"]), "suffix-blocks")
    discard(split, kinds, agree)
    one = blocks.where((F.col("h") == F.col("rep.h")) & (F.col("g") == F.col("rep.g")) & (F.col("shift") == F.col("rep.shift")))
    windows = one.where(F.col("kinds") > WIDE).select("h2", "g2", "n", F.col("high").alias("top"), F.concat("left", "right").alias("both"), F.explode(F.sequence("low", "high")).alias("d"))
    window = F.expr(f"substring(both, top - d + 1, {length})")
    windows = windows.select("h2", "g2", "n", "d", F.sha2(window, 256).alias("w"))
    again = windows.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select("w")
    singles = windows.join(again.hint("merge"), "w").groupBy("h2", "g2").agg(F.collect_list(F.struct(F.col("d").alias("start"), F.col("d").alias("end"))).alias("offsets"))
    # A key holds what a suffix's windows all share.
    direct = cut.where("not hot").select("h", "g", "n", "low", "high", "left", "right", F.expr(f"substring(right, 1, {anchor_bytes(length)})").alias("key"))
    narrow = one.where(F.col("kinds") <= WIDE).select(F.col("h2").alias("h"), F.col("g2").alias("g"), "n", "low", "high", "left", "right", F.expr(f"substring(right, 1, {length - NARROW + 1})").alias("key"))
    found_blocks = _sorted_buckets(narrow, length).union(singles)
    back = blocks.join(found_blocks.select(F.col("h").alias("h2"), F.col("g").alias("g2"), "offsets").hint("merge"), ["h2", "g2"]).select(
        "h", "g", F.expr("transform(offsets, o -> struct(o.start + shift as start, o.end + shift as end))").alias("offsets")
    )
    # One row per context: a context is either hot or sorted whole.
    back = back.groupBy("h", "g").agg(F.flatten(F.collect_list("offsets")).alias("offsets"))
    found = stored(_sorted_buckets(direct, length).union(back), "suffix-found")
    discard(cut, blocks)
    release(docs.sparkSession)
    spans = stored(_spans(places, found, length), "suffix-spans")
    discard(places, found)
    release(docs.sparkSession)
    return spans


def _spans(places: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(u1, u2, spans) from places and the offsets of their contexts: each place meets one row.

    Windows of collapsed neighbours all repeat, so their range is that of the first, longer by what the others add.
    Equal ranges (of rows that are repeated whole) are combined before the exchange.
    """
    more = "(times - 1) * (hi - lo + 1)"
    return (
        places.join(found.hint("merge"), ["h", "g"])
        .select("u1", "u2", F.expr(f"transform(offsets, o -> struct(at - o.end as start, at - o.start + {length} + {more} as end))").alias("spans"))
        .groupBy("u1", "u2").agg(F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"))
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as (u1, u2, text, row): a key that repeated rows share and no others, null texts as empty ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("u1"), F.xxhash64(text, F.lit("second"), F.col(id_col)).alias("u2"), text.alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))


#: Bytes of the longest run of ranges that are sorted by their starts.
_LONGEST = """aggregate(spans, struct(-1L as start, -1L as end, 0L as most),
    (run, s) -> if(s.start <= run.end, struct(run.start as start, greatest(run.end, s.end) as end, run.most as most), struct(s.start as start, s.end as end, greatest(run.most, run.end - run.start) as most)),
    run -> greatest(run.most, run.end - run.start))"""


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges that are sorted by their starts."""
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [tuple(x) for x in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = 0, least_words: int = 0) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``passage``, text follows: as ``removed`` gives it for strings of that
    many bytes (at most ``length``) and runs of ``least_words``. The columns before
    it are of the rule of ``length`` bytes all the same.
    """
    if passage > length:
        raise ValueError(f"passage must be at most {length} bytes")
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    rows = rows.select("u1", "u2", "text", "row.doc_id", F.col("row.text").isNull().alias("none"))
    if passage:
        passages = repeated_spans(docs, id_col, text_col, passage)
        # A string that repeats lies in one run of shorter ones that do, so only texts with a run of length bytes can lose any.
        long = passages.where(f"{_LONGEST} >= {length}").select("u1", "u2").hint("merge")
        docs = stored(rows.join(long, ["u1", "u2"], "left_semi").select("doc_id", "text"), "suffix-long")
        release(docs.sparkSession)
        spans = repeated_spans(docs, "doc_id", "text", length).hint("merge")
        discard(docs)
    else:
        spans = repeated_spans(docs, id_col, text_col, length).hint("merge")
    rows = rows.join(spans, ["u1", "u2"], "left")
    if passage:
        rows = rows.join(passages.select("u1", "u2", F.col("spans").alias("passages")).hint("merge"), ["u1", "u2"], "left")
    rows = rows.select("doc_id", "text", "none", "spans", *["passages"] * bool(passage))

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out, texts = [], batch.column("text").to_pylist()
            for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True):
                raw, spans = t.encode(), merged(s)
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(raw, spans)).hexdigest()))
            columns = [batch.column("doc_id"), *[pa.array([x[k] for x in out], pa.int64()) for k in range(3)], pa.array([x[3] for x in out], pa.string())]
            if passage:
                cut = zip(texts, batch.column("none").to_pylist(), batch.column("passages").to_pylist(), strict=True)
                columns.append(pa.array([None if none else cleaned(t, s, least_words) if s else t for t, none, s in cut], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * bool(passage)])

    return rows.mapInArrow(work, with_fields(rows, "doc_id", "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * bool(passage)))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_in(raw: bytes, start: int, end: int) -> int:
    """Whole words of a text in a range: those that a cut at an end has split don't count."""
    return sum((m.start() > start or start == 0 or raw[start - 1 : start].isspace()) and (m.end() < end or end == len(raw) or raw[end : end + 1].isspace()) for m in _WORD.finditer(raw, start, end))


def cleaned(text: str, spans: list | None, least_words: int) -> str:
    """A text without the runs of its sorted ranges, those of fewer whole words aside."""
    raw = text.encode()
    cut = [s for s in merged(spans) if not least_words or words_in(raw, *s) >= least_words]
    return without(raw, cut).decode("utf-8", "ignore") if cut else text


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """docs with repeated byte strings cut out of its texts; every other column, and null texts, as they are.

    Runs of fewer than ``least_words`` whole words stay. Bytes of a character that
    a cut has split are dropped.
    """
    rows = keyed(docs, id_col, text_col).join(repeated_spans(docs, id_col, text_col, length).hint("merge"), ["u1", "u2"], "left").select("row.*", F.col("spans").alias(free_name(docs, "spans")))
    names, at = docs.columns, docs.columns.index(text_col)

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            spans = batch.column(len(names)).to_pylist()
            texts = [cleaned(t, s, least_words) if s else t for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(at).type) if i == at else batch.column(i) for i in range(len(names))], names)

    return rows.mapInArrow(work, docs.schema)
