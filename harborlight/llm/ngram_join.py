"""N-gram Jaccard join: exact components of documents with similar shingle sets.

Two documents link when 100 * |A and B| >= percent * |A or B|. The steps:

1. Shingles are hashed to 64 bits; documents with one set are one *class*, kept
   by a 128-bit set hash (copies are never expanded into pairs). The result is
   exact up to collisions of these hashes. Lists and links name classes, so ids
   may be of any type that can be ordered.
2. Candidate groups. Linked sets differ in at most H elements, where H follows
   from their sizes. Cut the hash space into H + 1 parts: linked sets agree in
   a whole part. So every class is listed under a signature per part (for the
   size band it may share with slightly larger or smaller sets). A part holds
   about nine shingles at 90 percent and four at 80, from all over the text. A
   part of common shingles only, or of none, would make long lists of strangers:
   common shingles are told from counts over all texts, and instead of such parts others are
   listed with one element left out, which finds the same links (see
   ``signatures``). Lists of the same members are one group, and lists of one
   member are dropped.
3. Every member of a group is compared with the group's first member, and links
   so found are contracted; then, some rounds, those of its components with a
   member of another component. A group of near copies collapses here
   with as many comparisons as members.
4. Token-group matrix. Shingles fall into ``COLUMNS`` columns by hash; a set's row
   of the matrix holds how many it has in each. The sum of the smaller counts
   bounds how much two sets can share, so only pairs of sets whose bound reaches
   their need are opened. Groups that still span several components are cut into
   blocks. A first pass over the rows alone drops the members that no other can
   qualify with; only blocks of the rest fetch their shingles. There a block's
   token union bounds each query's overlap once more before members are compared.
5. Components of all links.

No step caps a list. A block holds ``BLOCK`` sets at most, and pairs of blocks
are separate units of work, so a large group spreads over many tasks.

Defined results: null, empty and word-less texts have no shingles and link with
nothing (a component of their own id); every row is a document of its own, also
where ids or whole rows are repeated; null ids link by their text, near copies
included, but never are a component's name, unless nothing else is (then null);
at exactly ``percent`` documents link; an empty table gives an empty one. Texts of
any length are taken whole, some MB of a batch at a time. Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, freed, joinable, release, sliced, small_batches, stored, with_fields

BLOCK = 256
COLUMNS = 256
SHARED = 1 << 14
#: Rounds in which groups are contracted by comparing their members with one of them.
ROUNDS = 4
SEEN = 200_000
#: Links whose components one task makes: 4 MB.
FEW_LINKS = 1 << 18
#: A shingle is common in so many of so many texts; how many common ones are remembered.
OFTEN, PER, MOST_COMMON = 4, 150_000, 1_000_000
#: Entries that a task packs at once, and how many bits of a signature and of a counted shingle don't travel.
PACKED, CUT, COUNTED_CUT = 1 << 20, 16, 24
M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b)))) for b in (BASE, inverse))


LETTER = mix(np.arange(1, 257, dtype=np.uint64) * M3)
LETTER[65:91] = LETTER[97:123]
GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True


def shingles(raw: bytes, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text (A-Z lower-cased); fewer words: one of all."""
    b = np.frombuffer(raw, np.uint8)
    gap = np.concatenate(([True], GAP[b], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(12, len(b).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTER[b] * up[: len(b)])))
    w = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * M3 + w[i : len(w) - k + 1 + i])
    return np.unique(h)


@cache
def bands(percent: int, top: int = 1 << 40) -> list[tuple[int, int]]:
    """(least size, H) of each size band, twice as wide as a link spans. A link joins one band or two neighbours.

    H bounds the difference of two linked sets of which the smaller is in the
    band: |A xor B| * (100 + percent) <= (100 - percent) * (|A| + |B|).
    """
    out, low = [], 1
    while low < top:
        up = low * 100 // percent * 100 // percent + 1
        out.append((low, (100 - percent) * (up - 1 + (up - 1) * 100 // percent) // (100 + percent)))
        low = up
    return out


def signatures(s: np.ndarray, percent: int, common: np.ndarray | None = None, cut: int = 0) -> np.ndarray:
    """Signatures of a set: linked, different sets have one in common.

    For the band that the set is in, and for the one below if a link can reach
    there. With H + 1 parts at least one is equal in both sets. Parts with a rare
    element (one not in ``common``, a sorted array of hashes without their last
    ``cut`` bits) are listed as they are.

    If all equal parts lack rare elements, they are at most the q such parts of
    either set, and the H differences lie in the others: at most q - 1 of those
    hold two differences or more. So among the first parts, of which q more than
    those with at most one rare element are taken, one differs in a single
    element only and keeps a rare one: these parts are listed once with each
    element left out. A set that hasn't enough such parts takes all of them, and
    its rarest elements besides, as many as it can differ in and one more. If both
    sets lack parts, they share one of those; if one doesn't, its parts are among
    the other's. So any ``common`` gives all links; a good one gives short lists.
    """
    table = bands(percent)
    at = int(np.searchsorted([b[0] for b in table[:400]], len(s), side="right")) - 1
    rare = np.ones(len(s), bool)
    if common is not None and len(common):
        known = s >> np.uint64(cut) << np.uint64(cut)
        rare = common[np.minimum(np.searchsorted(common, known), len(common) - 1)] != known
    out, lacking = [], False
    for tag in (at, at - 1):
        if tag < 0 or not (parts := table[tag][1] + 1) > 1 or (tag < at and percent * len(s) > 100 * (table[at][0] - 1)):
            continue
        part = (mix(s ^ M3) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        value, scarce = mix(s[order] + np.uint64(tag + 1)), rare[order]
        size, good = np.bincount(part, minlength=parts), np.bincount(part, rare, minlength=parts).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        total = np.zeros(parts, np.uint64)
        total[size > 0] = np.add.reduceat(value, first[size > 0])
        full = np.flatnonzero(good)
        out.append(mix(total[full] + mix(np.uint64(tag) * M1 + full.astype(np.uint64))))
        if q := parts - len(full):
            enough = np.flatnonzero(np.arange(1, parts + 1) >= np.cumsum(good <= 1) + q)
            lacking |= not len(enough)
            for p in full[full <= (enough[0] if len(enough) else parts)]:
                own = slice(first[p], first[p] + size[p])
                left = (total[p] - value[own])[good[p] - scarce[own] > 0]
                out.append(mix(np.append(left, total[p]) + mix(np.uint64(tag) * M2 + np.uint64(p))))
    if lacking:
        out.append(mix(s[np.lexsort((s, ~rare))[: (100 - percent) * len(s) // 100 + 1]] ^ BASE))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _packed(value: np.ndarray, other: np.ndarray, buckets: int, cut: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, values and what goes with each) of sorted 64-bit words, of which the last ``cut`` bits are dropped: differences, by bytes of one place, compressed."""
    if not len(value):
        return
    bucket = (value >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(value), np.int64)
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(value)], strict=True):
        step = np.diff(value[lo:hi] >> np.uint64(cut), prepend=np.uint64(0))
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(hi - lo, -1).T).tobytes() for x in (step, other[lo:hi])]
        yield int(bucket[lo]), pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, kind: type, cut: int) -> tuple[np.ndarray, np.ndarray]:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, n * (8 + width), codec="zstd", asbytes=True), np.uint8)
    step, other = (np.ascontiguousarray(x.T).view(k).ravel() for x, k in ((raw[: 8 * n].reshape(8, n), np.uint64), (raw[8 * n :].reshape(width, n), kind)))
    return np.cumsum(step, dtype=np.uint64) << np.uint64(cut), other


def buckets_for(rows: int) -> int:
    """A power of two: the hash space is cut into so many buckets, of about a million entries each."""
    return 1 << max(6, (rows // 4000).bit_length())


def _by_bucket(df: DataFrame, work: Callable[[list[tuple]], pa.RecordBatch], fields: str) -> DataFrame:
    """work on the rows (as tuples of Python values) of each bucket."""

    @freed
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != at and held:
                    yield work(held)
                    held = []
                at = row[0]
                held.append(row)
        if held:
            yield work(held)

    return df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, fields)


class _Seen:
    """Whether a set is met for the first time in a task, as far as a memory of SEEN sets reaches."""

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()

    def first(self, key: tuple[int, int]) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(key)
        return True


def common_shingles(texts: DataFrame, n: int, rows: int) -> np.ndarray:
    """Sorted hashes (without their last ``COUNTED_CUT`` bits) of the shingles that many different texts hold: ``OFTEN`` of each ``PER`` texts, ``OFTEN`` at least.

    All texts are counted. A task counts its own before it hands them on, packed;
    of copies in a task one counts. At most ``MOST_COMMON`` hashes are remembered
    (the most frequent ones): which they are decides how long lists are, never
    which links are found.
    """
    buckets, least = buckets_for(rows), max(OFTEN, OFTEN * rows // PER)

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, _Seen()

        def told() -> pa.RecordBatch:
            x, k = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]) >> np.uint64(COUNTED_CUT), return_counts=True)
            held.clear()
            x, k = x << np.uint64(COUNTED_CUT), np.minimum(k, 0xFFFF).astype(np.uint16)
            packed = list(_packed(x, k, buckets, COUNTED_CUT))
            ends = np.searchsorted((x >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64), np.array([b for b, _ in packed], np.int64), side="right")
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int64()), pa.array(np.diff(ends, prepend=0).astype(np.int64)), pa.array([x for _, x in packed], pa.binary())], ["bucket", "n", "blob"])

        for batch in sliced(batches):
            with np.errstate(over="ignore"):
                sets = _sets(batch.column("text").to_pylist(), n)
                keys = zip(*(k.tolist() for k in _keys(sets)), strict=True)
            held += [s for s, k in zip(sets, keys, strict=True) if len(s) and seen.first(k)]
            size += sum(map(len, sets))
            if size > PACKED:
                yield told()
                size = 0
        yield told()

    def merged(rows: list[tuple]) -> pa.RecordBatch:
        x, k = (np.concatenate(c) for c in zip(*(_unpacked(blob, n, np.uint16, COUNTED_CUT) for _, n, blob in rows), strict=True))
        order = np.argsort(x)
        x, k = x[order], k[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        x, k = x[first], np.add.reduceat(k, first)
        return pa.RecordBatch.from_arrays([pa.array(x[k >= least].view(np.int64)), pa.array(k[k >= least])], ["shingle", "k"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], ["x"])

    seen = stored(_by_bucket(texts.select("text").where(F.col("text").isNotNull()).mapInArrow(work, "bucket bigint, n bigint, blob binary"), merged, "shingle bigint, k bigint"), "ngram-common")
    # Few numbers of texts are met; those from some number on are as many as can be remembered.
    most, total = F.least("k", F.lit(1 << 12)), 0
    for row in sorted(seen.groupBy(most.alias("k")).count().collect(), reverse=True):
        total += row[1]
        if total > MOST_COMMON:
            least = row[0] + 1
            break
    out = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[0], np.int64) for r in seen.where(F.col("k") >= least).select("shingle").mapInArrow(listed, "x binary").collect())])
    discard(seen)
    return np.sort(out.view(np.uint64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit hashes of each set."""
    return [np.array([mix(s ^ m).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for m in (M3, M2)]


def _sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    return [shingles((t or "").encode(), n) for t in texts]


def profile(docs: DataFrame, n: int) -> DataFrame:
    """Per row (doc_id, text, at): doc_id, at, n_shingles, k1, k2 (the set's hash)."""

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            with np.errstate(over="ignore"):
                sets = _sets(batch.column("text").to_pylist(), n)
                keys = _keys(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, keys)], ["doc_id", "at", "n_shingles", "k1", "k2"])

    return docs.mapInArrow(work, with_fields(docs, "doc_id", "at bigint, n_shingles bigint, k1 bigint, k2 bigint"))


def listing(texts: DataFrame, percent: int, n: int, common: np.ndarray, buckets: int = 64) -> DataFrame:
    """Lists of two sets or more as (sig, k1), a row per member; k1 stands for the set.

    Of rows with one set in a partition only the first is listed (as far as a
    memory of SEEN sets reaches), so a large group of copies leaves each task as
    one. Signatures travel packed: sorted, as differences, with the place of their
    set in a table.
    """

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, owners, size = _Seen(), [], [], 0

        def told() -> pa.RecordBatch:
            sig = np.concatenate([*held, np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), np.array([len(x) for x in held], np.int64))
            order = np.argsort(sig)
            sig, owner, table = sig[order], owner[order], np.array(owners, np.int64)
            rows, lo = [], 0
            ends = np.searchsorted((sig >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64), np.arange(buckets), side="right")
            for hi in ends.tolist():
                if hi > lo:
                    # Only the sets of this bucket; they are numbered anew.
                    here, place = np.unique(owner[lo:hi], return_inverse=True)
                    ((bucket, blob),) = _packed(sig[lo:hi], place.astype(np.uint32), buckets, CUT)
                    rows.append((bucket, hi - lo, blob, table[here].tobytes()))
                lo = hi
            held.clear()
            owners.clear()
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["bucket", "n", "blob", "sets"])

        for batch in sliced(batches):
            with np.errstate(over="ignore"):
                sets = _sets(batch.column("text").to_pylist(), n)
                k1, k2 = (k.tolist() for k in _keys(sets))
                for s, a, b in zip(sets, k1, k2, strict=True):
                    if len(s) and seen.first((a, b)):
                        held.append(signatures(s, percent, common, COUNTED_CUT))
                        owners.append(a)
                        size += len(held[-1])
                        if size > PACKED:
                            yield told()
                            size = 0
        yield told()

    def merged(rows: list[tuple]) -> pa.RecordBatch:
        sigs, keys = [], []
        for _, n, blob, table in rows:
            sig, place = _unpacked(blob, n, np.uint32, CUT)
            sigs.append(sig)
            keys.append(np.frombuffer(table, np.int64)[place])
        sig, k1 = np.concatenate(sigs), np.concatenate(keys)
        # Most stand alone: only the others are sorted by both.
        order = np.argsort(sig)
        sig, k1 = sig[order], k1[order]
        same = np.concatenate(([False], sig[1:] == sig[:-1], [False]))
        again = same[1:] | same[:-1]
        sig, k1 = sig[again], k1[again]
        if not len(sig):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["sig", "k1"])
        order = np.lexsort((k1, sig))
        sig, k1 = sig[order], k1[order]
        other = np.concatenate(([True], (sig[1:] != sig[:-1]) | (k1[1:] != k1[:-1])))
        sig, k1 = sig[other], k1[other]
        same = np.concatenate(([False], sig[1:] == sig[:-1], [False]))
        again = same[1:] | same[:-1]
        return pa.RecordBatch.from_arrays([pa.array(sig[again].view(np.int64)), pa.array(k1[again])], ["sig", "k1"])

    return _by_bucket(texts.select("text").where(F.col("text").isNotNull()).mapInArrow(work, "bucket bigint, n bigint, blob binary, sets binary"), merged, "sig bigint, k1 bigint")


def only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of texts (at, text) whose ``at`` is wanted, and few others: those of which 32 bits agree. Of rows of one ``at`` in a task one stays.

    Most texts are in no list. They are dropped where they are read, so they don't
    travel to a join; four bytes of each wanted one go to the tasks.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes()], pa.binary())], ["x"])

    blobs = wanted.select("at").mapInArrow(listed, "x binary").collect()
    known = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r[0], np.uint32) for r in blobs)]))

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = batch.column(0).to_numpy()
            head = (at.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
            here = np.flatnonzero(known[np.minimum(np.searchsorted(known, head), len(known) - 1)] == head) if len(known) else []
            new = [i for i in here if not (at[i] in seen or seen.add(at[i]))]
            if new:
                yield batch.take(pa.array(new, pa.int64()))

    return texts.mapInArrow(work, texts.schema)


def sets_of(rows: DataFrame, n: int) -> DataFrame:
    """rep, n, the row of the matrix and the sorted shingles of rows (rep, k1, k2, text).

    Texts whose set isn't that of the key are left out.
    """

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            with np.errstate(over="ignore"):
                sets = _sets(batch.column("text").to_pylist(), n)
                k1, k2 = _keys(sets)
            same = np.flatnonzero((k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy()))
            sets = [sets[i] for i in same]
            counts = [np.bincount((s % np.uint64(COLUMNS)).astype(np.int64), minlength=COLUMNS).astype(np.int32).tolist() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(same)), pa.array([len(s) for s in sets], pa.int64()), pa.array(counts, pa.list_(pa.int32())), _lists(sets)], ["rep", "n", "counts", "shingles"])

    return rows.mapInArrow(work, with_fields(rows, "rep", "n bigint, counts array<int>, shingles array<bigint>"))


def open_blocks(a: list[tuple], b: list[tuple] | None, percent: int) -> list[tuple]:
    """Links (rep, rep) between members of block b (None: a itself) and queries from a.

    A member is (rep, component, sorted shingles). The block's token union comes
    first, as far as queries share it: a query whose overlap with it is too small
    for any member is done. Members' overlaps with the queries that are left are
    counted over ``SHARED`` tokens of the union at a time, which bounds the memory.
    """
    members = a if b is None else b
    tokens, times = np.unique(np.concatenate([m[2] for m in members]), return_counts=True)
    if b is None:
        shared = tokens[times > 1]
    else:
        shared = np.intersect1d(tokens, np.unique(np.concatenate([m[2] for m in a])), assume_unique=True)
    if not len(shared):
        return []

    def places(s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(shared, s)
        return at[shared[np.minimum(at, len(shared) - 1)] == s]

    least = min(len(m[2]) for m in members)
    found_at = [places(m[2]) for m in a]
    # A link with any member shares percent of the larger set at least.
    queries = [q for q, m in enumerate(a) if 100 * len(found_at[q]) >= percent * max(len(m[2]), least)]
    if not queries:
        return []
    rows = [found_at[q] for q in queries]
    columns = found_at if b is None else [places(m[2]) for m in members]
    both = np.zeros((len(rows), len(columns)))
    for low in range(0, len(shared), SHARED):
        both += _incidence(rows, low) @ _incidence(columns, low).T
    sizes, own = np.array([len(m[2]) for m in members]), np.array([len(a[q][2]) for q in queries])
    links = 100 * both >= percent * (own[:, None] + sizes[None, :] - both)
    found = []
    for k, i in zip(*np.nonzero(links), strict=True):
        q = queries[k]
        if (b is not None or i < q) and a[q][1] != members[i][1]:
            found.append((a[q][0], members[i][0]))
    return found


def _incidence(lists: list[np.ndarray], low: int) -> np.ndarray:
    """Which of the ``SHARED`` tokens from low on each sorted list holds."""
    out = np.zeros((len(lists), SHARED), np.float32)
    for i, x in enumerate(lists):
        lo, hi = np.searchsorted(x, (low, low + SHARED))
        out[i, x[lo:hi] - low] = 1
    return out


def join(docs: DataFrame, percent: int = 90, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # What a row is found by again: rows with equal ids and texts share it, and either will do.
    texts = texts.withColumn("at", F.xxhash64("doc_id", "text"))
    rows = stored(profile(texts, n), "ngram-rows")
    sets_seen = stored(rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("name"), F.min("at").alias("at")), "ngram-classes")
    # A class goes by k1; should sets share that, all but one of them go by a hash of both keys.
    alike = sets_seen.groupBy("k1").agg(F.min("k2").alias("k2"), F.count("*").alias("n")).where("n > 1").select("k1", F.col("k2").alias("least"))
    classes = stored(sets_seen.join(alike, "k1", "left").withColumn("rep", F.expr("if(least is null or least = k2, k1, xxhash64(k1, k2))")).drop("least"), "ngram-classes")
    # One exchange of all signatures; only lists with two members or more are kept, copies being one.
    count = rows.count()
    common = common_shingles(texts, n, count)
    release(spark)
    listed = stored(listing(texts, percent, n, common, buckets_for(count)), "ngram-listed")
    release(spark)
    # Lists of the same members are kept once; what a list holds is told by its size, ends and two hashes.
    h = F.xxhash64("k1")
    told = listed.groupBy("sig").agg(F.count("*").alias("size"), F.min("k1").alias("first"), F.max("k1").alias("hi"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    groups = stored(told.groupBy("size", "first", "hi", "x", "s").agg(F.min("sig").alias("sig")).select("sig", "first"), "ngram-lists")
    members = listed.join(groups, "sig").join(classes.select("k1", "k2", "rep", "at"), "k1").select("sig", "rep", "first", "k1", "k2", "at")
    members = stored(members, "ngram-groups")
    discard(listed, groups)
    wanted = stored(members.select("at", "rep", "k1", "k2").distinct(), "ngram-wanted")
    found = only(texts.select("at", "text"), wanted).join(wanted.hint("merge"), "at").groupBy("at", "rep", "k1", "k2").agg(F.first("text").alias("text"))
    sets = stored(sets_of(found.select("rep", "k1", "k2", "text"), n), "ngram-sets")
    discard(wanted)
    release(spark)

    located = members.select("sig", "rep", F.col("rep").alias("root"), "first")
    stars: list[DataFrame] = []
    for round_ in range(ROUNDS):
        # Everyone with the group's first member; later, those outside its largest component with one of the members inside.
        pairs = located.where("rep <> first").select("rep", "first") if not round_ else _outside(located, round_)
        stars.append(_linked(pairs.distinct(), sets, percent))
        if stars[-1].isEmpty():
            break
        roots = components_of(reduce(DataFrame.union, stars), "ngram-contracted")
        new = stored(members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", F.coalesce("root", "rep").alias("root")), "ngram-located")
        if round_:
            discard(located)
        located = new
        release(spark)
    if "first" in located.columns:
        located = stored(located.drop("first"), "ngram-located")
    discard(members)
    opened = _opened(located, sets, percent)
    final = components_of(reduce(DataFrame.union, stars).union(opened), "ngram-links").withColumnRenamed("node", "rep")
    discard(located, sets, *stars, opened)
    # Components are named by the least id of their documents. Both sides of each join are stored, so a hot key's partition can be split.
    placed = stored(classes.join(final, "rep", "left").select("k1", "k2", "name", "root"), "ngram-placed")
    names = stored(placed.where("root is not null").groupBy("root").agg(F.min("name").alias("component")), "ngram-names")
    named = stored(placed.join(names, "root", "left").select("k1", "k2", F.when(F.col("root").isNull(), F.col("name")).otherwise(F.col("component")).alias("component")), "ngram-named")
    discard(sets_seen, classes, placed, names)
    release(spark)
    return rows.join(named, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def components_of(links: DataFrame, label: str) -> DataFrame:
    """(node, root) of stored links (a, b), as ``components`` has them. At most ``FEW_LINKS`` are solved in one task: rounds of joins would be many jobs, whose plans the driver keeps."""
    links = links.select("a", "b").where("a <> b")
    if links.count() > FEW_LINKS:
        return components(links, label=label)

    @freed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
        nodes, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *both], axis=1), return_inverse=True)
        u, v = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while (root[u] != root[v]).any():
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])

    return stored(links.coalesce(1).mapInArrow(work, "node bigint, root bigint"), label)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (rep, first) that link: rows of the matrix bound what they share, then their shingles are compared."""
    pairs = stored(pairs, "ngram-pairs")
    size = _of(sets.select("rep", "n", "counts"), pairs)
    bound = F.expr("aggregate(zip_with(counts, others, (a, b) -> least(a, b)), 0, (s, x) -> s + x)").cast("long")
    near = (
        pairs.join(size, "rep").join(size.select(F.col("rep").alias("first"), F.col("n").alias("m"), F.col("counts").alias("others")), "first")
        .where(f"100 * least(n, m) >= {percent} * greatest(n, m)").where((100 + percent) * bound >= percent * (F.col("n") + F.col("m"))).select("rep", "first", "n", "m")
    )
    near = stored(near, "ngram-near")
    own = _of(sets.select("rep", "shingles"), near)
    both = F.size(F.array_intersect("shingles", "other")).cast("long")
    links = near.join(own, "rep").join(own.select(F.col("rep").alias("first"), F.col("shingles").alias("other")), "first")
    links = stored(links.where(100 * both >= percent * (F.col("n") + F.col("m") - both)).select(F.col("rep").alias("a"), F.col("first").alias("b")), "ngram-star")
    discard(pairs, near)
    return links


def _of(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that stand in a pair: the others don't travel."""
    ids = stored(pairs.select("rep").union(pairs.select("first")).distinct(), "ngram-ids")
    return sets.join(joinable(ids), "rep", "left_semi")


def _outside(located: DataFrame, round_: int) -> DataFrame:
    """(rep, first): in each group of several components, their members with one member of another, another one each round.

    That is one of the largest component, or in even rounds one of the component before in order of size.
    """
    parts = located.groupBy("sig", "root").agg(F.count("*").alias("count"), F.min(F.struct(F.xxhash64("rep", F.lit(round_)), "rep")).alias("m"))
    order = Window.partitionBy("sig").orderBy(F.col("count").desc(), "root")
    hub = F.lag("m.rep").over(order) if round_ % 2 == 0 else F.first("m.rep").over(order)
    hubs = parts.select("sig", "root", hub.alias("first"), F.row_number().over(order).alias("place")).where("place > 1").select("sig", "root", "first")
    return located.join(hubs, ["sig", "root"]).select("rep", "first")


def _mixed(members: DataFrame) -> DataFrame:
    """Per group (sig) of several components: the largest, whose members needn't be compared with each other, and the members in and outside it."""
    parts = members.groupBy("sig", "root").count()
    mixed = parts.groupBy("sig").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("size"), F.count("*").alias("roots")).where("roots > 1")
    return mixed.select("sig", F.col("top.root").alias("top"), F.col("top.count").alias("inside"), (F.col("size") - F.col("top.count")).alias("outside"))


def _dealt(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """(sig, rep, root, lo, hi, own): members (sig, rep, root) in blocks, a row for each pair of blocks that they are in.

    Blocks of the members outside the largest component meet all blocks, those of
    the members inside it meet only the blocks outside.
    """
    cut = members.join(mixed, "sig").selectExpr(
        "sig", "rep", "root",
        f"cast(ceil(outside / {BLOCK}) as bigint) as outer", f"cast(ceil(inside / {BLOCK}) as bigint) as inner", "root = top as is_in",
    ).selectExpr("*", "if(is_in, outer + pmod(xxhash64(rep), inner), pmod(xxhash64(rep), outer)) as own", "if(is_in, outer, outer + inner) as n")
    return cut.select(
        "sig", "rep", "root", "own", F.explode(F.expr("transform(sequence(0L, n - 1), o -> struct(least(own, o) as lo, greatest(own, o) as hi))")).alias("p")
    ).select("sig", "rep", "root", "p.lo", "p.hi", "own")


def _opened(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside groups: members (sig, rep, root), cut into blocks and pairs of blocks."""
    dealt = _dealt(members, _mixed(members))
    keys = ["sig", "lo", "hi"]

    def in_blocks(rows: DataFrame, payload: str) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys, "own", "rep").select(*keys, "own", "rep", "root", payload)

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, list]]:
        """(key, one side, other side) of each pair of blocks; the other side is None for a block with itself."""
        key, left, right = None, [], []
        for whole in batches:
            for at in range(0, len(whole), 200):
                *columns, payload = (whole.slice(at, 200).column(k) for k in range(7))
                for row, x in zip(zip(*(c.to_pylist() for c in columns), strict=True), payload, strict=True):
                    if row[:3] != key:
                        if key is not None:
                            yield key, left, None if key[1] == key[2] else right
                        key, left, right = row[:3], [], []
                    (left if row[3] == row[1] else right).append((row[4], row[5], x.values.to_numpy()))
        if key is not None:
            yield key, left, None if key[1] == key[2] else right

    @freed
    def qualify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            rows = [pa.array([x[k] for x in out], pa.int64()) for k in range(6)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, [*keys, "own", "rep", "root"])

        for key, left, right in blocks_of(batches):
            ok_left, ok_right = may_link(left, left if right is None else right, percent)
            out += [(*key, key[1], m[0], m[1]) for m, ok in zip(left, ok_left, strict=True) if ok]
            if right is not None:
                out += [(*key, key[2], m[0], m[1]) for m, ok in zip(right, ok_right, strict=True) if ok]
            if len(out) > 2000:
                yield told()
        yield told()

    @freed
    def open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, left, right in blocks_of(batches):
            found = [] if not left or right == [] else open_blocks([(r, c, x.view(np.uint64)) for r, c, x in left], right and [(r, c, x.view(np.uint64)) for r, c, x in right], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = in_blocks(dealt.join(sets.select("rep", "counts"), "rep"), "counts")
    able = stored(rows.mapInArrow(qualify, "sig bigint, lo bigint, hi bigint, own bigint, rep bigint, root bigint"), "ngram-able")
    # Groups overlap. Where those that hang together take fewer rows as one group cut into blocks, they become one.
    hubs = able.groupBy(*keys).agg(F.min("rep").alias("hub"))
    joined = stored(able.join(hubs, keys).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "ngram-hubs")
    named = components_of(joined, "ngram-hubs").select(F.col("node").alias("rep"), F.col("root").alias("hub"))
    together = stored(able.select("rep", "root").distinct().join(named, "rep").select(F.col("hub").alias("sig"), "rep", "root"), "ngram-together")
    mixed = _mixed(together).withColumn("rows", F.expr(f"inside * ceil(outside / {BLOCK}) + outside * (ceil(outside / {BLOCK}) + ceil(inside / {BLOCK}))"))
    now = able.join(named, "rep").groupBy(F.col("hub").alias("sig")).agg(F.count("*").alias("now"))
    fewer = stored(mixed.join(now, "sig").where("rows <= 2 * now").drop("rows", "now"), "ngram-fewer")
    whole = _dealt(together, fewer).select(*keys, "own", "rep", "root")
    one = together.join(fewer.select("sig"), "sig", "left_semi").select("rep")
    rest = able.join(one, "rep", "left_anti").select(*keys, "own", "rep", "root")
    found = stored(in_blocks(whole.union(rest).join(sets.select("rep", "shingles"), "rep"), "shingles").mapInArrow(open_all, "a bigint, b bigint"), "ngram-opened")
    discard(able, together, fewer)
    release(members.sparkSession)
    return found


def may_link(a: list[tuple], b: list[tuple], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members (rep, component, row of the matrix) of two blocks could link with one of another component in the other."""
    if not a or not b:
        return np.zeros(len(a), bool), np.zeros(len(b), bool)
    x, y = np.stack([m[2] for m in a]).astype(np.int64), np.stack([m[2] for m in b]).astype(np.int64)
    shared = np.concatenate([np.minimum(x[i : i + 16, None, :], y[None, :, :]).sum(axis=2) for i in range(0, len(x), 16)])
    need = percent * (x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :])
    other = np.array([m[1] for m in a])[:, None] != np.array([m[1] for m in b])[None, :]
    ok = ((100 + percent) * shared >= need) & other
    return ok.any(axis=1), ok.any(axis=0)
