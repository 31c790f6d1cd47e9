"""Embedding near-duplicates by spherical-cap filters.

Filter directions are random product codes. A code turns the space at random and
cuts it into two parts, each with its own random unit vectors; every pair of one
vector per part is a direction. A vector joins every filter whose cap holds it
(score >= threshold). List decoding finds them without trying all: one part's
scores are sorted, and for every vector of the other part a binary search tells
which pairs reach the threshold. Several codes are used, since the lists of one
vary much in length. Vectors meet in shared filters of their label, where
cosines are verified in double precision.

The threshold follows from the rows of the largest label and the scores' own
distribution, so a filter holds some tens of unrelated vectors at any size; the
number of directions then makes a vector join ``LISTS / CODES`` filters a code on
average. Codes are added until ``RECALL`` of drawn pairs at exactly the least
cosine share a filter, so more rows mean more codes, not less recall.

Equal vectors of one label are one class with a count. A filter's members are
cut into blocks of ``BLOCK``, and pairs of blocks are separate units of work, so
a large group of near copies spreads over tasks. A pair counts only in the
first filter that both are in, so numbers of links need no list of pairs; a
block gives a count per member and the roots of its links.

Defined results: null or zero vectors, vectors with null or non-finite
components, and vectors with a null label link with nothing (0 links, a
component of their own, kept). Vectors of different length never link. Below 16
dimensions all vectors of a label share one filter. Every row is a vector of its
own, also where ids or whole rows are repeated; ids only name, so null ids link
too, but name no component unless nothing else does (then null). At exactly the
least cosine vectors link. An empty table gives an empty one. Other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, small_batches, stored

LISTS = 32
CODES = 8
PER_FILTER = 32
BLOCK = 512
RECALL = 0.99
DRAWN = 4000
MOST_CODES = 256


def share_above(dim: int) -> Callable[[float], float]:
    """The share of directions of a product code that score at least t for a random unit vector, as a function of t."""
    first = dim // 2
    grid = np.linspace(-1, 1, 4001)
    # Scores of a part with a unit vector of its own follow (1 - x^2)^((d - 3) / 2); squared norms of the first part a beta distribution.
    a, b = (np.maximum(1 - grid**2, 0) ** ((d - 3) / 2) for d in (first, dim - first))
    above = (np.cumsum(b[::-1])[::-1] - b / 2) / b.sum()
    x, p = grid[::8], a[::8] / a[::8].sum()
    z = (np.arange(400) + 0.5) / 400
    log = (first / 2 - 1) * np.log(z) + ((dim - first) / 2 - 1) * np.log(1 - z)
    w = np.exp(log - log.max())
    z, w = z[w > 1e-9], w[w > 1e-9] / w[w > 1e-9].sum()
    r, s = np.sqrt(z)[:, None], np.sqrt(1 - z)[:, None]
    return lambda t: float(w @ (np.interp((math.sqrt(2) * t - r * x) / s, grid, above, left=1, right=0) @ p))


class Code:
    """Random product codes for one dimension: ``codes`` of them, or as many more as RECALL takes at cosine ``least``."""

    def __init__(self, dim: int, rows: int, lists: float = LISTS, codes: int = CODES, seed: int = 11, least: float = 0.93) -> None:
        self.words, self.kind = 1, np.int32
        if dim < 16:
            return
        share = share_above(dim)
        low, high = 1.5 / math.sqrt(dim), 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if share(mid) * rows > PER_FILTER else (low, mid)
        self.words = max(2, math.ceil(math.sqrt(lists / codes / share(low))))
        self.t, self.half = low, dim // 2
        rng = np.random.default_rng([seed, dim])
        a, b = drawn_pairs(dim, least, DRAWN, np.random.default_rng([seed, dim, 1]))
        self.codes = []
        while len(self.codes) < codes or len(a) > (1 - RECALL) * DRAWN:
            if len(self.codes) == MOST_CODES:  # too far apart for filters: all in one, which is exact
                self.words = 1
                return
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            words = [rng.standard_normal((d, self.words)) for d in (self.half, dim - self.half)]
            self.codes.append((turn, *[w / np.linalg.norm(w, axis=0) / math.sqrt(2) for w in words]))
            apart = ~self.meet(a, b, [len(self.codes) - 1])
            a, b = a[apart], b[apart]
        self.kind = np.int32 if len(self.codes) * self.words**2 < 1 << 31 else np.int64

    def listed(self, c: int, units: np.ndarray) -> list[np.ndarray]:
        """The filters of one code that each row (unit vectors) joins."""
        turn, first, second = self.codes[c]
        w, out = self.words, []
        x = units @ turn
        a, b = x[:, : self.half] @ first, x[:, self.half :] @ second
        order = np.argsort(b, axis=1)
        ranked = np.take_along_axis(b, order, axis=1)
        best = ranked[:, -1:]
        for i in range(len(x)):
            heads = np.flatnonzero(a[i] + best[i] >= self.t)
            at = np.searchsorted(ranked[i], self.t - a[i][heads])
            out.append(np.concatenate([*((c * w + h) * w + order[i][k:] for h, k in zip(heads, at, strict=True)), np.zeros(0, np.int64)]))
        return out

    def filters(self, units: np.ndarray) -> list[np.ndarray]:
        """The filters of each row (unit vectors), ascending."""
        if self.words == 1:
            return [np.zeros(1, self.kind)] * len(units)
        out = [self.listed(c, units) for c in range(len(self.codes))]
        return [np.sort(np.concatenate(o)).astype(self.kind) for o in zip(*out, strict=True)]

    def meet(self, a: np.ndarray, b: np.ndarray, codes: list[int]) -> np.ndarray:
        """Which pairs of rows share a filter of one of the codes."""
        found = np.full(len(a), self.words == 1)
        for c in codes if self.words > 1 else []:
            for lo in range(0, len(a), 250):
                pairs = zip(self.listed(c, a[lo : lo + 250]), self.listed(c, b[lo : lo + 250]), strict=True)
                found[lo : lo + 250] |= [len(np.intersect1d(x, y)) > 0 for x, y in pairs]
        return found


def drawn_pairs(dim: int, cosine: float, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors at a cosine."""
    a = units_of(rng.standard_normal((n, dim)))
    side = rng.standard_normal((n, dim))
    side = units_of(side - (side * a).sum(axis=1, keepdims=True) * a)
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * side


def units_of(values: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision, without overflow on the way."""
    x = values.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(a: np.ndarray, fa: list[np.ndarray], b: np.ndarray, fb: list[np.ndarray], here: int, least: float) -> np.ndarray:
    """Which pairs of rows link and have no filter below ``here`` in common."""
    hit = a @ b.T >= least
    if not hit.any():
        return hit
    lower_a, lower_b = [f[f < here] for f in fa], [f[f < here] for f in fb]
    seen = np.intersect1d(np.concatenate(lower_a), np.concatenate(lower_b))
    if len(seen):
        def incidence(lists: list[np.ndarray]) -> np.ndarray:
            m = np.zeros((len(lists), len(seen)), np.float32)
            rows, flat = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
            at = np.minimum(np.searchsorted(seen, flat), len(seen) - 1)
            ok = seen[at] == flat
            m[rows[ok], at[ok]] = 1
            return m

        hit &= incidence(lower_a) @ incidence(lower_b).T == 0
    return hit


def roots(hit: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each row reaches, for a symmetric matrix of links."""
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(hit, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == label).all():
            return label
        label = low


def near(rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", lists: float = LISTS) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    small_batches(spark)
    v = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    valid = F.expr("label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    v = v.withColumn("ok", F.coalesce(valid, F.lit(False))).withColumn("k", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)))
    classes = v.where("ok").groupBy("label", "k").agg(F.min("vec_id").alias("name"), F.count("*").alias("n"), F.first("v").alias("v"))
    # Numbers of their own, since ids may be null or repeated; they are fixed by being written.
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "caps-classes")
    sizes = {r["d"]: r["n"] for r in classes.groupBy("label", F.size("v").alias("d")).count().groupBy("d").agg(F.max("count").alias("n")).collect()}
    codes = {d: Code(d, n, lists, least=least) for d, n in sizes.items()}
    wide = any(c.kind is np.int64 for c in codes.values())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            length = np.diff(vectors.offsets.to_numpy())
            found: list = [None] * len(batch)
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                x = np.stack([vectors[int(i)].values.to_numpy(zero_copy_only=False) for i in at])
                for i, f in zip(at, codes[int(d)].filters(units_of(x)), strict=True):
                    found[i] = f
            ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int64() if wide else pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("label", "rep", "n")] + [lists], ["label", "rep", "n", "fs"])

    kind = dict(classes.dtypes)
    fs = stored(classes.mapInArrow(decode, f"label {kind['label']}, rep bigint, n bigint, fs array<{'bigint' if wide else 'int'}>"), "caps-lists")
    listed = fs.select("label", "rep", F.explode("fs").alias("f")).join(classes.select("label", "rep", F.size("v").alias("d")), ["label", "rep"])
    many = listed.groupBy("label", "d", "f").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("long")).drop("count")
    dealt = listed.join(many, ["label", "d", "f"]).withColumn("own", F.expr("pmod(xxhash64(rep), blocks)")).select(
        "label", "d", "f", "rep", "own", F.explode(F.expr("transform(sequence(0L, blocks - 1), o -> struct(least(own, o) as lo, greatest(own, o) as hi))")).alias("p")
    )
    full = dealt.select("label", "d", "f", "rep", "own", "p.lo", "p.hi").join(fs, ["label", "rep"]).join(classes.select("label", "rep", "v"), ["label", "rep"])
    keys = ["label", "d", "f", "lo", "hi"]
    full = full.select(*keys, "own", "rep", "n", "fs", "v").repartition(*keys).sortWithinPartitions(*keys, "own", "rep")

    def solve(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group = group.combine_chunks()
        here, lo, hi = (group.column(c)[0].as_py() for c in ("f", "lo", "hi"))
        ids, n, own = (group.column(c).to_numpy() for c in ("rep", "n", "own"))
        x = units_of(np.stack([y.values.to_numpy(zero_copy_only=False) for y in group.column("v")]))
        f = [y.values.to_numpy() for y in group.column("fs")]
        cut = len(ids) if lo == hi else int(np.searchsorted(own, hi))
        if cut in (0, len(ids)) and lo != hi:
            return (np.zeros(0, np.int64),) * 3
        whole = np.zeros((len(ids), len(ids)), bool)
        if lo == hi:
            whole = linked(x, f, x, f, here, least)
            np.fill_diagonal(whole, False)
        else:
            hit = linked(x[:cut], f[:cut], x[cut:], f[cut:], here, least)
            whole[:cut, cut:], whole[cut:, :cut] = hit, hit.T
        some = np.flatnonzero(whole.any(axis=1))
        if not len(some):
            return (np.zeros(0, np.int64),) * 3
        return ids[some], (whole @ n)[some], roots(whole, ids)[some]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, out = None, []

        def groups(t: pa.Table, last: bool) -> pa.Table | None:
            edge = np.zeros(max(len(t) - 1, 0), bool)
            for c in keys:
                x = t.column(c).to_numpy()
                edge |= x[1:] != x[:-1]
            at = [0, *(np.flatnonzero(edge) + 1).tolist(), *([len(t)] if last else [])]
            for a, b in zip(at, at[1:], strict=False):
                if b - a > 1:
                    out.append(solve(t.slice(a, b - a)))
            return None if last else t.slice(at[-1])

        def told() -> pa.RecordBatch:
            cols = [np.concatenate([*[o[k] for o in out], np.zeros(0, np.int64)]).astype(np.int64) for k in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["rep", "links", "root"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            carry = groups(t if carry is None else pa.concat_tables([carry, t]), False)
            yield told()
        if carry is not None:
            groups(carry, True)
        yield told()

    found = stored(full.mapInArrow(work, "rep bigint, links bigint, root bigint"), "caps-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), label="caps-components").withColumnRenamed("node", "rep")
    placed = stored(
        classes.select("label", "k", "rep", "n", "name").join(links, "rep", "left").join(comps, "rep", "left")
        .select("label", "k", "name", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")),
        "caps-placed",
    )
    names = stored(placed.where("root is not null").groupBy("root").agg(F.min("name").alias("least")), "caps-names")
    named = placed.join(names, "root", "left").select("label", "k", "n_links", F.when(F.col("root").isNull(), F.col("name")).otherwise(F.col("least")).alias("component"))
    named = stored(named, "caps-named")
    discard(classes, fs, found, placed, names)
    # Stored, so both sides of the join come from exchanges of their own and the rows of a hot vector can be split.
    return v.select("vec_id", "label", "k").join(named, ["label", "k"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
