"""Graphs as (vertices, edges) pairs of DataFrames, and what is computed on them by joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.operators import meetings
from harborlight.operators.meetings import whole_numbers
from harborlight.storage import discard, stored


@dataclass
class Graph:
    """vertices: id and properties; edges: src, dst and properties, taken in both directions."""

    vertices: DataFrame
    edges: DataFrame

    def both(self) -> DataFrame:
        e = self.edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
        return e.union(e.select("dst", "src")).distinct()

    def degree(self) -> DataFrame:
        return self.both().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def hops(self, start: DataFrame, most: int = 6) -> DataFrame:
        """(id, hops) of all vertices at most ``most`` steps (1 to 6) from the start vertices (column id)."""
        both = stored(self.both(), "graph-edges")
        seen = stored(start.select("id").distinct().withColumn("hops", F.lit(0)), "graph-hops")
        front = seen.select("id")
        for step in range(1, max(1, min(most, 6)) + 1):
            near = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct()
            new = stored(near.join(seen, "id", "left_anti").select("id", F.lit(step).alias("hops")), "graph-hops")
            if new.isEmpty():
                break
            seen, front = seen.union(new), new.select("id")
        return seen

    def two_hops(self, start: DataFrame) -> DataFrame:
        """(start, via, id): neighbours of neighbours, other than the start itself."""
        both = self.both()
        one = start.select(F.col("id").alias("start")).join(both, F.col("start") == F.col("src")).select("start", F.col("dst").alias("via"))
        two = both.select(F.col("src").alias("via"), F.col("dst").alias("id"))
        return one.join(two, "via").where("id <> start").select("start", "via", "id")

    def neighbourhood(self, start: DataFrame, most: int = 2) -> DataFrame:
        """(start, id, hops): who is within one or two undirected steps of each start, by the fewest steps."""
        both = self.both()
        one = start.select(F.col("id").alias("start")).join(both, F.col("start") == F.col("src")).select("start", F.col("dst").alias("id"), F.lit(1).alias("hops"))
        if most > 1:
            one = one.union(self.two_hops(start).select("start", "id", F.lit(2)))
        return one.groupBy("start", "id").agg(F.min("hops").alias("hops"))

    def incident(self, start: DataFrame, *properties: str) -> DataFrame:
        """(start, id, properties of the edge): the edges at each start, whichever end it is."""
        e = self.edges.where("src is not null and dst is not null and src <> dst")
        ends = e.select("src", "dst", *properties).union(e.select("dst", "src", *properties))
        return start.select(F.col("id").alias("start")).join(ends, F.col("start") == F.col("src")).select("start", F.col("dst").alias("id"), *properties)

    def components(self) -> DataFrame:
        """(id, component): for each vertex the smallest vertex that it reaches, itself included."""
        found = connected(self.edges, "src", "dst").withColumnRenamed("node", "id")
        return self.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))

    def triangles(self) -> DataFrame:
        """(id, triangles, clustering): every triangle is met once.

        Edges point to the end of higher degree (then larger id), so no vertex has
        more than sqrt(2 * edges) edges going out, a hub least of all. Their lists
        meet in blocks; no pair of edges travels.
        """
        both = stored(self.both(), "graph-edges")
        degree = stored(both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "graph-degrees")
        number = F.col("id").cast("long") if whole_numbers(degree, "id") else F.monotonically_increasing_id()
        numbered = stored(degree.withColumn("no", number), "graph-numbers")
        ends = both.join(numbered.toDF("src", "m", "a"), "src").join(numbered.toDF("dst", "n", "b"), "dst")
        up = ends.where("m < n or (m = n and a < b)").groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("members"))
        up = stored(up, "graph-up")
        per = stored(meetings.triangles(up), "graph-triangles").withColumnRenamed("id", "no")
        discard(both, degree, up)
        d = numbered.join(per, "no", "left").select("id", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))
        return d.withColumn("clustering", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def band_neighbourhood(rows: DataFrame, id_col: str, keys: list[str], value: str, reach: float, width: float | None = None) -> DataFrame:
    """(start, id, hops): who is one or two steps from whom, where rows of equal keys are linked whose values lie at most ``reach`` apart.

    Of two rows that with the smaller id says from where to where: y links with x
    (x < y) if y's value is between x's less and plus reach, in double precision.
    Neither edges nor their pairs travel: rows of a key are cut into stripes of
    values, each with a margin of two steps, and both steps are made inside. Ids
    have to be unique whole numbers (a graph of edges takes any).
    """
    width = width or 10 * reach
    known = rows.select(F.col(id_col).cast("long").alias("id"), F.col(value).cast("double").alias("x"), F.concat_ws("/", *[F.hex(F.col(k).cast("string")) for k in keys]).alias("key"), *keys)
    known = known.where(" and ".join(f"{c} is not null" for c in ["id", "x", *keys])).select("id", "x", "key")
    # A margin over two steps; what is not finite has a stripe of its own.
    at = lambda x: F.floor((F.col("x") + F.lit(x)) / F.lit(width))
    finite = F.abs("x") < float("inf")
    span = F.when(finite, F.sequence(at(-2.01 * reach), at(2.01 * reach))).otherwise(F.array(F.lit(None).cast("long")))
    dealt = known.select("key", F.explode(span).alias("stripe"), F.when(finite, at(0)).alias("own"), "id", "x")
    dealt = dealt.select("key", F.coalesce("stripe", F.lit(-(1 << 62))).alias("stripe"), F.expr("own <=> stripe").alias("own"), "id", "x")

    def linked(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = np.where(i[:, None] < j, x[:, None], y), np.where(i[:, None] < j, y, x[:, None])
        with np.errstate(invalid="ignore"):
            return ((b >= a - reach) & (b <= a + reach) | (np.isnan(a) & np.isnan(b))) & (i[:, None] != j)

    def stripe(ids: np.ndarray, x: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(x, kind="stable")
        ids, x, own = ids[order], x[order], own[order]
        starts = np.flatnonzero(own)
        for n in range(0, len(starts), 256):
            some = starts[n : n + 256]
            low, high = np.searchsorted(x, (x[some[0]] - 2.01 * reach, x[some[-1]] + 2.01 * reach))
            high = max(int(np.searchsorted(x, x[some[-1]] + 2.01 * reach, side="right")), int(high))
            i, y = ids[low:high], x[low:high]
            one, two = linked(ids[some], x[some], i, y), np.zeros((len(some), len(i)), np.float32)
            vias = np.flatnonzero(one.any(axis=0))
            for m in range(0, len(vias), 512):
                via = vias[m : m + 512]
                two += one[:, via].astype(np.float32) @ linked(i[via], y[via], i, y).astype(np.float32)
            both = (one | (two > 0)) & (ids[some][:, None] != i)
            s, e = np.nonzero(both)
            for m in range(0, len(s), 1 << 16):
                p, q = s[m : m + (1 << 16)], e[m : m + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some][p]), pa.array(i[q]), pa.array(np.where(one[p, q], 1, 2).astype(np.int32))], ["start", "id", "hops"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys_in = list(zip(batch.column("key").to_pylist(), batch.column("stripe").to_pylist(), strict=True))
            cut = [0, *[k for k in range(1, len(keys_in)) if keys_in[k] != keys_in[k - 1]], len(keys_in)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo < hi and keys_in[lo] != at:
                    if held:
                        yield from stripe(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    at, held = keys_in[lo], []
                held.append([batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("id", "x", "own")])
        if held:
            yield from stripe(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return dealt.repartition("key", "stripe").sortWithinPartitions("key", "stripe").mapInArrow(work, "start bigint, id bigint, hops int")


def connected(edges: DataFrame, src: str = "src", dst: str = "dst", label: str = "components") -> DataFrame:
    """(node, root): for each node of an edge the smallest node that it reaches.

    Alternates taking the smallest label among neighbours and jumping to the
    label's own label, so chains shorten geometrically. Each round is a hash
    aggregation with map-side combining plus a join; the state is written to
    the shared folder each round, and only whether something changed comes to
    the driver. All tables grow with the nodes, so none is broadcast, whatever the
    session's threshold: the driver would hold several of them. Nulls and
    self-loops in edges are ignored (a node that has only a self-loop isn't
    returned).
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    both = stored(e.union(e.select("v", "u")).distinct(), label + "-edges")
    state = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), label)
    while True:
        near = both.join(state.select(F.col("node").alias("v"), F.col("root").alias("r")).hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("r").alias("r"))
        # A root's own label may fall too: a hook carries a smaller label from a node to its old root.
        hooks = state.select("node", "root").join(near.hint("merge"), "node").where("r < root").groupBy(F.col("root").alias("node")).agg(F.min("r").alias("r"))
        falls = near.unionByName(hooks).groupBy("node").agg(F.min("r").alias("r"))
        moved = state.select("node", "root").join(falls.hint("merge"), "node", "left").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = stored(moved.join(jump.hint("merge"), "root", "left").select("node", "old", F.least("root", "far").alias("root")), label)
        done = new.where("root <> old").isEmpty()
        discard(state)
        state = new
        if done:
            discard(both)
            return state.select("node", "root")


def shared_pairs(links: DataFrame, owner: str, item: str, least: int = 1, most: int | None = None) -> DataFrame:
    """(a, b, shared): pairs of owners (a < b) by the number of items that both have.

    most: items of more owners than this make no pairs (the known cure for hub
    items in ownership graphs; the number of such items should be reported).
    """
    one = links.select(F.col(owner).alias("o"), F.col(item).alias("i")).where("o is not null and i is not null")
    numbers = None
    if not whole_numbers(one, "o"):
        numbers = stored(one.select("o").distinct().withColumn("no", F.monotonically_increasing_id()), "shared-numbers")
        one = one.join(numbers, "o").select(F.col("no").alias("o"), "i")
    lists = stored(one.groupBy("i").agg(F.collect_set(F.col("o").cast("long")).alias("members")).select("members").where("size(members) > 1"), "shared-lists")
    pairs = meetings.pairs(lists if most is None else lists.where(F.size("members") <= most)).where(F.col("shared") >= least)
    kind = links.schema[owner].dataType
    if numbers is None:
        return pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "shared")
    named = pairs.join(numbers.toDF("x", "a"), "a").join(numbers.toDF("y", "b"), "b")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")
