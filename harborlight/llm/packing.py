"""Packing documents into fixed windows: best-fit decreasing over a length histogram.

Every document's ids (and a separator id) are cut into full windows plus one
remainder; only remainders compete for room. Two remainders of one length are
interchangeable, so best-fit decreasing needs nothing but the number of
remainders per length: at most ``window`` integers reach the driver, whatever
the corpus holds. There a segment tree over remaining capacities finds the
tightest capacity among open windows that still takes a length; windows of one
capacity are kept as runs of consecutive ids, and one step places as many equal
remainders as that run takes. The result is a list of *runs* (length, ranks
from..to -> windows from.., offset), the placement best-fit decreasing gives
when equal lengths go in rank order.

Ranks are counted in parallel: pieces are dealt by (length, bucket of doc_id),
numbered there, and shifted by the counts of earlier buckets. A length shared
by a third of all pieces spreads over all buckets.

Defined results: null and empty texts still have the separator, one piece of
length 1; repeated rows are separate documents; pieces of one length go by id and
start, whole rows that are repeated in any order; very long texts become as many
full windows as they fill; an empty table packs to nothing. Other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import partitions, small_batches, stored, texts_in, with_fields

WINDOW = 1024
CACHE = 200_000
#: White_Space of Unicode, as the tokenizer's split expression defines it.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Chunks that split without the tokenizer's help: one run of Latin letters, one of marks.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([.,|!?;:#*$%&()-]*)")


class Remembered:
    """A bounded memory of results: what was used in the last two generations of ``size`` entries stays."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def get(self, key: str, make: Callable[[str], bytes]) -> bytes:
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = make(key)
            if len(key) < 200:
                if len(self.new) >= self.size:
                    # The dict stays the same object, so that bound lookups stay good.
                    self.old = dict(self.new)
                    self.new.clear()
                self.new[key] = found
        return found


class ByteBPE:
    """Ids of a byte-level BPE file, one white-space chunk at a time, with bounded caches.

    A chunk holds whole matches of the file's split expression: those take at
    most the one plain space before a word, and a run of white space ends
    before the last character that precedes a word. Where single spaces and
    single line ends are the only white space, splitting at them gives the chunks.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Of the same vocabulary: ids follow the order of the merges, so merging by least id is merging by rank.
        back = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(back[c] for c in t): i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
        self.piece = tiktoken.Encoding("byte_bpe", pat_str="", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cut = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.odd = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        #: Chunks as they stand, chunks after a plain space, and marks.
        self.bare, self.spaced, self.words = Remembered(CACHE), Remembered(CACHE), Remembered(CACHE)

    def _word(self, word: str) -> bytes:
        ids = self.piece(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, chunk: str, space: str) -> bytes:
        if not (m := PLAIN.fullmatch(chunk)):
            ids = self.tok.encode(space + chunk, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        word, marks = m.groups()
        if word and marks:
            return self._word(space + word) + self.words.get(marks, self._word)
        return self._word(space + chunk)

    def _bare(self, chunk: str) -> bytes:
        return self.bare.get(chunk, lambda c: self._ids(c, ""))

    def _spaced(self, chunk: str) -> bytes:
        return self.spaced.get(chunk, lambda c: self._ids(c, " "))

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        bare, spaced = self.bare.new.get, self.spaced.new.get
        if text[:1] in ("", " ") or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.odd(text):
            return b"".join([spaced(c[1:]) or self._spaced(c[1:]) if c[0] == " " and len(c) > 1 and not c.isspace() else bare(c) or self._bare(c) for c in self.cut(text)])
        out, line_end = [], self._bare("\n")
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if first:
                out.append(bare(first) or self._bare(first))
            out += [spaced(c) or self._spaced(c) for c in rest]
            out.append(line_end)
        return b"".join(out[:-1])


@cache
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


class Capacities:
    """Segment tree over the remaining capacities 0..window: is any window open with it."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)

    def mark(self, capacity: int, on: bool) -> None:
        i = capacity + self.size
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity that is least or more."""
        i = least + self.size
        while not self.any[i]:
            while i & 1:  # right children have no right neighbour under the same parent
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # went past the end of a level
                return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first window, offset) of best-fit decreasing."""
    tree, open_runs, runs, made = Capacities(window), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_runs.setdefault(capacity, []).append((first, n))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = window, made, -(-left // (window // length))
                made += n
            else:
                first, n = open_runs[capacity].pop()
                if not open_runs[capacity]:
                    tree.mark(capacity, False)
            # The tightest window stays the tightest until it is too full, so it takes all it can.
            each = capacity // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for windows, at, items in ((full, first, each), (int(rest > 0), first + full, min(rest, each))):
                for k in range(items if windows else 0):
                    runs.append((length, rank, windows, at, window - capacity + k * length))
                    rank += windows
                put(capacity - items * length, at, windows)
                left -= windows * items
            put(capacity, first + full + (rest > 0), n - full - (rest > 0))
    return runs


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, separator: int = 0) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens; every full window first, then the remainder."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(path), struct.pack("<I", separator)
        for batch, texts in texts_in(batches):
            rows, source = [], []
            for i, t in enumerate(texts):
                raw = bpe.encode(t) + end
                n = len(raw) // 4
                for a in range(0, n, window):
                    part = raw[4 * a : 4 * (a + window)]
                    rows.append((a, len(part) // 4, zlib.crc32(part), n))
                    source.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(source, pa.int64())), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]], ["doc_id", *names]
            )

    return narrow.mapInArrow(work, with_fields(narrow, "doc_id", ", ".join(f"{n} bigint" for n in names)))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, separator: int = 0) -> DataFrame:
    """pieces() with the sequence_id and offset of each piece."""
    spark = docs.sparkSession
    p = stored(pieces(docs, path, id_col, text_col, window, separator).withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, start), {max(64, min(4096, partitions(spark)))}) as int)")), "pieces")
    counts = p.groupBy("length", "bucket").count()
    base = stored(counts.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")), "piece-counts")
    per_length = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = plan(per_length, window)
    # Each step empties a run of windows or a length, so runs are bounded by window lengths, not by rows.
    run_rows = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, rank0 long, n long, window0 long, offset long")
    here = Window.partitionBy("length", "bucket").orderBy("doc_id", "start")
    ranked = p.withColumn("own", F.row_number().over(here) - 1)
    placed = ranked.join(base.select("length", "bucket", "base"), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own"))
    in_run = (placed["length"] == run_rows["length"]) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("n"))
    return placed.join(F.broadcast(run_rows), in_run).select(
        "doc_id", "start", placed["length"], "ids_crc32", "doc_tokens", (F.col("window0") + F.col("rank") - F.col("rank0")).alias("sequence_id"), F.col("offset")
    )
