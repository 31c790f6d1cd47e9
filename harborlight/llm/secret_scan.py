"""Secret scan: keyword automaton, anchored expressions near its hits, checksum validation.

One Aho-Corasick pass over the text (A-Z lower-cased, so offsets stay) finds
the keywords that every kind of secret but one must begin with. Expressions run
anchored at those hits only; scanning hits in order and skipping those inside
the last match gives the leftmost non-overlapping matches of a plain search.
Hexadecimal runs have no keyword: a search for the run itself is their prefilter.

Base kinds ``assign``, ``access`` and ``hex`` follow their stated patterns
exactly. The method adds kinds whose tokens carry a checksum, kept only where
it holds: ``ghtoken`` and ``npmtoken`` (last six characters: CRC-32 of the
thirty before, in base 62) and ``card`` (13 to 19 digits after a card keyword,
by the Luhn rule). Adding never removes a base span.

Defined results: null and empty texts have no spans; repeated rows each get
their own; matches never cross rows; spans of one start come in the order of the
kinds; an empty table gives an empty one. Memory: some MB of texts at a time, or
one longer text. Other columns, whatever their names, are not looked at
(``redacted`` returns them).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, texts_in, with_fields

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
CARD = re.compile(r"(?:card|visa|mastercard|amex)[^0-9\n]{0,12}((?:[0-9][ -]?){12,18}[0-9])(?![0-9])", re.I | re.A)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "ghtoken": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npmtoken": ("npm_",),
    "card": ("card", "visa", "amex"),
}
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE, "ghtoken", "npmtoken", "card"))}


def crc62(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the body after the prefix."""
    body, tail = token[4:-6], token[-6:]
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out == tail


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _span(kind: str, text: str, at: int) -> tuple[int, int, bool] | None:
    """(start, end, valid) of the match anchored at a keyword hit; valid ones are secrets."""
    if kind == "assign":
        m = ASSIGN.match(text, at)
        return m and (m.start(), m.end(), len(m[2]) >= 6)
    if kind == "access":
        m = ACCESS.match(text, at)
        return m and (m.start(), m.end(), m.end() - m.start() >= 20)
    if kind == "card":
        m = CARD.match(text, at)
        return m and (m.start(1), m.end(1), luhn(re.sub("[^0-9]", "", m[1])))
    m = (FORGE if kind == "ghtoken" else NPM).match(text, at)
    return m and (m.start(), m.end(), crc62(m[0]))


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """A-Z in lower case, every other character and so every offset as it was."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and then kind. Offsets in code points, end exclusive."""
    found, last = [], {}
    for end, (kind, n) in _automaton().iter(lowered(text)):
        at = end + 1 - n
        if at >= last.get(kind, 0) and (m := _span(kind, text, at)):
            last[kind] = m[1]
            if m[2]:
                found.append((m[0], m[1], kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]], x[1]))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each maximal run of covered characters replaced by mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, spans array<struct<start, end, kind>>."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_in(batches):
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in find(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return narrow.mapInArrow(work, with_fields(narrow, "doc_id", "spans array<struct<start:bigint,end:bigint,kind:string>>"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in its texts replaced; every other column, and null texts, as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            clean = [x and redact(x, find(x), mark) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(work, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the two digests of the contract, from scan()'s rows."""
    base = F.expr(f"filter(spans, s -> s.kind in {BASE})")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
