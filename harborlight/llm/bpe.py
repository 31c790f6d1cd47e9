"""BPE encoding and decoding with forced boundaries.

A merge only ever makes tokens of the vocabulary. So where two neighbouring
symbols (bytes, in the byte-level alphabet) stand side by side inside no token
at all, no merge can cross that place: it is a certain cut. A word splits at
its certain cuts into fragments that are encoded independently and
concatenated, with the same ids as the whole word would get. Only the last
fragment of a word carries the word-end mark.

Around that core the text is normalised and split as the tokenizer file says:
white space separates every match of the split expression, so a text is taken
as its white-space chunks, and each distinct chunk is encoded once per worker
(a bounded cache). Special tokens' strings in a text become their ids, as in
the tokenizers library with its defaults; they are cut out before normalising.

Defined results: null and empty texts have no ids and decode to the empty
string; texts of any length are processed whole, fragment by fragment; repeated
rows are encoded each; ties between merges go by rank, then from the left; an
empty table gives an empty one. Other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_in, with_fields

#: White_Space of Unicode besides the plain space: in ASCII, and beyond.
SPACE = "\t\n\x0b\x0c\r"
FAR_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct chunks that a worker remembers, and distinct words.
CACHE = 300_000
#: Chunks that split without the tokenizer's help: one run of Latin letters, one of marks.
PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]*)([.,|!?;:#*$%&()-]*)")


def byte_alphabet() -> dict[int, str]:
    """Byte -> its character in the byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(0x100) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def normalised(text: str) -> str:
    """NFC, lower case by character (no final-sigma rule), white space as plain spaces."""
    spaces = SPACE
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        spaces += FAR_SPACE
    for c in spaces:
        if c in text:
            text = text.replace(c, " ")
    return text.lower()


class WordBPE:
    """Encoder and decoder of a word-level BPE file (end-of-word suffix, no decoder section)."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        merges = [tuple(m) for m in model["merges"]]
        self.last = self.tok.model
        self.inner = models.BPE(vocab=self.vocab, merges=merges)
        self.pairs = set()
        for t in self.vocab:
            word = t.removesuffix(self.end)
            self.pairs.update(zip(word, word[1:], strict=False))
        self.chunks: dict[str, tuple[bytes, int, str]] = {}
        self.words: dict[str, list[int]] = {}
        self.alphabet = byte_alphabet()

    def fragments(self, word: str) -> list[str]:
        """word (in the byte-level alphabet) cut at every pair that stands inside no token."""
        cuts = [i for i in range(1, len(word)) if (word[i - 1], word[i]) not in self.pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def word_ids(self, word: str) -> list[int]:
        *inner, last = self.fragments(word)
        out = [t.id for f in inner for t in self.inner.tokenize(f)]
        return out + [t.id for t in self.last.tokenize(last)]

    def _words(self, chunk: str) -> list[str]:
        """The matches of the split expression, in the byte-level alphabet."""
        if m := PLAIN.fullmatch(chunk):
            word = m[1] if m[1].isascii() else m[1].encode().decode("latin-1").translate(self.alphabet)
            return [x for x in (word, m[2]) if x]
        return [word for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(chunk)]

    def _chunk(self, chunk: str) -> tuple[bytes, int, str]:
        ids = []
        for word in self._words(chunk):
            if (known := self.words.get(word)) is None:
                known = self.word_ids(word)
                if len(word) < 200:
                    if len(self.words) >= CACHE:
                        self.words.clear()
                    self.words[word] = known
            ids += known
        found = (struct.pack(f"<{len(ids)}I", *ids), len(ids), self.decode(ids))
        if len(chunk) < 200:
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """As Tokenizer.decode(ids, skip_special_tokens=False) of a file without a decoder: tokens joined by spaces."""
        return " ".join(self.names[i] for i in ids)

    def encode(self, text: str) -> tuple[bytes, int, str]:
        """(ids as little-endian 32-bit, their number, the decoded text)."""
        raw, n, said = [], 0, []
        for part in self.special_at.split(text) if "<|" in text else (text,):
            if part in self.special:
                raw.append(struct.pack("<I", self.special[part]))
                n += 1
                said.append(part)
                continue
            # After normalising, the plain space is the only white space left.
            get, make = self.chunks.get, self._chunk
            found = [get(c) or make(c) for c in normalised(part).split(" ") if c]
            raw += [x[0] for x in found]
            n += sum([x[1] for x in found])
            said += [x[2] for x in found if x[1]]
        return b"".join(raw), n, " ".join(said)


@cache
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch, texts in texts_in(batches):
            rows = [bpe.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "ids", "n_tokens", "decoded"],
            )

    return narrow.mapInArrow(work, with_fields(narrow, "doc_id", "ids binary, n_tokens bigint, decoded string"))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
