"""Language identification by error-correcting output codes.

Every language gets a codeword of ``BITS`` bits, far from every other in Hamming
distance. One binary classifier per bit, over hashed byte bigrams and trigrams
of the whole text, predicts whether the bit is set. Decoding sums the logistic
loss of all classifiers against each codeword and takes the language with the
least; a few wrong bits don't change it. Where the two best losses are close
the row is flagged as ambiguous.

Training uses a sample of at most about ``sample`` documents, drawn evenly over
the languages by a hash of the id (a documented bound; everything else covers
all rows). Only text and language of the training rows are read. Prediction is
one pass with a model of fixed size.

Defined results: ``und`` with score 0 where the text is null or has no letter, or
no language could be learned; one learned language is always predicted; repeated
rows are predicted separately; rows with a null id are never trained on, and
count as not held out; of languages with equal loss the first by name is taken;
texts of any length are read whole, some MB of a batch at a time; an empty table
gives an empty one. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, with_fields

BITS = 31
SIZE = 4096
SAMPLE = 6000
AMBIGUOUS = 0.1
SNIPPET = 80


def _fold() -> np.ndarray:
    """ASCII letters in lower case, bytes of other characters as they are, all else one blank."""
    t = np.full(256, 32, np.uint8)
    t[0x80:] = np.arange(0x80, 0x100)
    for c in range(26):
        t[65 + c] = t[97 + c] = 97 + c
    return t


FOLD = _fold()


def grams(raw: bytes) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams; runs of blanks count once."""
    b = FOLD[np.frombuffer(raw, np.uint8)]
    b = np.concatenate(([32], b, [32])).astype(np.uint32)
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    if len(b) < 3:
        return np.zeros(SIZE, np.int64)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    hashed = np.concatenate((two * np.uint32(0x85EBCA6B), three * np.uint32(0x9E3779B1))) >> np.uint32(20)
    return np.bincount(hashed, minlength=SIZE)


def vector(raw: bytes) -> np.ndarray:
    v = np.sqrt(grams(raw)).astype(np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-6)


def codewords(classes: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """One row of -1/+1 per class; of many random candidates each time the one farthest from the rows so far."""
    rng = np.random.default_rng(seed)
    rows = [np.where(np.arange(bits) % 2, 1, -1)]
    while len(rows) < classes:
        many = rng.choice([-1, 1], size=(256, bits))
        near = np.max(np.stack([many @ r for r in rows]), axis=0)
        rows.append(many[np.argmin(near)])
    code = np.stack(rows)[:classes].astype(np.float32)
    for b in range(bits):  # a bit that is the same for every class teaches nothing
        if classes > 1 and abs(code[:, b].sum()) == classes:
            code[b % classes, b] *= -1
    return code


def train(vectors: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 120, rate: float = 0.05) -> np.ndarray:
    """Weights (bits, SIZE + 1) of one logistic classifier per bit, all trained together (Adam, classes weighted evenly)."""
    x = np.concatenate((vectors, np.ones((len(vectors), 1), np.float32)), axis=1)
    want = code[y]
    share = np.bincount(y, minlength=len(code)).astype(np.float32)
    weight = (1 / share[y] / len(code))[:, None].astype(np.float32)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (-want / (1 + np.exp(np.clip(want * (x @ w), -30, 30))) * weight) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, score, ambiguous) per row of margins, by the summed logistic loss against each codeword."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None]).sum(axis=2)
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    two = np.sort(loss, axis=1)[:, :2]
    close = (two[:, 1] - two[:, 0] < AMBIGUOUS * code.shape[1]) if loss.shape[1] > 1 else np.zeros(len(best), bool)
    return best, p[np.arange(len(best)), best], close


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, codewords, weights) from the rows of docs, all of which may be learned from."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, BITS), np.float32), np.zeros((SIZE + 1, BITS), np.float32)
    code = codewords(len(langs))
    quota = max(1, sample // len(langs))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, quota / counts[k])))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for i, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode()
                at = max(0, len(raw) // 2 - SNIPPET // 2)
                for part in (raw, raw[at : at + SNIPPET]):  # a short piece too, so that short texts are known
                    out.append((str(i), lang, np.minimum(255, np.rint(8 * np.sqrt(grams(part)))).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["id", "lang", "v"])

    got = sorted(map(tuple, drawn.mapInArrow(work, "id string, lang string, v binary").collect()))
    x = np.stack([np.frombuffer(r[2], np.uint8) for r in got]).astype(np.float32) if got else np.zeros((0, SIZE), np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    y = np.array([langs.index(r[1]) for r in got], np.int64)
    return langs, code, train(x, y, code) if len(got) else np.zeros((SIZE + 1, BITS), np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, ambiguous."""
    small_batches(docs.sparkSession)
    langs, code, w = model
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sliced(batches):
            for at in range(0, len(whole), 250):
                batch = whole.slice(at, 250)
                texts = [x or "" for x in batch.column("text").to_pylist()]
                letter = np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(langs)
                lang, score, close = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if letter.any():
                    x = np.stack([vector(t.encode()) for t in texts])
                    best, p, near = decode(x @ w[:-1] + w[-1], code)
                    lang = [langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
                    score, close = np.where(letter, p, 0.0), near & letter
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return narrow.mapInArrow(work, with_fields(narrow, "doc_id", "lang_pred string, score double, ambiguous boolean"))
