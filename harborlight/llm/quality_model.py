"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (windows of ``PASSAGE`` bytes; only the document
has a label). Every passage is encoded from the shares of its character
classes, of pairs of classes and of hashed byte trigrams, and from how few
distinct trigrams it has, through one learned layer. A gated attention unit weighs the passages, and the weighted mean is
scored. Weights come from document labels alone, by gradient descent through
the attention, so the passages that decide a label get the weight.

Training reads at most about ``sample`` labelled documents, drawn by a hash of
the id, and of each at most ``BAG`` passages, evenly spread: documented bounds.
Their ids are broadcast (bounded by the same number), so no text is shuffled.
The rarer label is drawn more often; the output's offset puts the shares right
again, so scores mean the same however many rows are labelled. Scoring is one
pass over all texts, every passage, with a model of fixed size.

Defined results: null and empty texts are one empty passage and get a score;
without labels of both kinds all scores are the share of label 1 (0.5 without
any label); repeated rows are scored separately, each as its text says; rows with
null id or label never train; a score of exactly 0.5 counts as 1; an empty table
gives an empty one. Very long texts are encoded ``BLOCK`` passages at a time.
Other columns, whatever their names, are not looked at (``keep`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, with_fields

PASSAGE = 512
SAMPLE = 5000
BAG = 64
BLOCK = 1024
HIDDEN = 24
TRIGRAMS = 128
CLASSES = 16


def _classes() -> np.ndarray:
    """Byte -> character class."""
    t = np.full(256, 15, np.uint8)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!", "?", "|", "#*$%&<>", "'\"`", "()[]{}", ":;", "-_/\\@=+~^")):
        for c in chars:
            t[ord(c)] = k
    return t


CLASS = _classes()
DISTINCT = 1024
WIDTH = CLASSES + CLASSES * CLASSES + TRIGRAMS + 2


def encode(raw: bytes) -> np.ndarray:
    """Passages x WIDTH: square roots of the shares of classes, class pairs and hashed trigrams; share of distinct trigrams."""
    b = np.frombuffer(raw, np.uint8)
    n = max(1, -(-len(b) // PASSAGE))
    if n > 1 and len(b) % PASSAGE and len(b) % PASSAGE < PASSAGE // 4:
        n -= 1  # a short tail belongs to the passage before
    if not len(b):
        return np.zeros((1, WIDTH), np.float32)
    ends = [*range(BLOCK, n, BLOCK), n]
    return np.concatenate([_encoded(b, first, last, last == n) for first, last in zip([0, *ends], ends, strict=False)])


def _encoded(b: np.ndarray, first: int, last: int, final: bool) -> np.ndarray:
    """Passages first..last - 1 of a text; pairs and trigrams count where they end. The final passage takes what is left."""
    n, start = last - first, first * PASSAGE
    lead = min(2, start)
    b = b[start - lead : len(b) if final else last * PASSAGE]
    at = np.clip((np.arange(len(b)) - lead) // PASSAGE, 0, n - 1)
    own = np.arange(len(b)) >= lead
    c = CLASS[b].astype(np.int64)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :CLASSES] = np.bincount((at * CLASSES + c)[own], minlength=n * CLASSES).reshape(n, -1)
    pair = CLASSES * CLASSES
    out[:, CLASSES : CLASSES + pair] = np.bincount((at[1:] * pair + c[:-1] * CLASSES + c[1:])[own[1:]], minlength=n * pair).reshape(n, -1)
    w = b.astype(np.uint32)
    tri = (((w[:-2] << np.uint32(16) | w[1:-1] << np.uint32(8) | w[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(22)).astype(np.int64)
    out[:, CLASSES + pair : -2] = np.bincount(at[2:] * TRIGRAMS + tri % TRIGRAMS, minlength=n * TRIGRAMS).reshape(n, -1)
    size = np.maximum(out[:, :CLASSES].sum(axis=1), 1)
    out[:] = np.sqrt(out / size[:, None])
    seen = np.bincount(at[2:] * DISTINCT + tri, minlength=n * DISTINCT).reshape(n, -1)
    out[:, -2] = np.minimum((seen > 0).sum(axis=1) / np.minimum(size, PASSAGE), 1)
    out[:, -1] = 1 - out[:, -2]
    return out


def spread(x: np.ndarray, most: int = BAG) -> np.ndarray:
    """At most ``most`` rows, evenly spread."""
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(np.int64)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
    """All passages x of several documents at once; bag: the document of each passage, ascending."""
    h = np.maximum(x @ m["E"] + m["e"], 0)
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    a = (t * g) @ m["w"]
    top = np.full(bags, -np.inf, np.float32)
    np.maximum.at(top, bag, a)
    p = np.exp(a - top[bag])
    p /= np.bincount(bag, p, bags)[bag]
    z = np.zeros((bags, h.shape[1]), np.float32)
    np.add.at(z, bag, p[:, None].astype(np.float32) * h)
    return {"h": h, "t": t, "g": g, "p": p.astype(np.float32), "z": z, "y": _sigmoid(z @ m["c"] + m["b"][0])}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    start = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = {"E": start(WIDTH, HIDDEN) * 3, "e": np.zeros(HIDDEN, np.float32), "V": start(HIDDEN, HIDDEN), "U": start(HIDDEN, HIDDEN), "w": start(HIDDEN), "c": start(HIDDEN), "b": np.array([np.log((y.mean() + 0.01) / (1.01 - y.mean()))], np.float32)}
    mean, var, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.concatenate([bags[i] for i in pick])
            bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            f = forward(m, x, bag, len(pick))
            dy = ((f["y"] - y[pick]) / len(pick)).astype(np.float32)
            dz = dy[:, None] * m["c"]
            dp = (dz[bag] * f["h"]).sum(axis=1)
            da = f["p"] * (dp - np.bincount(bag, f["p"] * dp, len(pick))[bag].astype(np.float32))
            dtg = da[:, None] * m["w"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["p"][:, None] * dz[bag] + dt @ m["V"].T + dg @ m["U"].T) * (f["h"] > 0)
            grad = {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da, "c": f["z"].T @ dy, "b": np.array([dy.sum()])}
            step += 1
            for k, g in grad.items():
                g = g.astype(np.float32) + 1e-4 * m[k] * (k not in "eb")
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                m[k] = m[k] - rate * (1 - epoch / epochs) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in m.items()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A model from the rows of labels, all of which may be learned from."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return {"share": np.array([float(next(iter(counts)))]) if counts else np.array([0.5])}
    # The rarer label fills up to half of the sample; the offset below puts the shares right again.
    rare = min(sample // 2, min(counts.values()))
    share = {k: min(1.0, (rare if counts[k] == min(counts.values()) else sample - rare) / counts[k]) for k in counts}
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * F.when(F.col("label") == 0, share[0]).otherwise(share[1]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("id", "label", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, label, texts = (batch.column(k).to_pylist() for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(str, ids), pa.string()), pa.array(label, pa.int32()), pa.array([np.rint(255 * np.minimum(spread(encode((t or "").encode())), 1)).astype(np.uint8).tobytes() for t in texts], pa.binary())],
                ["id", "label", "v"],
            )

    got = sorted(map(tuple, rows.mapInArrow(work, "id string, label int, v binary").collect()))
    if len({r[1] for r in got}) < 2:
        return {"share": np.array([counts.get(1, 0) / sum(counts.values())])}
    y = np.array([r[1] for r in got], np.float32)
    model = train([np.frombuffer(r[2], np.uint8).reshape(-1, WIDTH).astype(np.float32) / 255 for r in got], y)
    model["b"] = model["b"] + np.float32(offset(counts[1], counts[0], int(y.sum()), int(len(y) - y.sum())))
    return model


def offset(ones: int, zeros: int, drawn_ones: int, drawn_zeros: int) -> float:
    """What the log odds of a model that was trained on drawn rows lack, from the labels' true and drawn numbers."""
    return float(np.log(ones / zeros) - np.log(drawn_ones / drawn_zeros))


def _scores(model: dict[str, np.ndarray], texts: list[str | None]) -> list[float]:
    """A score per text; passages go through the model some thousands at a time."""
    if "share" in model:
        return [float(model["share"][0])] * len(texts)
    out, held, size = [], [], 0
    for i, t in enumerate(texts):
        held.append(encode((t or "").encode()))
        size += len(held[-1])
        if size > 4000 or i == len(texts) - 1:
            bag = np.repeat(np.arange(len(held)), [len(x) for x in held])
            out += forward(model, np.concatenate(held), bag, len(held))["y"].tolist()
            held, size = [], 0
    return out


def keep(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score least or more, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            yield batch.filter(pa.array(np.array(_scores(model, batch.column(at).to_pylist())) >= least, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = _scores(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return narrow.mapInArrow(work, with_fields(narrow, "doc_id", "score double"))
