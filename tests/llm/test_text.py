"""Text operators against plain versions, on small inputs with nulls, empty, long and repeated texts."""

from __future__ import annotations

import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest

from brute import base_secrets, best_fit, quality_counts
from harborlight.llm import bpe, packing, quality_rules, secret_scan

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "\n", "plain words here", "İSTANBUL ΑΣ ΟΔΟΣ <|endoftext|> a<|startoftext|>b", "  x y\x1fz\u0085 '' 's can't ll'll 12345 ½ é ﬁ 漢字 😀👍🏽  q",
    "a" * 3000 + "!?" * 500 + "zqxj" * 300, "<|endoftext|><|endoftext|>", "don'T 'RE \t\r\n\x0b\x0c x", "word " * 3000, "plain words here", "x  　 y\n\n z  ", "Straße größer Über ÀÉ", "a.b,c|d!e?f;g:h#i*j$k%l&m(n)o-p",
]


def frame(spark, texts=None):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS if texts is None else texts)] + ([(None, "no id", "clash", 7), (3, "same id", "clash", 7)] if texts is None else [])
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_tokens int").repartition(3)


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def by_text(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_bpe_equals_the_library(spark):
    t, path = tokenizer("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    df = frame(spark)
    want = []
    for r in df.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_text(bpe.digests(bpe.encode(df, path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.encode(frame(spark, []), path).count() == 0


def test_no_merge_crosses_a_forced_boundary():
    w = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("aeintshrqzxj019!?") for _ in range(rng.randint(1, 40)))
        assert "".join(w.fragments(word)) == word
        assert w.word_ids(word) == [x.id for x in w.last.tokenize(word)]


def test_packing_holds_every_id_once(spark):
    t, path = tokenizer("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.json")
    df = frame(spark).where("doc_id is not null and text is distinct from 'same id'")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = packing.pack(df, path).collect()
    ids = {k: [*t.encode(x or "", add_special_tokens=False).ids, 0] for k, x in texts.items()}
    for k, own in ids.items():
        parts = sorted((p for p in got if p.doc_id == k), key=lambda p: p.start)
        assert [p.start for p in parts] == list(np.cumsum([0, *[p.length for p in parts]])[:-1]) and sum(p.length for p in parts) == len(own)
        for p in parts:
            part = own[p.start : p.start + p.length]
            assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    by_sequence = {}
    for p in got:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(frame(spark, []), path).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        window = rng.choice([16, 50, 64])
        counts = {rng.randint(1, window): rng.randint(1, 12) for _ in range(rng.randint(0, 12))}
        fill, ranks = {}, {}
        for length, rank, n, first, offset in packing.plan(counts, window):
            for i in range(n):
                fill.setdefault(first + i, []).append((offset, length))
                ranks.setdefault(length, []).append(rank + i)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        assert sorted(window - sum(x for _, x in w) for w in fill.values()) == best_fit(counts, window)


def test_secrets_equal_a_plain_search(spark):
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "api_key", "APIKEY", "token", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH01234567", "deadbeef", "0123456789abcdef", "é", "ſecret", "\n", "x", "Tokentoken:abcdef", "zzzzzz"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(df)).collect()}
    for i, t in enumerate(texts):
        want = base_secrets(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))
        assert got[i].n_assign == want.count("assign:") and got[i].n_hex == want.count("hex:")


def test_checksummed_tokens_and_redaction(spark):
    body = "abcDEF0123456789abcDEF01234567"
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        tail = secret_scan.BASE62[r] + tail
    good, bad = f"ghp_{body}{tail}", f"ghp_{body}000000"
    text = f"use {good} not {bad} visa 4111 1111 1111 1111 or card 4111111111111112"
    kinds = [(k, text[a:b]) for a, b, k in secret_scan.find(text)]
    assert kinds == [("ghtoken", good), ("card", "4111 1111 1111 1111")]
    df = spark.createDataFrame([(1, text, "é"), (2, None, None)], "spans int, text string, kind string")
    rows = secret_scan.redacted(df).orderBy("spans").collect()
    assert good not in rows[0].text and bad in rows[0].text and rows[0].kind == "é" and rows[1].text is None


def test_rules_count_as_stated(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice("ab c, de f# g$ hij klm nop".split()) for _ in range(rng.randint(0, 120))).replace(" c,", "\n") for _ in range(120)]
    df = spark.createDataFrame([(i, t, rng.choice(["en", None]), rng.choice(["s", "t", None])) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    for i, t in enumerate(texts):
        want = quality_counts(t or "")
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i].kept and got[i].base_failed)
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


def test_rules_keep_the_usual_and_drop_the_odd(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    usual = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(600)]
    odd = [" ".join(word() + "#$%&" for _ in range(100)) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(usual + odd)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.apply_rules(df).where("kept").collect()}
    assert len(kept & set(range(600))) >= 595 and not kept & set(range(600, 605))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry_lists_all_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names
