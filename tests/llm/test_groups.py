"""Joins, repeats, archives, models and the pipeline against plain versions, on small inputs."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from brute import attention_score, repeated_bytes, shingle_components
from brute import links as brute_links
from harborlight.llm import cap_filters, language_id, ngram_join, quality_model, suffix_dedup, warc

BASE = "/root/testdata/sf0.001"


def some_text(rng, n, letters="abcdefgh é"):
    return "".join(rng.choice(letters) for _ in range(n))


def repeating_texts(rng):
    passages = [some_text(rng, rng.choice([300, 399, 405, 600, 1500])) for _ in range(12)]
    texts = []
    for _ in range(200):
        t = ""
        for _ in range(rng.randint(0, 5)):
            k = rng.random()
            if k < 0.5:
                p = rng.choice(passages)
                q = p[rng.choice([0, 0, rng.randint(0, 200)]) : len(p) - rng.choice([0, 0, rng.randint(0, 150)])]
                if rng.random() < 0.4:
                    j = rng.randrange(len(q))
                    q = q[:j] + "Z" + q[j + 1 :]
                t += q
            elif k < 0.9:
                t += some_text(rng, rng.randint(0, 700))
            else:
                t += rng.choice(["x", "ab ", "Ein. "]) * rng.randint(1, 400)
        texts.append(t)
    return texts + [texts[3], texts[3], "", None, passages[4], "é" * 199, "é" * 200, "é" * 200]


class TestSuffixes:
    @pytest.mark.parametrize("wide", [256, 2])
    def test_equals_a_plain_search(self, spark, monkeypatch, wide):
        """wide = 2 sends nearly every anchor through blocks and single windows."""
        monkeypatch.setattr(suffix_dedup, "WIDE", wide)
        texts = repeating_texts(random.Random(5))
        df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, spans binary").repartition(3)
        got = {r.doc_id: r for r in suffix_dedup.digests(df).collect()}
        raws = [(t or "").encode() for t in texts]
        for i, (raw, runs) in enumerate(zip(raws, repeated_bytes(raws, 400), strict=True)):
            kept = hashlib.sha256(suffix_dedup.without(raw, runs)).hexdigest()
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), sum(b - a for a, b in runs), len(runs), kept)

    def test_repeated_rows_and_columns(self, spark):
        text = some_text(random.Random(1), 500, "abcdef")
        df = spark.createDataFrame([(1, text, 5), (1, text, 6), (None, "short", 7), (2, None, 8)], "doc_id long, text string, u1 int")
        assert sorted(suffix_dedup.removed(df).select("u1", "text").collect(), key=str) == sorted([(5, ""), (6, ""), (7, "short"), (8, None)], key=str)
        assert suffix_dedup.digests(df.limit(0)).count() == 0

    @pytest.mark.parametrize("length", [40, 200])
    def test_other_lengths(self, spark, length):
        texts = repeating_texts(random.Random(length))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.digests(df, length=length).collect()}
        runs = repeated_bytes([(t or "").encode() for t in texts], length)
        assert got == {i: (sum(b - a for a, b in r), len(r)) for i, r in enumerate(runs)}

    def test_repeated_rows_are_cut_once(self, spark, monkeypatch):
        """20 copies of one row give each context once, and each place meets one verdict."""
        rng = random.Random(6)
        passage = some_text(rng, 900, "abcdef ")
        rows = [(1, passage + some_text(rng, 700, "abcdef "))] * 20 + [(2, some_text(rng, 500, "abcdef ") + passage)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        cut, seen = suffix_dedup._cut_contexts, []
        monkeypatch.setattr(suffix_dedup, "_cut_contexts", lambda *a: seen.append(suffix_dedup.stored(cut(*a), "test")) or seen[0])
        monkeypatch.setattr(suffix_dedup, "_spans", lambda places, found, length, f=suffix_dedup._spans: seen.append(suffix_dedup.stored(found, "test")) or f(places, found, length))
        monkeypatch.setattr(suffix_dedup, "discard", lambda *a: None)
        got = {r.doc_id: r.n_removed for r in suffix_dedup.digests(df).collect()}
        assert got == {1: 1600, 2: 900}
        for table in seen:
            assert table.count() == table.select("h", "g").distinct().count() > 0

    def test_periods_are_one_row(self, spark):
        df = spark.createDataFrame([(1, "ab " * 4000), (2, "x" * 9000), (3, "th. " * 99), (4, "th. " * 101)], "doc_id long, text string")
        rows = suffix_dedup._anchor_rows(suffix_dedup.keyed(df).select("u1", "u2", "text"), 400)
        assert rows.count() < 40
        got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.digests(df).collect()}
        assert got == {1: (12000, 12000), 2: (9000, 9000), 3: (396, 0), 4: (404, 404)}

    def test_runs_of_few_words_stay(self, spark):
        rng = random.Random(3)
        few, many = " ".join(some_text(rng, 12, "abcdefgh") for _ in range(40)), " ".join(some_text(rng, 4, "abcdefgh") for _ in range(51))
        texts = [f"{some_text(rng, 90, 'xyz ')} {p} {some_text(rng, 90, 'uvw ')}" for p in (few, few, many, many)]
        df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, __spans int")
        got = {r.doc_id: r.text for r in suffix_dedup.removed(df, length=200, least_words=50).collect()}
        assert got[0] == texts[0] and got[1] == texts[1]
        assert all(many not in got[i] and len(got[i]) < 190 for i in (2, 3))
        assert suffix_dedup.words_in(b"ab cd ef", 1, 8) == 2 and suffix_dedup.words_in(b"ab cd ef", 0, 7) == 2

    @pytest.mark.parametrize("wide", [256, 2])
    def test_query_has_the_text_without_passages(self, spark, monkeypatch, tmp_path, wide):
        """Passages of 51 words and under 400 bytes go from the text; the columns of 400 bytes are as without it."""
        from harborlight.llm import queries

        monkeypatch.setattr(suffix_dedup, "WIDE", wide)
        rng = random.Random(8)
        passages = [" ".join(some_text(rng, n, "abcdefgh") for _ in range(51)) for n in (3, 4, 5, 6, 8, 11)]
        own = lambda: " ".join(some_text(rng, rng.randint(1, 9), "stuvwxé") for _ in range(rng.randint(0, 80)))
        texts = [f"{own()} {p} {own()}" for p in passages * 4] + [own() for _ in range(20)] + repeating_texts(rng)
        ids = [None if i == 5 else i // 2 for i in range(len(texts))]
        rows = list(zip(ids, texts, strict=True))
        rows += rows[:3]
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        got = queries.op1_suffix_dedup(spark, str(tmp_path))
        assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        raws, want = [(t or "").encode() for _, t in rows], []
        for (i, t), raw, runs, short in zip(rows, raws, repeated_bytes(raws, 400), repeated_bytes(raws, 200), strict=True):
            cut = [(a, b) for a, b in short if suffix_dedup.words_in(raw, a, b) >= 50]
            text = t if t is None else suffix_dedup.without(raw, cut).decode("utf-8", "ignore")
            want.append((i, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(suffix_dedup.without(raw, runs)).hexdigest(), text))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        assert not any(p in t for p in passages for *_, t in want if t)
        assert any(r[2] == 0 and len(r[5] or "") < len(t or "") for r, (_, t) in zip(want, rows, strict=True))

    def test_order_is_lexicographic(self):
        rng = np.random.default_rng(2)
        for high in (1, 3, 1 << 40):
            words = rng.integers(0, high, (500, 6)).astype(np.uint64)
            order = suffix_dedup.multikey_order(words)
            assert [tuple(words[i]) for i in order] == sorted(map(tuple, words))

    def test_segments_give_the_same_windows(self):
        raw = some_text(random.Random(3), 5000, "abcdefghij").encode()
        with np.errstate(over="ignore"):
            parts = suffix_dedup.anchors(raw, segment=1500)
        covered = sorted(w for lo, hi in zip(parts[1], parts[2], strict=True) for w in range(lo, hi + 1))
        assert covered == list(range(len(raw) - 399))


class TestNgramJoin:
    def texts(self, rng):
        words = [some_text(rng, rng.randint(1, 6), "abcdefghijk") for _ in range(400)]
        out = [None, "", " \n", "One", "one", "one two", "ONE  two", "one two three"]
        for _ in range(30):
            base = [rng.choice(words) for _ in range(rng.choice([5, 12, 25, 80, 300]))]
            for _ in range(rng.randint(1, 6)):
                copy = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
                out.append(" ".join(copy) if rng.random() < 0.8 else "\t".join(copy).upper())
        return out

    @pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5)])
    def test_equals_all_pairs(self, spark, percent, n):
        docs = [(i * 3 + 1, t) for i, t in enumerate(self.texts(random.Random(8)))]
        df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, rep int").repartition(3)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df, percent, n).collect())
        assert got == sorted(shingle_components(docs, percent, n))

    def test_rows_without_ids_link_by_near_texts(self, spark):
        rng = random.Random(5)
        words = [some_text(rng, 5, "abcdefghijk") for _ in range(100)]
        near = [*words[:50], "zzz", *words[51:]]
        other = [some_text(rng, 5, "lmnopq") for _ in range(100)]
        rows = [(None, " ".join(near)), (8, " ".join(words)), (None, " ".join(other)), (None, " ".join([*other[:-1], "y"])), (3, " ".join(words[:20])), (3, " ".join(other[:30]))]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()), key=str)
        assert got == sorted([(None, 98, 8), (8, 98, 8), (None, 98, None), (None, 98, None), (3, 18, 3), (3, 28, 3)], key=str)

    def test_ids_of_any_type(self, spark):
        df = spark.createDataFrame([("b", "a b c d"), ("a", "A b c D"), ("c", None)], "doc_id string, text string")
        assert sorted((r.doc_id, r.component_id) for r in ngram_join.join(df).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]

    def test_opened_groups_find_what_the_star_misses(self, spark):
        """Chains: a-b and b-c link, a-c doesn't, so the group's first member isn't enough."""
        rng = random.Random(4)
        base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
        docs = []
        for chain in range(12):
            words = [f"{w}x{chain}" for w in base]
            for step in range(8):
                docs.append((len(docs), " ".join(words)))
                for k in range(3):
                    words[(step * 24 + k * 3) % 200] = f"new{step}{k}{chain}"
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()) == sorted(shingle_components(docs, 90))

    @pytest.mark.parametrize(("percent", "often"), [(90, 0), (90, 3), (80, 0), (80, 3), (80, 6), (80, 7)])
    def test_linked_sets_share_a_signature(self, percent, often):
        """Whichever shingles count as common: none, some, most or all."""
        rng = random.Random(1)
        part = percent // (100 - percent)
        with np.errstate(over="ignore"):
            for _ in range(8000):
                n = rng.choice([rng.randint(1, 40), rng.randint(5, 60), rng.randint(1, 400)])
                a = {rng.getrandbits(64) for _ in range(n)}
                b = set(list(a)[rng.randint(0, n // part + 1) :]) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // part + 1))}
                if b and a != b and 100 * len(a & b) >= percent * len(a | b):
                    common = np.array(sorted(x for x in a | b if x % 7 < often), np.uint64)
                    sa, sb = (ngram_join.signatures(np.array(sorted(s), np.uint64), percent, common) for s in (a, b))
                    assert len(np.intersect1d(sa, sb)), (len(a), len(b), len(a & b))

    def test_empty_table_and_repeated_rows(self, spark):
        df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (7, "a b c d"), (None, "a b c d")], "doc_id long, text string")
        assert sorted(str(r.component_id) for r in ngram_join.join(df).collect()) == ["5"] * 4
        assert ngram_join.join(df.limit(0)).count() == 0


class TestCaps:
    def test_recall_and_counts(self, spark):
        rng = np.random.default_rng(3)
        base = rng.standard_normal((60, 64))
        x = np.concatenate([base, base[:40] + 0.3 * rng.standard_normal((40, 64)), base[:5], 2 * base[:5], base[0] + 0.05 * rng.standard_normal((50, 64))]).astype(np.float32)
        label = rng.integers(0, 2, len(x)).tolist()
        rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(len(x))]
        odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0][1], None), (904, [None, *rows[0][1][1:]], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [1e30] + [0.0] * 63, 0)]
        df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
        got = {r.vec_id: r for r in cap_filters.near(df).collect()}
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        link = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
        np.fill_diagonal(link, False)
        want = link.sum(axis=1)
        have = np.array([got[i].n_links for i in range(len(x))])
        assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
        assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (900, 901, 902, 903, 904, 907))
        assert got[905].n_links == 1 and got[906].component_id == 905 and not got[906].kept
        assert cap_filters.near(df.limit(0)).count() == 0

    def test_ids_only_name(self, spark):
        """Repeated and null ids, equal vectors, ties at the least cosine; a label whose links lie between 0.93 and 0.99."""
        rng = np.random.default_rng(7)
        base = rng.standard_normal((12, 64))
        near = base + 0.25 * rng.standard_normal((12, 64))
        x = np.concatenate([base, near, base[:2], -base[:1]]).tolist()
        far = [0.0] * 64
        tie_a, tie_b = [1.0, 0.0, *far[2:]], [4.0, 3.0, *far[2:]]
        x += [tie_a, tie_b]
        labels = [1] * 27 + [2, 2]
        ids = [1, 1, 2, None, 5, 6, 7, 8, 9, 10, 11, 12, 1, None, 3, None, 20, 21, 22, 23, 24, 25, 26, 27, 40, 41, 42, 50, 50]
        df = spark.createDataFrame(list(zip(ids, x, labels, range(len(x)), strict=True)), "vec_id long, embedding array<double>, label int, rep int").repartition(3)
        for least in (0.93, 0.8):
            got = cap_filters.near(df, least).collect()
            count, root = brute_links(x, labels, least)
            name = {r: min((i for i, q in zip(ids, root, strict=True) if q == r and i is not None), default=None) for r in root}
            want = [(i, n, name[r], i == name[r]) for i, n, r in zip(ids, count, root, strict=True)]
            assert sorted(map(str, got)) == sorted(f"Row(vec_id={w[0]}, n_links={w[1]}, component_id={w[2]}, kept={w[3]})" for w in want)

    @pytest.mark.parametrize(("dim", "rows"), [(64, 10**5), (64, 10**6), (64, 10**7), (16, 10**6)])
    def test_recall_of_farthest_links_at_any_size(self, dim, rows):
        """Pairs at cosine 0.93 meet in the filters that a table of so many rows would get."""
        code = cap_filters.Code(dim, rows)
        rng = np.random.default_rng(9)
        a = rng.standard_normal((2000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        side = rng.standard_normal((2000, dim))
        side -= (side * a).sum(axis=1, keepdims=True) * a
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        met, per_row = 0, []
        for lo in range(0, 2000, 250):
            for x, y in zip(code.filters(a[lo : lo + 250]), code.filters(b[lo : lo + 250]), strict=True):
                met += len(np.intersect1d(x, y)) > 0
                per_row.append(len(x))
        print(dim, rows, met / 2000, np.mean(per_row))
        assert met / 2000 >= 0.985

    def test_blocks_count_each_link_once(self, spark, monkeypatch):
        monkeypatch.setattr(cap_filters, "BLOCK", 8)
        rng = np.random.default_rng(4)
        x = np.ones(64) + 0.01 * rng.standard_normal((70, 64))
        df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
        got = cap_filters.near(df).collect()
        assert {(r.n_links, r.component_id) for r in got} == {(69, 0)}


class TestArchives:
    @pytest.mark.parametrize("version", [1, 2])
    def test_arc_round_trip(self, version):
        records = [("http://a/ b\n", "text/html", b"x\ny"), (None, "text/plain", b""), ("http://c", "text/html", "é\r\n\r\nWARC/1.1".encode())]
        got = list(warc.parse_arc(warc.write_arc(iter(records), version)))
        assert [r["body"] for r in got] == [r[2] for r in records] and got[0]["URL"] == "http://a/%20b%0A" and got[1]["URL"] == "urn:unknown"
        assert ("Checksum" in got[0]) == (version == 2)

    @pytest.mark.parametrize("data", [b"filedesc://x 0.0.0.0 20240101000000 text/plain 999\n1 0 x\n", b"nonsense\n", b"http://a 0 0 t 1\nx", b"filedesc://x 0.0.0.0 2 text/plain 7\n9 0 x\ny\n"])
    def test_broken_arc(self, data):
        with pytest.raises(ValueError):
            list(warc.parse_arc(data))

    def test_large_records_get_files_of_their_own(self, spark, monkeypatch):
        monkeypatch.setattr(warc, "FILE_RECORDS", 4)
        monkeypatch.setattr(warc, "FILE_BYTES", 4000)
        pages = [(i, f"http://a/{i % 5}", ("x" * (2500 if i % 3 == 0 else 20)) + str(i % 6)) for i in range(30)]
        folder = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(1))
        heads = {}
        for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).collect():
            records = list(warc.parse_warc(gzip.decompress(bytes(f.content))))
            assert len(records) <= 4 and (len(records) == 1 or max(int(h["X-Payload-Length"]) for h, _ in records) < 1000)
            heads |= {int(h["X-Page-ID"]): h for h, _ in records}
        assert sorted(heads) == list(range(30))
        for i in range(0, 24, 3):
            winner = heads[24 + i % 6]
            assert heads[i]["WARC-Type"] == "revisit" and heads[i]["WARC-Refers-To"] == winner["WARC-Record-ID"] and heads[i]["WARC-Refers-To-Target-URI"] == winner["WARC-Target-URI"]

    def test_empty_table(self, spark):
        df = spark.createDataFrame([], "page_id long, url string, html string")
        assert warc.read_archives(spark, warc.write_archives(df)).count() == 0

    def test_write_and_read(self, spark):
        big = "<p>é</p>\r\n\r\n" * 200
        pages = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "http://d", "small"), (5, "u", None), (6, "u", ""), (2, "http://b", big)]
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, warc.write_archives(df)).collect()), key=str)
        sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
        n = len(big.encode())
        assert got == sorted([(1, n, sha(big), "revisit", 2), (2, n, sha(big), "response", None), (2, n, sha(big), "response", None), (3, 5, sha("small"), "response", None), (4, 5, sha("small"), "response", None), (5, 0, sha(""), "response", None), (6, 0, sha(""), "response", None)], key=str)


class TestModels:
    def test_codewords_are_far_apart(self):
        c = language_id.codewords(12)
        apart = (c[:, None, :] != c[None, :, :]).sum(axis=2)[np.triu_indices(12, 1)]
        assert apart.min() >= 9 and all(0 < (c[:, b] > 0).sum() < 12 for b in range(c.shape[1]))

    def test_wrong_bits_are_corrected(self):
        c = language_id.codewords(6)
        rng = np.random.default_rng(1)
        for k in range(6):
            m = 3 * c[k].copy()
            m[rng.choice(len(m), 5, replace=False)] *= -1
            assert language_id.decode(m[None], c)[0][0] == k

    @pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
    def test_languages_of_held_out_rows(self, spark):
        from harborlight.llm import queries

        folder = BASE.replace("0.001", "0.01")
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        got = queries.op10_language_id(spark, folder).collect()
        held = [r for r in got if r.held_out]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
        assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97 and all(0 <= r.score <= 1 for r in got)

    def test_languages_without_letters(self, spark):
        df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "12 !?", "en"), (4, None, "de"), (5, "", None), (6, "und die", None)], "doc_id long, text string, lang string")
        got = {r.doc_id: r for r in language_id.predict(df, language_id.fit(df)).collect()}
        assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "und", "de"] and got[3].score == 0
        none = language_id.fit(df.where("lang = 'xx'"))
        assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}

    @pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
    def test_quality_of_held_out_rows(self, spark):
        from harborlight.llm import queries

        folder = BASE.replace("0.001", "0.01")
        label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
        got = [r for r in queries.op6_quality_model(spark, folder).collect() if r.held_out and r.doc_id in label]
        assert np.mean([r.predicted == label[r.doc_id] for r in got]) >= 0.95

    def test_scores_equal_a_plain_forward_pass(self):
        rng = np.random.default_rng(8)
        bags = [quality_model.encode(bytes(rng.integers(32, 127, n).astype(np.uint8))) for n in (10, 600, 3000, 1300, 50, 5000) * 5]
        m = quality_model.train(bags, np.arange(30, dtype=np.float32) % 2, epochs=4)
        for x in bags[:6]:
            got = quality_model.forward(m, x, np.zeros(len(x), int), 1)["y"][0]
            assert abs(got - attention_score({k: v.tolist() for k, v in m.items()}, x.tolist())) < 1e-4

    def test_features_by_counting(self):
        text = "Ab 1!\n" * 120 + "zzé"
        raw = text.encode()
        x = quality_model.encode(raw)
        parts = [raw[:512], raw[512:]]
        assert len(x) == 2
        for p, row in zip(parts, x, strict=True):
            for k in range(quality_model.CLASSES):
                share = sum(quality_model.CLASS[c] == k for c in p) / len(p)
                assert abs(row[k] - share**0.5) < 1e-6

    def test_blocks_of_passages_change_nothing(self, monkeypatch):
        raw = bytes(np.random.default_rng(1).integers(32, 127, 512 * 23 + 60).astype(np.uint8))
        whole = quality_model.encode(raw)
        for block in (1, 4, 22, 23):
            monkeypatch.setattr(quality_model, "BLOCK", block)
            assert np.array_equal(quality_model.encode(raw), whole)

    def test_drawn_shares_are_put_right(self, spark):
        """900 of 1000 labels are 1 and the text says nothing: scores are 0.9, also if the draw is half and half."""
        rng = random.Random(2)
        rows = [(i, some_text(rng, 300, "abcdefgh "), int(i % 10 > 0)) for i in range(3000)]
        df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
        for sample in (400, 100_000):
            scores = [r.score for r in quality_model.score(df.limit(300), quality_model.fit(df, df, sample=sample)).collect()]
            assert 0.8 < np.median(scores) < 0.97, sample
        assert abs(quality_model.offset(900, 100, 50, 50) - np.log(9)) < 1e-9

    def test_codes_decode_as_a_plain_loop(self):
        import math

        rng = np.random.default_rng(3)
        code = language_id.codewords(5)
        margins = rng.normal(0, 2, (40, code.shape[1]))
        best, p, close = language_id.decode(margins, code)
        for i in range(40):
            loss = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins[i], word, strict=True)) for word in code]
            assert best[i] == loss.index(min(loss))
            assert abs(p[i] - 1 / sum(math.exp(min(loss) - x) for x in loss)) < 1e-9
            assert close[i] == (sorted(loss)[1] - min(loss) < language_id.AMBIGUOUS * len(code[0]))

    def test_grams_by_counting(self):
        text = "Ça va? 12  BIEN"
        raw = text.encode()
        folded = bytes([32]) + bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in raw) + bytes([32])
        folded = re.sub(b" +", b" ", folded)
        want = [0] * language_id.SIZE
        for k, m in ((2, 0x85EBCA6B), (3, 0x9E3779B1)):
            for i in range(len(folded) - k + 1):
                want[(int.from_bytes(folded[i : i + k], "big") * m % (1 << 32)) >> 20] += 1
        assert language_id.grams(raw).tolist() == want

    def test_attention_finds_the_telling_passage(self):
        rng = np.random.default_rng(2)
        good = lambda: quality_model.encode(bytes(rng.integers(97, 122, 512).astype(np.uint8)))
        bad = lambda: quality_model.encode(b"!!?? " * 100)
        bags = [np.concatenate([good() for _ in range(3)]) for _ in range(60)] + [np.concatenate([good(), bad(), good()]) for _ in range(60)]
        m = quality_model.train(bags, np.array([1.0] * 60 + [0.0] * 60, np.float32), epochs=60)
        f = quality_model.forward(m, bags[-1], np.zeros(3, int), 1)
        assert f["y"][0] < 0.5 < quality_model.forward(m, bags[0], np.zeros(3, int), 1)["y"][0]

    def test_scores_without_labels(self, spark):
        df = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string")
        labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
        assert {r.score for r in quality_model.score(df, quality_model.fit(df, labels)).collect()} == {1.0}
        assert {r.score for r in quality_model.score(df, quality_model.fit(df, labels.limit(0))).collect()} == {0.5}


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
def test_pipeline_stages(spark):
    """Each stage's effect on what the stage before kept."""
    import corpus_pipeline as cp
    from harborlight.llm import secret_scan

    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, kept[-1], BASE)
        path = f"{cp.stored(out, 'test').inputFiles()[0].rsplit('/', 1)[0]}"
        kept.append(spark.read.parquet(path))
        if name != "packing":
            assert kept[-1].columns == columns, name
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    assert set(rows[1]) < set(rows[0])
    comps = shingle_components(sorted(rows[1].items()), 80, 5)
    assert set(rows[2]) == {d for d, _, c in comps if d == c}
    order = sorted(rows[2])
    runs = repeated_bytes([rows[2][i].encode() for i in order], 200)
    for i, r in zip(order, runs, strict=True):
        raw = rows[2][i].encode()
        r = [(a, b) for a, b in r if suffix_dedup.words_in(raw, a, b) >= 50]
        assert rows[3][i] == suffix_dedup.without(rows[2][i].encode(), r).decode("utf-8", "ignore")
        assert rows[4][i] == secret_scan.redact(rows[3][i], secret_scan.find(rows[3][i]))
    assert {r.doc_id for r in kept[-1].collect()} == set(rows[4])


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, ties, repeated rows, an empty table, columns named like the operators' own."""
    import corpus_pipeline as cp

    rng = random.Random(9)
    texts = [some_text(rng, 300, "abcdefgh ") for _ in range(20)] + [None, "", " ", "x" * 50_000, some_text(rng, 3, "ab")]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None if i % 5 == 0 else 1, "c", i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None, None, None), (77, texts[4], None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, rep int")
    labels = spark.createDataFrame([(i, i % 4 != 0, 0) for i in range(20)] + [(None, True, 0)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "cast(quality as int) quality", "toxic")
    for name, part in (("all", docs), ("none", docs.limit(0))):
        base = f"{tmp_path}/{name}"
        part.write.parquet(f"{base}/documents.parquet")
        labels.write.parquet(f"{base}/labels.parquet")
        got = cp.run(spark, base).collect()
        if name == "none":
            assert got == []
        else:
            assert got and all(p.length >= 1 for p in got)


def test_one_row_of_each_text_stays(spark):
    """Repeated rows, copies without an id, and a repeated id of which only one text is a copy; all longer than 400 bytes."""
    import corpus_pipeline as cp

    rng = random.Random(12)
    a, b, c, d, e = (" ".join(some_text(rng, 6, "abcdefghijk") for _ in range(100)) for _ in range(5))
    near = d.split()
    near[50] = "zzz"
    rows = [(1, a), (1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (4, d), (4, e), (3, d), (None, " ".join(near)), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    near_kept = cp.stored(cp.near_duplicates(spark, docs, ""), "test")
    want = sorted([(1, a), (2, b), (None, c), (3, d), (4, e), (9, None), (None, "")], key=str)
    assert sorted([(r.doc_id, r.text) for r in near_kept.collect()], key=str) == want
    assert sorted([(r.doc_id, r.text) for r in cp.repeats(spark, near_kept, "").collect()], key=str) == want
