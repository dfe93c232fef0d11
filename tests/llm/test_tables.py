"""Token files, licences, URL rules, mixing, search, resampling and the pipeline on small tables."""

from __future__ import annotations

import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelweave.llm import importance, licenses, mih, mixing, token_planes, url_cascade
from panelweave.llm.queries import QUERIES, SQL, tokenizer_path
from conftest import SF

TOKENIZER = tokenizer_path("byte_bpe_50k.json")

ODD_TEXTS = [None, "", "  a  b \n c", "x\n \ny", "a b  ", "   x y", " lead", "a\tb \n\n c", ". , '' 's <|endoftext|> x", "it's 12'000 \x1c é—\xa00 中文\u2003 ", "word " * 30_000]


def encoded(texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(TOKENIZER)
    return [tool.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_give_the_ids_of_whole_texts():
    import pyarrow as pa

    r = random.Random(1)
    parts = [*"abZ 09.,'!\n\t\r é中—st\x1c\x00\xa0\u2003", "'s", "'re", " '", "<|endoftext|>", "  ", "\n\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(4000)] + [t for t in ODD_TEXTS if t is not None]
    encoder = token_planes.Encoder(TOKENIZER)
    want = encoded(texts)
    for _ in range(2):  # the second time from memory
        for rows, raw, off in token_planes.text_slices(pa.array(texts)):
            ids, size = encoder.encode(raw, off)
            got = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
            assert got == want[rows]


def encoded_by_slices(encoder, texts):
    import pyarrow as pa

    out = []
    for _, raw, off in token_planes.text_slices(pa.array(texts)):
        ids, size = encoder.encode(raw, off)
        out += [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
    return out


def test_letters_of_two_bytes_give_the_ids_of_whole_texts(monkeypatch):
    r = random.Random(2)
    letters = [chr(k) for k in range(0x80, 0x800)]
    parts = [*"ab ZZ 1.,'\n\t ", *"éüßñÀªºµ×÷²\x85\xa0ƻǅӐяשب", "e\u0301", "中", "\u2003", "’", "'s", " é", ". ", "ﬁ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(2000)]
    texts += ["".join(r.choice([*"a. '\n", r.choice(letters), r.choice(letters)]) for _ in range(20)) for _ in range(2000)]
    texts += [a + x + b for x in letters for a, b in (("", "."), (" ", "a"), ("'", " "), (".", ""))]
    want = encoded(texts)
    # Also with words encoded few at a time, and a memory that forgets in every slice.
    for size, kept in ((1 << 16, 400_000), (40, 1000)):
        monkeypatch.setattr(token_planes, "WORDS_BYTES", size)
        monkeypatch.setattr(token_planes, "CACHE_PIECES", kept)
        encoder = token_planes.Encoder(TOKENIZER)
        for _ in range(2):
            for at in range(0, len(texts), 5000):
                assert encoded_by_slices(encoder, texts[at : at + 5000]) == want[at : at + 5000]


def test_new_words_need_no_split(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéüßñж") for _ in range(9)) for _ in range(3000)]
    text = " ".join(w + r.choice(["", ".", ",", "!"]) for w in words)
    encoder = token_planes.Encoder(TOKENIZER)
    split, whole = [], encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda texts: split.extend(texts) or whole(texts))
    assert encoded_by_slices(encoder, [text]) == encoded([text])
    # Only the marks go through the tokenizer's split; words are remembered without them.
    assert sum(map(len, split)) < 100
    split.clear()
    assert encoded_by_slices(encoder, [" " + "! ".join(words[1:])]) == encoded([" " + "! ".join(words[1:])])
    assert not split and encoder.count <= len(words) + 4


def test_pieces_met_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(token_planes, "CACHE_PIECES", 500)
    encoder = token_planes.Encoder(TOKENIZER)
    often = [f" often{chr(97 + k)}" for k in range(20)]
    fresh, seen = encoder._fresh, []

    def note(raw, *rest):
        starts, ends = rest[-2:]
        seen.extend(raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True))
        return fresh(raw, *rest)

    monkeypatch.setattr(encoder, "_fresh", note)
    r = random.Random(4)
    texts = ["".join(often + [" " + "".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(200)]) for _ in range(20)]
    for text, want in zip(texts, encoded(texts), strict=True):
        assert encoded_by_slices(encoder, [text]) == [want]
        assert encoder.count < 900
    assert all(seen.count(w) == 1 for w in often)


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    planes, ends = token_planes.to_planes(ids, mode)
    assert len(ends) == (4 if mode == "byte" else 32)
    assert (token_planes.from_planes(planes, ends, n, mode) == ids).all()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_files_round_trip(spark, tmp_path, mode):
    rows = [(10 * i, t, i) for i, t in enumerate(ODD_TEXTS)] + [(5, "again", 1), (5, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    path = str(tmp_path / "tokens")
    token_planes.write_tokens(docs, path, TOKENIZER, 2, block_ids=1000, mode=mode)
    got = sorted(map(tuple, token_planes.read_documents(spark, path).collect()))
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda x: x[0]):
        ids = [*encoded([t])[0], 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    index = sorted(map(tuple, token_planes.chunk_index(spark, path).select("start", "n_ids").collect()))
    assert index[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(index[:-1], index[1:], strict=True)) and sum(index[-1]) == start


def test_token_files_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_planes.tokens_round_trip(docs, TOKENIZER, 2).count() == 0
    one = spark.createDataFrame([(None, "a"), (1, None)], docs.schema)
    got = sorted(map(tuple, token_planes.tokens_round_trip(one, TOKENIZER, 2).select("start", "n_tokens", "doc_id").collect()))
    assert got == [(0, 2, None), (2, 1, 1)]


def test_licences(spark):
    known = licenses.known_digests(spark)
    changed = "Copyright (c) 2020 Somebody\n(C) Another\n  All rights reserved.\n" + licenses.MIT.replace('"', "”").replace("sublicense", "sub-licence").replace("\n\n", "\n  * ").upper()
    rows = [(1, licenses.MIT), (2, changed), (3, licenses.MIT + " But not quite."), (4, None), (5, ""), (6, "Some text.\nlicenced under the Apache license (version 2.0)\nReleased under the MIT Licence!\nReleased under the MIT License."), (6, "x"), (7, licenses.ISC + " y" * 200_000)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"], r["notices"]) for r in licenses.scan_licenses(docs, known).collect()}
    assert got == {(1, "MIT", None), (2, "MIT", None), (3, None, None), (4, None, None), (5, None, None), (6, None, "Apache-2.0,MIT"), (6, None, None), (7, None, None)}
    digests = {r["doc_id"]: r["digest"] for r in licenses.scan_licenses(docs, known).collect()}
    assert digests[4] is None and digests[1] == digests[2] != digests[3]
    assert licenses.scan_licenses(docs.limit(0), known).count() == 0


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

(a) Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
(b) Redistributions in binary form must reproduce the above copyright notice in the documentation and/or other materials.
(c) Neither the name of the copyright holder nor the names of its contributors may be used without permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS". IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""


def test_licences_do_not_depend_on_wrapping(spark):
    known = licenses.known_digests(spark, [("MIT", licenses.MIT), ("ISC", licenses.ISC), ("BSD", BSD)])
    heads = ["", "Copyright (c) 2020 Somebody\nCopyright 2021 B\n# Copyright by C\n© D\nCopyright [yyyy] [name]\n(c) 2022 E\n(c) F\nAll rights reserved.\n\n"]
    texts = [("MIT", licenses.MIT), ("ISC", licenses.ISC), ("BSD", BSD)]
    # Wrapped at several widths, and before every "copyright" and "all rights".
    wraps = [lambda t, w=w: "\n".join(textwrap.fill(p, w) for p in t.split("\n")) for w in (40, 66, 72, 79)]
    wraps.append(lambda t: re.sub(r" (?=copyright|\"copyright)", "\n", t, flags=re.I))
    rows = [(name, head + wrap(t)) for name, t in texts for head in heads for wrap in wraps]
    docs = spark.createDataFrame([(f"{i}/{name}", t) for i, (name, t) in enumerate(rows)], "doc_id string, text string")
    assert all(r["license"] == r["doc_id"].split("/")[1] for r in licenses.scan_licenses(docs, known).collect())
    # A clause less is another text, also when it is lettered with (c).
    less = spark.createDataFrame([(1, re.sub(r"\(c\)[^\n]*\n", "", BSD)), (2, licenses.ISC.replace("copyright notice and this permission notice appear in all copies.", ""))], "doc_id long, text string")
    assert [r["license"] for r in licenses.scan_licenses(less, known).collect()] == [None, None]


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts here")
def test_whole_licence_texts_are_known_however_wrapped(spark):
    names = {"Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}
    rows = []
    for file in sorted(f for f in COMMON.iterdir() if f.is_file() and not f.is_symlink()):
        text, name = file.read_text(), names.get(file.name, file.name)
        if name not in {n for n, _ in licenses.DIGESTS}:
            continue
        short = text.split("END OF TERMS AND CONDITIONS")
        rows += [(name, text), (name, text.replace("\n", "\r\n").upper()), (name, "\n".join("  // " + x for x in text.split("\n")))]
        rows += [(name, short[0] + "END OF TERMS AND CONDITIONS")] if len(short) == 2 else []
        rows.append((None, text[: len(text) // 2]))
    assert len({n for n, _ in rows}) >= 10
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]


def test_licence_sql_states_the_same_rule(spark):
    lines = ["Copyright (c) 2020 A", "copyright notice here", "(c) A person", "(c) a licence clause", "© A", "All rights reserved.", "all rights reserved by A", "# Copyright by A", "copyright byte", "(c) 2020", "(b) two", "(a) one", " (C) B (b) both", "x (c) A", "Copyright [yyyy] A", "Copyright 2021", "[(c) copyrighted", "", "organise colour"]
    r = np.random.default_rng(3)
    texts = ["\n".join(r.choice(lines, size=r.integers(1, 9))) for _ in range(400)] + [licenses.MIT, BSD, None, ""]
    texts += [f.read_text() for f in sorted(COMMON.glob("*")) if f.is_file()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((tuple(x) for x in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()), key=lambda x: x[0])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(con.sql(licenses.scan_sql()).fetchall(), key=lambda x: x[0])
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b] == []


def test_licence_scan_stays_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licenses.scan_licenses(docs, licenses.known_digests(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


URLS = ["https://a.example.org/es/1", "http://EXAMPLE.org/en/12?q=1#t", "https://x.example.org", "ftp://example.org/en/2", "http://b.com/de/", "http://com/fr/x", "http://xcom/fr/x", "no scheme", None, "", "x://", "http://b.com?/de/", "http://b.com/DE/", "http://b.com/de/", "http://u:p@b.com:80/de/"]


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = path = ""
    if rest is not None:
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("per_cascade", [url_cascade.KEYS_PER_CASCADE, 2])
def test_url_rules(spark, monkeypatch, per_cascade):
    monkeypatch.setattr(url_cascade, "KEYS_PER_CASCADE", per_cascade)
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/", "block"), ("b.com", "/DE/", "allow"), ("b.com", "/DE/", "block")]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)] + [(None, URLS[0], "k")], "page_id long, url string, rule string")
    got = url_cascade.judge_urls(pages, spark.createDataFrame([*rules, (None, "/x", "block")], "host string, path string, verdict string"))
    want = [(i, *brute_url(u, rules)) for i, u in [*enumerate(URLS), (None, URLS[0])]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_url_rules_of_nothing(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in url_cascade.judge_urls(pages, none).collect()] == [(1, "a.b", "/c", None, "allow")]
    some = spark.createDataFrame([("a.b", None, "block")], none.schema)
    assert [r["rule"] for r in url_cascade.judge_urls(pages, some).collect()] == ["a.b"]
    assert url_cascade.judge_urls(pages.limit(0), some).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), (F.col("id") % 7 == 0).alias("inside"))
    levels = url_cascade.build_cascade(keys.filter("inside"), keys)
    rows = keys.toPandas()
    assert len(levels) > 2
    assert (url_cascade.in_cascade(levels, rows["h1"].to_numpy(), rows["h2"].to_numpy()) == rows["inside"].to_numpy()).all()


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w for s, w in weight.items() if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in names}
        more = {s for s in names if target[s] > most * sizes[s] * (1 + 1e-12)}
        if not more:
            return target
        capped |= more


def mixed_table(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        source = r.choice(["big"] * 20 + ["é", "z", "Z", None, "a"])
        rows.append((i, " ".join("w" for _ in range(r.randrange(120))), source, "k"))
    rows += [(300, None, "a", "k"), (301, "", "only blank", "k"), (302, "v " * 9000, "big", "k"), rows[0], (None, "w w w", None, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, number string"), rows


def test_mixture_meets_its_targets(spark):
    docs, rows = mixed_table(spark)
    sizes: dict = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    mixture = mixing.mix(docs, block_words=4, shard_slots=64)
    got = mixture.docs.collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _, _ in rows)
    want = brute_targets(sizes)
    source_of = {i: s for i, _, s, _ in rows}
    taken: dict = defaultdict(int)
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 8 + 0.02 * want[s] for s in sizes)
    again = mixing.mix(docs.repartition(7), block_words=4, shard_slots=64).docs.collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    # Slots are dealt once each, and the joined blocks add up to what is taken.
    slots = mixture.slots.collect()
    assert sorted((r["shard"], r["slot"]) for r in slots) == [(k // 64, k % 64) for k in range(len(slots))]
    words = mixture.shards().groupBy("doc_id").agg(F.sum("words").alias("w")).collect()
    per_doc: dict = defaultdict(int)
    for r in got:
        per_doc[r["doc_id"]] += r["taken"]
    assert {r["doc_id"]: r["w"] for r in words} == {k: v for k, v in per_doc.items() if v}
    shares = mixture.slots.groupBy("shard", "number").count().collect()
    whole = Counter(r["number"] for r in slots)
    full = [r for r in shares if r["shard"] == 0]
    assert all(abs(r["count"] - 64 * whole[r["number"]] / len(slots)) <= 6 * (64 * whole[r["number"]] / len(slots)) ** 0.5 + 1 for r in full)


def test_mixed_documents_keep_their_columns(spark):
    docs, rows = mixed_table(spark)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    counts = Counter(r["doc_id"] for r in got.collect())
    assert max(counts.values()) <= 6 and counts[300] == 1 and counts[301] == 1  # row 0 is there twice
    assert mixing.mix(docs.limit(0)).docs.count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixture_is_staged_and_sums_to_what_is_taken(spark):
    docs, _ = mixed_table(spark)
    got = mixing.mix(docs, block_words=4, shard_slots=64)
    assert "Join" not in got.mixture._jdf.queryExecution().toString()
    assert got.mixture.groupBy("shard", "slot").agg(F.sum("words").alias("w")).filter("w > 4").count() == 0
    assert got.mixture.agg(F.sum("words")).first()[0] == got.docs.agg(F.sum("taken")).first()[0]


def test_mixed_documents_keep_the_sums_of_sources(spark):
    rows = [(i, "w " * (5 + (i * i) % 90), ("a", "b", None)[i % 7 % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["source"]: r["t"] for r in mixing.mix(docs).docs.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    words: dict = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        words[r["source"]] += len(r["text"].split())
    assert set(words) == set(taken) and all(abs(words[s] - t) <= 2 * 94 for s, t in taken.items())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations_are_one_to_one(spark, n):
    x = mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(5)])
    got = [r[0] for r in spark.range(n).select(x).collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != sorted(got)


def test_mixing_stays_in_the_jvm(spark):
    docs, _ = mixed_table(spark)
    plan = mixing.mix(docs).docs._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nearest_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 16)).astype(np.float32) * r.uniform(0.5, 2, size=(700, 1)).astype(np.float32)
    x[100:180] = x[3]  # a group of equal vectors, ties included
    rows = [(i, v.tolist(), "k") for i, v in enumerate(x)]
    rows += [(720, None, "k"), (740, [0.0] * 16, "k"), (760, [float("nan")] + [1.0] * 15, "k"), (780, [float("inf")] + [1.0] * 15, "k"), (800, [None] + [1.0] * 15, "k"), (820, [1.0] * 15, "k"), (840, [], "k"), (None, [1.0] * 16, "k")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    got = defaultdict(list)
    for q, rank, v, score in mih.nearest_vectors(table, k=20, every=20).orderBy("query_id", "rank").collect():
        got[q].append((rank, v, score))
    assert sorted(got) == [i for i in range(700) if i % 20 == 0]
    hits = 0
    y = x.astype(np.float64)
    for q, found in got.items():
        score = y @ y[q]
        best = [i for i in np.lexsort((np.arange(700), -np.round(score, 9))) if i != q][:20]
        hits += len(set(best) & {v for _, v, _ in found})
        assert [a for a, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    assert hits >= 0.95 * 20 * len(got)
    equal = [v for _, v, _ in got[120]]
    assert 3 in equal and equal == sorted(equal) or len(set(equal)) == 20


def test_few_vectors_are_all_found(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["vec_id"]) for r in mih.nearest_vectors(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 20), (0, 1), (0, 2), (20, 0), (20, 1), (20, 2)]
    assert mih.nearest_vectors(table.filter("vec_id > 50")).count() == 0
    assert mih.nearest_vectors(table.filter("vec_id in (1, 2)")).count() == 0


def test_repeated_query_rows_each_have_all_their_neighbours(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 12))
    single = [(i, v.tolist()) for i, v in enumerate(x)]
    # Row 0 three times, and id 20 with a second vector.
    rows = [*single, (0, x[0].tolist()), (0, x[0].tolist()), (20, (-x[20]).tolist())]
    make = lambda data: spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    columns = lambda d: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in d.collect())
    alone = [t for t in columns(mih.nearest_vectors(make(single))) if t[0] == 0]
    assert [t[1] for t in alone] == list(range(1, 21)) and len({t[2] for t in alone}) == 20
    for repeats in (10_000, 2):
        monkeypatch.setattr(mih, "REPEATS", repeats)
        got = columns(mih.nearest_vectors(make(rows)))
        # The second vector of id 20 is one more candidate of row 0; the ranks of its copies agree.
        of_0 = [t for t in got if t[0] == 0]
        assert len(of_0) == 60 and of_0[::3] == of_0[1::3] == of_0[2::3]
        every = np.r_[x, -x[20:21]]
        score = every @ x[0]
        best = sorted((-s, i) for i, s in zip([*range(300), 20], score) if i != 0)[:20]
        assert len({(-round(s, 9), i) for s, i in best} & {(round(t[3], 9), t[2]) for t in of_0}) >= 18
        of_20 = [t for t in got if t[0] == 20]
        assert len(of_20) == 40 and [t[1] for t in of_20] == [k for k in range(1, 21) for _ in range(2)]
        assert all(min(abs(s - x[v] @ x[20]), abs(s + x[v] @ x[20])) < 1e-9 for _, _, v, s in of_20)


def test_multi_index_finds_every_code_within_the_radius():
    r = np.random.default_rng(6)
    codes = r.integers(0, 256, size=(500, 4), dtype=np.uint8)
    index = mih.ShardIndex(codes)
    for radius in (0, 3, 6, 9, 13):
        for code in codes[:20]:
            near = np.flatnonzero(mih._distances(code, codes) <= radius)
            assert set(near) <= set(index.search(code, radius, 1))


def test_resampling(spark):
    rows = [(i, ("good words here " if i % 2 else "bad noise there ") * (1 + i % 5)) for i in range(200)] + [(200, None), (201, ""), (3, "good words here"), (None, "x")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    good = spark.createDataFrame([(i,) for i in range(1, 60, 2)] + [(None,), (999,)], "doc_id long")
    got = importance.resample(docs, good, share=0.5)
    found = got.collect()
    assert len(found) == len(rows) and sum(r["selected"] for r in found) == 102
    by = {r["doc_id"]: r for r in found}
    assert by[199]["log_weight"] > 0 > by[198]["log_weight"] and by[200]["log_weight"] == 0 and by[200]["n_grams"] == 0
    assert sum(r["selected"] for r in found if r["doc_id"] is not None and r["doc_id"] % 2 and r["doc_id"] < 200) >= 95
    # Weights against plain counting, hashing apart.
    grams = lambda t: (w := (t or "").split()) + list(zip(w, w[1:], strict=False))
    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for i, t in rows for g in grams(t) if i is not None and i < 60 and i % 2)
    q, p = sum(raw.values()), sum(target.values())
    want = sum(np.log((target[g] + 1e-4) / (p + 1)) - np.log((raw[g] + 1e-4) / (q + 1)) for g in grams(rows[7][1]))
    assert abs(by[7]["log_weight"] - want) < 0.02 * abs(want)
    again = importance.resample(docs.repartition(5), good, share=0.5)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, found))
    assert {r["log_weight"] for r in importance.resample(docs, good.limit(0)).collect()} == {0.0}
    assert importance.resample(docs.limit(0), good).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


def test_pipeline_against_its_stages_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in held.select("doc_id").collect()}
        out = stage(spark, held, SF)
        assert out.columns == docs.columns, name
        held = spark.createDataFrame(out.collect(), docs.schema)
        rows = held.collect()
        assert rows and {r["doc_id"] for r in rows} <= before
        assert all(r["text"] == texts[r["doc_id"]] for r in rows)
    counts = Counter(r["doc_id"] for r in held.collect())
    done = corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()
    assert Counter(r["doc_id"] for r in done) == counts
    ids = {i: [*x, 2] for i, x in zip(counts, encoded([texts[i] for i in counts]), strict=True)}
    assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]], dtype="<u4").tobytes()) for r in done)


def test_pipeline_reads_and_sends_texts_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    arrow, reader = corpus_pipeline.TEXT_BATCHES
    for key in (arrow, reader):
        spark.conf.unset(key)
    default = {key: spark.conf.get(key) for key in (arrow, reader)}
    small = spark.read.parquet(f"{SF}/documents.parquet")
    long = spark.range(0, 1000, 1, 1).select(F.concat(F.col("id"), F.repeat(F.lit(" word"), 4000)).alias("text"))
    try:
        for name, stage in corpus_pipeline.STAGES:
            for key, value in default.items():
                spark.conf.set(key, value)
            stage(spark, small, SF)
            assert spark.conf.get(reader) == "512", name
            got = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
            assert sum(got) > 20_000_000 and max(got) < 5_000_000, name
        # Smaller settings stay, and the whole pipeline gives the session back as it was.
        spark.conf.set(arrow, "64k")
        spark.conf.set(reader, "100")
        corpus_pipeline.STAGES[1][1](spark, small, SF)
        assert (spark.conf.get(arrow).removesuffix("b"), spark.conf.get(reader)) in {("65536", "100"), ("64k", "100")}
        monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[:1])
        for key, value in default.items():
            spark.conf.set(key, value)
        assert corpus_pipeline.run(spark, SF).count() == small.count()
        assert {key: spark.conf.get(key) for key in default} == default
    finally:
        for key in (arrow, reader):
            spark.conf.unset(key)
