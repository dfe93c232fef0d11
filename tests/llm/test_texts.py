"""Operators on texts against brute force: nulls, blank and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelweave.llm import decontam, jaccard_join, langmix, line_cuckoo
from panelweave.llm.components import connected_components
from panelweave.llm.wordhash import ALNUM, NOT_SPACE, words_of

SCHEMA = "doc_id long, text string, lang string, source string, cls string, n int, hit int, spans_ int, items string"
#: Column names that operators use inside; none may disturb them.
CLASHES = ("x", 1, 2, 3, "y")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", *CLASHES[:2], 5, 6, "z") for i, t in rows], SCHEMA)


def ascii_lower(text: str) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def corpus(seed: int = 3):
    """Texts with copies, near copies, shared lines, blanks and a very long one."""
    r = random.Random(seed)
    word = lambda: r.choice(["al", "Be", "cé", "dü", "e1", "fo", "gu", "hi", "jo", "ka"]) + str(r.randrange(40))
    rows: list[tuple[int | None, str | None]] = []
    base = [" ".join(word() for _ in range(60)) for _ in range(4)]
    for b in base:
        rows.append((len(rows), b))
        rows.append((len(rows), b.upper() + " \n"))
        for _ in range(12):
            w = b.split()
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    shared = ["A line that many documents share, at the end", "   another SHARED line of some length\t", "short"]
    for _ in range(10):
        rows.append((len(rows), "\n".join([word(), shared[0], " ".join(word() for _ in range(9)), shared[r.randrange(3)], ""])))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n\t "), (len(rows) + 3, "one"), (len(rows) + 4, "One"), (len(rows) + 5, "one two three")]
    rows.append((len(rows), " ".join(f"w{i % 977} v{i}" for i in range(20_000))))
    rows.append(rows[0])
    rows.append((None, base[1]))
    return rows


@pytest.mark.parametrize(("letters", "pattern"), [(NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_those_of_the_pattern(letters, pattern):
    texts = [t for _, t in corpus()] + ["", None, "ends", "starts next", "中文 é—x\x00y'z"]
    got = [bytes(w.data[w.starts[i] : w.ends[i]]) for w in words_of(pa.array(texts), letters) for i in range(len(w.starts))]
    assert got == [x for t in texts for x in re.findall(pattern, ascii_lower(t))]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", ascii_lower(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def test_similar_texts_finds_every_link(spark):
    rows = corpus()
    got = jaccard_join.similar_texts(frame(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_drop_similar_keeps_one_of_each_component(spark):
    rows = corpus()
    got = jaccard_join.drop_similar(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    keep = {(c, n > 0) for _, n, c in brute_components(rows)}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(c for c, _ in keep)


def test_similar_texts_without_rows_or_words(spark):
    assert jaccard_join.similar_texts(frame(spark, [])).count() == 0
    assert sorted(map(tuple, jaccard_join.similar_texts(frame(spark, [(1, None), (2, ""), (2, "")])).collect())) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_hits(rows, items, window=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(None if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])] - {None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 150])
def test_benchmark_hits(spark, block_bytes):
    rows = corpus()
    texts = [t for _, t in rows]
    w = texts[0].split()
    items = [(1, " ".join(w[3:20])), (2, "be, " + ", ".join(w[10:30])), (3, "two three"), (3, "one"), (4, None), (5, ""), (None, " ".join(w[40:52])), (10, "Not there at all"), (1, " ".join(w[3:20])), (7, texts[-3][-400:])]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, hit string")
    got = decontam.benchmark_hits(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).drop("items")
    assert sorted(map(tuple, got.collect()), key=str) == brute_hits(rows, items)


def test_decontamination_of_and_by_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b c"), (2, None)])
    assert decontam.benchmark_hits(docs, none).filter("contaminated").count() == 0
    assert decontam.drop_contaminated(docs, none).columns == docs.columns
    assert decontam.benchmark_hits(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(1, "B c")], "item_id long, text string"))
    assert [r["doc_id"] for r in kept.collect()] == [2]


def brute_lines(rows, min_docs=3, min_chars=20):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    keeper = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rows = corpus()
    got = line_cuckoo.dedup_lines(frame(spark, rows)).drop("text")
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows)
    assert line_cuckoo.dedup_lines(frame(spark, [])).count() == 0


def test_line_index_is_reversible(spark):
    rows = [(i, t) for i, t in corpus() if i is not None][:-1]
    old, new = rows[:58], rows[58:]
    a, b = frame(spark, old), frame(spark, new)
    first = line_cuckoo.LineIndex.build(a)
    both = first.insert(b)
    back = both.delete(b)
    same = lambda ix, df, rs: sorted(map(tuple, ix.drop_lines(df).drop("text").collect()), key=str) == brute_lines(rs)
    assert same(both, frame(spark, rows), rows)
    assert same(back, a, old)
    assert sorted(map(tuple, back.heavy.collect())) == sorted(map(tuple, first.heavy.collect()))


def test_exact_way_without_filters(spark, monkeypatch):
    monkeypatch.setattr(line_cuckoo, "FILTER_BYTES", -1)
    rows = corpus()
    got = line_cuckoo.dedup_lines(frame(spark, rows)).drop("text")
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows)


def test_cuckoo_filter_inserts_and_deletes():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64)
    filter_ = line_cuckoo.CuckooFilter.of(keys)
    assert filter_.holds(keys).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64)
    assert filter_.holds(others).mean() < 0.01
    assert all(filter_.delete(int(k)) for k in keys[:1500])
    assert filter_.holds(keys[1500:]).all() and filter_.holds(keys[:1500]).mean() < 0.05
    full = line_cuckoo.CuckooFilter(16)
    before = None
    for k in keys.tolist():
        before = full.table.copy()
        if not full.insert(k):
            break
    assert (full.table == before).all()


def texts_of_two_languages(n=80):
    r = random.Random(5)
    a = lambda k: " ".join(r.choice(["the", "thing", "with", "that", "reading", "shed"]) for _ in range(k))
    b = lambda k: " ".join(r.choice(["und", "nicht", "schon", "zwölf", "auch", "über"]) for _ in range(k))
    rows = [(i, (a if i % 2 else b)(r.randrange(5, 60)), "en" if i % 2 else "de", "s") for i in range(n)]
    return rows, a, b


def test_languages(spark):
    rows, a, b = texts_of_two_languages()
    rows += [(1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "123 ... — $", "de", "s"), (1003, a(30) + " " + b(70), None, None), (1004, "Ü", None, None), (None, a(20), "en", "s"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langmix.held_out_languages(docs)
    found = [r.asDict() for r in got.collect()]
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for i, _, lang, _ in rows[:80]:
        assert by[i]["lang_pred"] == lang and by[i]["score"] > 0.9
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000]["score"] == 0
    assert by[1003]["languages"] == ["de", "en"] and abs(by[1003]["score"] - 0.7) < 0.1
    assert by[1004]["lang_pred"] in ("de", "en") and by[None]["lang_pred"] == "en"
    kept = langmix.keep_languages(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 3


def test_no_language_is_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langmix.held_out_languages(docs).collect()] == ["und"]
    assert langmix.held_out_languages(docs.limit(0)).count() == 0


def test_mixture_matches_plain_expectation_maximisation():
    """One document, against EM written out over its segments."""
    r = np.random.default_rng(3)
    logs = r.normal(size=(30, 3)) * 4
    share = np.full(3, 1 / 3)
    for _ in range(langmix.STEPS * 40):
        part = np.exp(logs) * share
        share = (part / part.sum(1, keepdims=True)).mean(0)
    chance = np.exp(logs - logs.max(1, keepdims=True))
    got, _ = langmix._em(chance, np.array([0]), np.array([30]), np.ones((1, 3)))
    assert np.abs(got[0] - share).max() < 0.02


def test_extra_columns_are_left_alone(spark):
    docs = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")])
    kept = jaccard_join.drop_similar(docs).select(*[F.col(c) for c in docs.columns]).collect()
    assert [tuple(r) for r in kept] == [tuple(docs.filter("doc_id = 1").first())]


@pytest.mark.parametrize("bound", [1, 5, 50])
def test_a_language_of_copies_is_learned(spark, bound):
    rows = [("der hund lief schnell durch den dunklen wald", "de")] * 400 + [(f"the cat number {i} sat on the mat", "en") for i in range(40)] + [("xy", "short"), ("  ", "blank"), (None, "none")]
    known = langmix.learn_languages(spark.createDataFrame(rows, "text string, lang string").repartition(4), max_docs=bound)
    assert "de" in known.names and "en" in known.names and "blank" not in known.names and "none" not in known.names
    assert np.ptp(known.logs[known.names.index("de")]) > 1


def test_repeated_items_are_one(spark):
    items = spark.createDataFrame([("i", "one two three four five six seven eight nine ten")] * 50, "item_id string, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y")], "doc_id long, text string")
    got = decontam.benchmark_hits(docs, items, block_bytes=60).collect()
    assert [(r["n_hit"], r["items"]) for r in got] == [(10, ["i"])]
