"""Merkle manifests, SimHash links and token alignment against plain Python over whole small tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelweave.llm import merkle, simhash, token_align
from panelweave.llm.queries import tokenizer_path

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain_merkle(rows: list[tuple], every: int = 3) -> list[tuple]:
    """The audit by lists of whole levels."""

    def leaf(values) -> str:
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(digests: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
        paths: list[list[tuple[str, str]]] = [[] for _ in digests]
        at, level = list(range(len(digests))), digests
        while len(level) > 1:
            for i, p in enumerate(at):
                run = p - p % 8
                paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 8])))
                at[i] = p // 8
            level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        return level[0], paths

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = []
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % every == 0 and r[4] is not None
        made.append((b"" if r[2] is None else b"=" + r[2].encode(), (r[0] is not None, r[0] or 0), leaf(r), leaf((*r[:4], r[4].translate(low))) if hit else leaf(r), r[0]))
    made.sort()
    keys = sorted({m[0] for m in made})
    trees = {k: climb([m[2] for m in made if m[0] == k]) for k in keys}
    root, crown = climb([trees[k][0] for k in keys])
    out = []
    for k, above in zip(keys, crown, strict=True):
        for m, path in zip([m for m in made if m[0] == k], trees[k][1], strict=True):
            acc = m[3]
            for left, right in path + above:
                acc = sha(left + acc + right)
            out.append((m[4], m[2], trees[k][0], root, sha("".join(x + y for x, y in path + above)), acc, acc == root))
    return out


def some_docs(n: int) -> list[tuple]:
    rows = []
    for i in range(n):
        lang = [None, "", "de", "en", "fr", "zh"][0 if i == 3 else 1 if i in (5, 9) else 5 if i < 12 else 3]
        rows.append((i * 7 % n, ["web", None][i % 9 == 0], lang, [i, None][i % 11 == 0], [f"Text {i} ÄÖ", None, "", "ABC é", "PLAIN"][i % 5]))
    return rows


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_manifest_equals_lists_of_levels(spark, n):
    rows = some_docs(n)
    if n > 8:
        rows += [rows[8], rows[8], (None, None, None, None, None), (None, "x", "en", 1, "Lone"), (rows[7][0], "other", rows[7][2], 5, "Same id")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit(1)).withColumn("KEY_", F.lit("x")).repartition(5)
    got = sorted(map(tuple, merkle.tampered_audit(docs).collect()), key=str)
    assert got == sorted(plain_merkle(rows), key=str)


def test_manifest_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert merkle.tampered_audit(docs).collect() == []
    assert merkle.manifest(docs, "lang", ["doc_id"], ["text"]).root.collect() == []


def test_manifest_keeps_every_third_level_only(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    made = merkle.manifest(docs, "lang", ["doc_id"], ["doc_id"])
    assert [level.select(F.sum(F.size("items"))).first()[0] for level in made.trees.levels] == [5000, 10]
    assert max(level.select(F.max(F.size("items"))).first()[0] for level in made.trees.levels) <= merkle.SPAN
    one = made.proofs().select(F.size("path").alias("n"), (merkle.fold(F.col("digest"), F.col("path")) == F.col("root")).alias("ok")).distinct().collect()
    assert [tuple(r) for r in one] == [(5, True)]


def test_manifest_sql_agrees(spark):
    rows = some_docs(90)
    docs = spark.createDataFrame(rows, DOCS)
    documents = docs.toPandas()  # noqa: F841 (read by DuckDB)
    documents["n_chars"] = documents["n_chars"].astype("Int64")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = duckdb.sql(merkle.audit_sql()).df()[names].itertuples(index=False, name=None)
    assert sorted(want) == sorted(tuple(r) for r in merkle.tampered_audit(docs).select(names).collect())


def plain_print(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(words: list[int], ids: list, distance: int = 3) -> list:
    root = list(range(len(words)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(words)):
        for j in range(i):
            if (words[i] ^ words[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least: dict = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(words))]


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_fingerprint_of_texts(monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    texts = [None, "", " \n\x0b", "One", "one  TWO", "a b c", "A\tb\nc  d ÄÖ ß x " * 5, "x" * 50, "same " * 40, "end of it  \n ", "b c   ", "w1 w2 w3 w4"]
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == [plain_print(t) for t in texts]


def test_spark_hashes_agree(spark):
    assert spark.sql("select xxhash64('one two three') h").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("parts", [None, 2, 3, 4])
def test_links_of_words_equal_all_pairs(spark, parts):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    words = {int(centre[rng.integers(12)]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(200)}
    words |= {0, 1, 7, 15, (1 << 64) - 1, (1 << 64) - 8}
    signed = [(int(np.uint64(w).view(np.int64)),) for w in words]
    got = {frozenset(x % (1 << 64) for x in r) for r in simhash.linked_words(spark.createDataFrame(signed, "fp long"), 3, parts).collect()}
    assert got == {frozenset((x, y)) for x in words for y in words if x < y and (x ^ y).bit_count() <= 3}


def test_thresholds_are_the_cheapest_and_sum_up():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    words[:200] &= np.uint64(0xFFFFFFFFFFFF0000)
    plan = simhash.Plan(simhash.group_bits(np.eye(64, dtype=np.int64) * 100, 300, 4), 3)
    words = plan.permute(words)
    assert (plan.permute(plan.restore(words)) == words).all()
    plan.learn([np.bincount(plan.value(words, p).astype(np.int64), minlength=1 << 16) for p in range(4)])
    t, cost = plan.thresholds(words)
    assert (t.sum(axis=1) == 0).all() and t.min() >= -1 and len(np.unique(t, axis=0)) > 1
    every = [row for row in simhash.allocations(4, 3) if row.max() <= max(plan.most)]
    for i in range(0, 300, 17):
        each = [sum(plan.costs[p][x + 1, int(plan.value(words[i : i + 1], p)[0])] for p, x in enumerate(row)) for row in every]
        assert cost[i] == pytest.approx(min(each))


def test_near_duplicates_of_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY_SHARE", 0.2)
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base + " more", base.upper(), base + " tail end", None, "", "  ", "short", "SHORT", "two words", *["copy of one text"] * 12, "long " * 3000]
    ids = [*range(10, 10 + len(texts) - 2), None, 10]
    docs = spark.createDataFrame(list(zip(ids, texts, range(len(ids)), strict=True)), "doc_id long, text string, fp long").repartition(3)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    words = [plain_print(t) for t in texts]
    want = zip(ids, [f"{w:016x}" for w in words], plain_components(words, ids), strict=True)
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(docs.filter("false")).collect() == []


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    """Token by token, pair by pair."""
    a, b = (token_align.load(tokenizer_path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    rows = []
    for text in texts:
        ids_a = a.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.model.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(a.bytes[i] for i in ids_a) != want or b"".join(b.bytes[i] for i in ids_b) != want:
            rows.append(([], [], [], ""))
            continue
        spans = []
        for ids, side in ((ids_a, a), (ids_b, b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(side.bytes[i]), i))
                at = own[-1][1]
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in own if last <= s and e <= cut) for own in spans))
            last = cut
        pairs = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e]
        rows.append((ids_a, ids_b, pairs, ";".join(groups)))
    docs = Counter(p for r in rows for p in set(r[2]))
    top: dict = {}
    for (i, _), n in docs.items():
        top[i] = max(top.get(i, 0), n)
    return [
        (len(x), len(y), g.count(";") + 1 if g else 0, len(p), sha(g) if g else "", sum(docs[q] == top[q[0]] for q in p), sum(docs[q] for q in p)) for x, y, p, g in rows
    ]


TEXTS = [
    None, "", " ", "a", "Hello world", "Hello   world\n\n\tx", "naïve café ☃ 日本語 👩‍👩‍👧", "<|endoftext|> and <s> </s> <unk>", "a▁b stays out", "x\x00y",
    "unbelievable tokenizations", "Hello world", "  leading and trailing  ", "1234567890 3.14159", "word " * 700, "é" * 300, "don't we'll", "Ünï",
]


@pytest.mark.parametrize("limit", [token_align.TABLE_BYTES, 0])
def test_alignment_token_by_token(spark, monkeypatch, limit):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, row int").repartition(3)
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    got = token_align.alignment_report(docs, *paths, table_bytes=limit).orderBy("doc_id")
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert [tuple(r) for r in got.select(names).collect()] == plain_alignment(TEXTS)
    assert plain_alignment(["a▁b stays out"]) == [(0, 0, 0, 0, "", 0, 0)]


def test_ids_by_unit_are_those_of_whole_texts():
    rng = np.random.default_rng(3)
    alphabet = [" ", " ", "a", "the", "'s", "9", ".", "\n", "\t", "é", "\u00a0", "\u3000", "日本", "☃", "▁", "<s>", "Word", "ing", "\x1c", "\x85", "<0x41>", "''", "~", "\x7f"]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 14))) for _ in range(4000)]
    spaced = [" " + t for t in texts]
    raw = np.frombuffer("".join(spaced).encode(), dtype=np.uint8)
    off = np.r_[0, np.cumsum([len(t.encode()) for t in spaced])]
    a, b = (token_align.load(tokenizer_path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    assert a.by_unit and b.by_unit
    whole = [x.ids for x in a.tokenizer.encode_batch(spaced, add_special_tokens=False)], b.model.encode(texts)
    for (ids, doc), want in zip(token_align._encoded((a, b), spaced, raw, off), whole, strict=True):
        assert [x.tolist() for x in np.split(ids, np.searchsorted(doc, np.arange(1, len(texts))))] == want


def test_alignment_in_slices_of_any_size(spark):
    docs = spark.createDataFrame([(1, "Some text to cut", 0), (1, "Some text to cut", 0), (None, "other", 0), (2, None, 1)], "doc_id long, text string, n_a int")
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    rows = token_align.alignment_report(docs, *paths).collect()
    assert sorted((str(r["doc_id"]), r["n_a"] > 0) for r in rows) == [("1", True), ("1", True), ("2", False), ("None", True)]
    assert token_align.alignment_report(docs.filter("false"), *paths).collect() == []


def test_alignment_of_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    rows = docs.filter("length(text) < 3000").select("doc_id", "text").orderBy("doc_id")
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = token_align.alignment_report(rows, *paths).orderBy("doc_id").select(names).collect()
    assert [tuple(r) for r in got] == plain_alignment([r["text"] for r in rows.collect()])
