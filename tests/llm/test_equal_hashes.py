"""Words that collide under polynomials modulo a power of two, and pieces whose hashes are made equal."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from panelweave.llm import token_planes, wordhash
from panelweave.llm.decontam import benchmark_hits
from panelweave.llm.jaccard_join import similar_texts
from panelweave.llm.queries import tokenizer_path
from panelweave.llm.wordhash import span_hashes


def thue_morse(k: int) -> tuple[str, str]:
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("k", [10, 11, 12])
def test_thue_morse_words_differ(spark, k):
    a, b = thue_morse(k)
    raw = np.frombuffer((a + b + a).encode(), dtype=np.uint8)
    n = len(a)
    x, y, z = span_hashes(raw, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert x != y and x == z
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string").coalesce(1)
    assert {(r["doc_id"], r["component_id"]) for r in similar_texts(docs).collect()} == {(1, 1), (2, 2), (3, 1)}
    items = spark.createDataFrame([("i", a)], "item_id string, text string")
    assert {(r["doc_id"], r["n_hit"]) for r in benchmark_hits(docs, items, window=10).collect()} == {(1, 1), (2, 0), (3, 1)}
    path = tokenizer_path("byte_bpe_50k.json")
    want = {}
    for i, text in ((1, a), (2, b), (3, a)):
        ids = token_planes.Encoder(path).whole([text])[0] + [2]
        want[i] = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    got = token_planes.tokens_round_trip(docs, path, end_id=2).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == want


def test_pieces_with_equal_hashes_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(token_planes, "span_hashes", lambda raw, starts, ends: np.full(len(starts), 7, dtype=np.uint64))
    encoder = token_planes.Encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["one two six ten", "ten six two one", "a longer text, with 12 pieces\n\n here", "one"]
    for _ in range(2):
        raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        ids, n = encoder.encode(raw, np.r_[0, np.cumsum([len(t) for t in texts])])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == encoder.whole(texts)


def test_hashes_do_not_depend_on_runs(monkeypatch):
    rng = np.random.default_rng(9)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    cut = np.unique(rng.integers(0, 5000, 600))
    whole = span_hashes(raw, cut[:-1], cut[1:])
    assert len(set(whole.tolist())) == len({raw[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)})
    for run in (1, 17, 900):
        monkeypatch.setattr(wordhash, "_RUN", run)
        assert (span_hashes(raw, cut[:-1], cut[1:]) == whole).all()
    assert max(len(t) for p in wordhash._POWERS for t in p.tables) <= 1 << 19
