"""Token counts and packing against the tokenizer itself."""

import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from obol.llm.packing import TournamentTree, first_fit_decreasing, pack  # noqa: E402
from obol.llm.queries import tokenizer_path  # noqa: E402
from obol.llm.token_counts import count_tokens  # noqa: E402
from obol.llm.tokens import ChunkEncoder  # noqa: E402

TEXTS = [None, "", "   \n", "It's O'CLOCK 12,3 ...!? a.b", "<|endoftext|> <|STARTOFTEXT|> x<|startoftext|>y",
         "É́a é. ΣΑΣ K İ ǅ ªº 你好。 ﬁ x y  z \x1c", "́abc, don't, we'll!!! |||| 'sx", "a.\nb,\tc. d",
         "word " * 5000, "same text here", "same text here"]


def _docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, grp string, crcs int").repartition(3)


def test_chunk_encoder_equals_tokenizer():
    enc = ChunkEncoder(tokenizer_path())
    for t, code in zip(TEXTS, enc.encode([(t or "").encode() for t in TEXTS]), strict=True):
        assert np.frombuffer(code, "<u4").tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids


def test_small_cache_changes_no_id(monkeypatch):
    from obol.llm import tokens
    monkeypatch.setattr(tokens, "CACHE_BYTES", 2000)
    enc, plain = ChunkEncoder(tokenizer_path()), ChunkEncoder(tokenizer_path()).tok
    texts = [f"common word{i % 7} rare{i} item{i // 3}" for i in range(300)]
    for i in range(0, len(texts), 10):
        for t, code in zip(texts[i:i + 10], enc.encode([t.encode() for t in texts[i:i + 10]]), strict=True):
            assert np.frombuffer(code, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
        assert len(enc.cache) + len(enc.old) < 60


def test_token_counts_and_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    enc = ChunkEncoder(tokenizer_path())
    want = {(i, len((t or "").encode()), len(enc.tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)}
    for _ in range(2):
        got = count_tokens(_docs(spark), tokenizer_path(), path).collect()
        assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(TEXTS)
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    cache = spark.read.parquet(path)
    assert cache.count() == cache.select("content_digest").distinct().count()  # the second run encoded nothing
    assert count_tokens(_docs(spark, []), tokenizer_path()).count() == 0


def test_packing_covers_every_token_once(spark):
    enc = ChunkEncoder(tokenizer_path())
    rows = pack(_docs(spark), tokenizer_path(), group_docs=4).collect()
    for i, t in enumerate(TEXTS):
        ids = np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == list(range(0, len(ids), 2048))
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(_docs(spark, []), tokenizer_path()).count() == 0


def test_first_fit_decreasing_matches_a_scan():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(1, 100, rng.integers(1, 60))
        bins, offsets, used = first_fit_decreasing(sizes, 100)
        room, want = [], np.zeros(len(sizes), int)
        for i in np.argsort(-sizes, kind="stable"):
            k = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
            if k == len(room):
                room.append(100)
            assert offsets[i] == 100 - room[k]
            room[k] -= sizes[i]
            want[i] = k
        assert bins.tolist() == want.tolist() and used == len(room)
    assert TournamentTree(1, 10).place(4) == (0, 10)


def test_other_tasks_empty_the_word_cache():
    import pyarrow as pa

    from obol.llm.textbytes import slices
    from obol.llm.tokens import encoder
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None]})
    kept = encoder(tokenizer_path())
    assert [t for _, t in slices(iter([batch]), keep=True)] == [[b"a b", b""]] and encoder(tokenizer_path()) is kept
    assert [t for _, t in slices(iter([batch]))] == [[b"a b", b""]] and encoder.cache_info().currsize == 0
