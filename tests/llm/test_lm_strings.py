"""LM scoring: exact slots of every context, whatever their number, and scores that follow from them."""

import zlib
from collections import Counter

import numpy as np

from obol.llm import lm_scoring as L


def want_codes(counts, gram):
    """Codes of all orders and steps of one string by brute force over the counted strings."""
    out = []
    for k in range(1, L.ORDERS + 1):
        mask = (1 << 8 * (k + 1)) - 1
        for step in range(8):
            n = [0, 0]
            for g, c in counts.items():
                if (g & mask) >> (8 - step) == (gram & mask) >> (8 - step):
                    n[g >> (7 - step) & 1] += c
            out.append(int(L.quantised(n[0]) * L.LEVELS + L.quantised(n[1])))
    return out


def test_codes_are_those_of_the_exact_contexts(spark):
    rng = np.random.default_rng(3)
    counts = {int(L.codes([bytes(rng.choice(list(b"abc \xc3"), 6))])[0][i]): int(rng.integers(0, 60)) for _ in range(60) for i in range(7)}
    df = spark.createDataFrame(list(counts.items()), "gram long, n long").repartition(3)
    got = {r.gram: (r.n, np.frombuffer(bytes(r.codes), "<u2").tolist()) for r in L.coded_strings(df).collect()}
    assert got == {g: (n, want_codes(counts, g)) for g, n in counts.items()}


def test_strings_are_counted_once_and_scores_add_up(spark, monkeypatch):
    models, learn, tables, coded = [], L._learn, [], L.coded_strings
    monkeypatch.setattr(L, "_learn", lambda c, m: models.append(learn(c, m)) or models[-1])
    monkeypatch.setattr(L, "coded_strings", lambda s: tables.append(coded(s)) or tables[-1])
    texts = [f"word{i % 17} and w{i * i % 29} é {'x' * (i % 5)}" for i in range(120)] + [None, "", "only here zq"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    out = {r.doc_id: r for r in L.score(df).collect()}
    streams = [L.byte_stream((t or "").lower().encode().split()) for t in texts]
    counts = Counter()
    for i, s in enumerate(streams):
        counts.update({int(g): 0 if out[i].held_out else n for g, n in Counter(L.codes([s])[0].tolist()).items()})
    rows = tables[0].collect()
    assert {r.gram: r.n for r in rows} == counts and len(rows) == len(counts)
    grams = np.array([r.gram for r in rows], np.uint64)
    log = dict(zip(grams.tolist(), models[0].log10(grams, [bytes(r.codes) for r in rows]).tolist(), strict=True))
    for i, s in enumerate(streams):
        assert abs(out[i].score - sum(log[int(g)] for g in L.codes([s])[0])) < 1e-9


def test_staged_rows_and_codes_are_packed_tightly(spark, monkeypatch):
    made = {}
    staged = L.staged
    monkeypatch.setattr(L, "staged", lambda df, name, *a: made.update({name: staged(df, name, *a)}) or made[name])
    L.score(spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")).collect()
    for name in ("lm-rows", "coded"):
        assert all(f.endswith(".zstd.parquet") for f in made[name].inputFiles())


def test_byte_planes_give_the_values_back_and_compress():
    grams = np.sort(np.random.default_rng(5).integers(0, 1 << 48, 5000, np.uint64))
    logs = -np.random.default_rng(6).random(5000)
    for values, kind in ((grams, "<u8"), (logs, "<f8"), (grams[:0], "<u8")):
        assert L.from_planes(L.planes(values), kind).tolist() == values.tolist()
    assert len(zlib.compress(L.planes(grams), 1)) < 0.9 * len(zlib.compress(grams.tobytes(), 1))
