"""Pipeline stages on rows without ids and on ids that repeat."""

from collections import Counter

import corpus_pipeline as p


def text(seed, n=80, other=0):
    return " ".join(f"w{seed}x{i}" for i in range(n - other)) + "".join(f" z{seed}y{i}" for i in range(other))


def frame(spark, rows):
    full = [(d, t, "en", s, len(t or "")) for d, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rows = [(None, text(1), "a"), (None, text(2), "a"),  # no id, copies of nothing
            (None, text(3), "a"), (None, text(3), "a"), (None, text(3, other=2), "a"),  # no ids, one group
            (7, text(4), "a"), (7, text(5), "a"),  # one id, two texts
            (7, text(6), "a"), (9, text(6, other=2), "a"), (None, text(6), "a"),  # a group with and without ids
            (12, text(8), "a"), (12, text(8), "b"), (3, None, "a"), (4, "", "a")]
    out = [(r.doc_id, r.text) for r in p.near_dedup(spark, frame(spark, rows), "").collect()]
    group = [t for t in out if t[1] in (text(3), text(3, other=2))]
    assert len(group) == 1 and group[0][0] is None
    want = [(None, text(1)), (None, text(2)), (7, text(4)), (7, text(5)), (7, text(6)), (12, text(8)), (3, None), (4, "")]
    assert Counter(x for x in out if x not in group) == Counter(want)


def test_mix_takes_rows_without_ids_and_repeated_ids_as_they_are(spark):
    rows = [(i % 40 if i % 3 else None, text(i, 12 + i % 60), "abc"[i % 3]) for i in range(240)]
    docs = frame(spark, rows)
    got = Counter(r.text for r in p.mix_sources(spark, docs, "").collect())
    want = Counter()
    for r in p.mix(p.row_key(docs).withColumn("doc_id", p.F.xxhash64("_row", p.F.col("source").isNull(), "source"))).collect():
        want[r.doc_id] += r.copies
    assert sorted(got.values()) == sorted(n for n in want.values() if n) and max(got.values()) <= 3
    ids = {t: d for d, t, _ in rows}
    assert any(ids[t] is None for t in got)
