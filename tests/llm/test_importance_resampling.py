"""Importance resampling against a per-document brute force, with runs of one to three words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from obol.llm.importance_resampling import LOWER, UPPER, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, target, n, buckets=10_000, min_words=20, percent=10):
    def features(text):
        w = WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in docs:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, w, f in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, w])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r) for r in out), key=repr)


def _rows(n=80):
    rng = random.Random(11)
    vocabulary = ["Alpha", "beta", "GAMMA", "delta", "Été", "naïve", "x1", "42", "zeta", "don't", "你好"]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))
    shared = [line() for _ in range(6)]
    rows = [(i, "\n".join(rng.choice([rng.choice(shared), line(), "", " . "]) for _ in range(rng.randint(0, 14)))) for i in range(n)]
    rows += [(200, None), (201, ""), (202, "\n\n \n"), (203, "one two\r\nthree"), (None, "beta " * 30), (5, rows[5][1]), (204, "word " * 60_000 + "\nend")]
    return rows, [line() + "\n" + line() for _ in range(9)] + [None]


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("hot", [0, 8])
def test_equals_brute_force(spark, n, hot):
    rows, target = _rows()
    df = spark.createDataFrame([(*r, 9, "y") for r in rows], "doc_id long, text string, rank long, line string").repartition(4)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in resample(df, aim, max_n=n, hot_lines=hot, rank_rows=30).collect()), key=repr)
    assert got == brute(rows, target, n)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aim = spark.createDataFrame([], "text string")
    assert resample(docs, aim).count() == 0
    rows, _ = _rows(8)
    got = sorted((tuple(r) for r in resample(spark.createDataFrame(rows, "doc_id long, text string"), aim).collect()), key=repr)
    assert got == brute(rows, [], 1)
