"""Exact substring dedup against brute force, the sorters against sorted()."""

import hashlib
import random

import numpy as np

import obol.llm.substring_dedup as S

rnd = random.Random(5)


def brute(rows):
    """doc rows (id, bytes) in order -> per row (n_bytes, removed, spans, sha)."""
    order = sorted(range(len(rows)), key=lambda i: ((rows[i][0] is not None, rows[i][0] or 0), hashlib.sha256(rows[i][1]).hexdigest()))
    seen, out = set(), [None] * len(rows)
    for i in order:
        t = rows[i][1]
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - 99):
            w = t[s:s + 100]
            if w in seen:
                gone[s:s + 100] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (rows[i][0], len(t), int(gone[: len(t)].sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    word = lambda n: "".join(rnd.choices("abcdeé ", k=n))
    passage, line = word(150), word(70)
    texts = [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 200, passage, passage, word(60) + passage + word(80)]
    for k in range(25):
        texts.append(word(rnd.randint(0, 300)) + rnd.choice([passage, line, line + line, passage[10:130], "x" * 120, ""]) + word(rnd.randint(0, 120)))
    base = word(900)
    for _ in range(10):
        t = list(base)
        for _ in range(4):
            t[rnd.randrange(len(t))] = "Z"
        texts.append("".join(t))
    rows = list(enumerate(texts))
    return rows + [(5, "y" * 130), (5, passage), (7, passage), (None, passage + "q"), (None, base)]


def test_remove_repeats_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, hash int, key int").repartition(5)
    got = sorted((tuple(r) for r in S.remove_repeats(df).collect()), key=repr)
    assert got == sorted(brute([(i, (t or "").encode()) for i, t in rows]), key=repr)


def test_hot_spans_match_the_sorted_path(spark):
    around = [("L" * 68 + "A" * 32 + "R" * 68).encode(), ("M" * 68 + "A" * 32 + "R" * 68).encode(), ("L" * 68 + "A" * 32 + "R" * 68).encode()]
    df = spark.createDataFrame([(i, "s", 100, 68, 68, bytearray(a)) for i, a in enumerate(around)],
                               "doc_id long, sha string, pos long, nl int, nr int, around binary")
    cover = {0: set(), 1: set(), 2: set()}
    for r in S.hot_spans(df).collect():
        cover[r.doc_id].update(range(r.lo, r.hi))
    # the second has the string from its anchor on, the third all of its surroundings
    assert cover == {0: set(), 1: set(range(100, 200)), 2: set(range(32, 200))}


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sorters():
    for _ in range(100):
        words = list({bytes(rnd.choices(b"ab", k=12)) for _ in range(rnd.randint(1, 60))})
        assert [words[i] for i in S.BlindTrie(words).order()] == sorted(words)
    for _ in range(30):
        n = rnd.randint(1, 80)
        g = np.array([rnd.randint(0, 3) for _ in range(n)])
        x = np.array([[rnd.choice(b"ab") if j > 55 else 97 for j in range(100)] for _ in range(n)], np.uint8)
        want = sorted(range(n), key=lambda i: (g[i], x[i].tobytes(), i))
        assert S.deep_shallow_order(g, x).tolist() == want
