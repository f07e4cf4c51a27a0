"""Kneser-Ney models against a dictionary version, held-out accuracy, rejection and edge rows."""

import math
import random
from collections import Counter

import numpy as np

from obol.llm import language_id as li

WORDS = {"xa": ["bano", "riko", "tamu", "sola", "ke", "miru"], "xb": ["thrun", "skelf", "ord", "wick", "blen", "gar"],
         "xc": ["éaux", "tion", "qui", "lême", "çou", "re"]}


def _text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n)) + rng.choice([".", "!", " 12,\n3"])


def _docs(n=120, seed=5):
    rng = random.Random(seed)
    return [(i, _text(rng, l, rng.randint(3, 40)), l) for i, l in ((i, rng.choice(list(WORDS))) for i in range(n))]


def reference(texts):
    """Probability function of one language, from the definition with dictionaries."""
    top = Counter()
    for t in texts:
        s = "   " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " "
        for i in range(3, len(s)):
            top[s[i - 3:i + 1]] += 1
    counts = {4: dict(top)}
    for n in (3, 2, 1):
        longer = {g[-(n + 1):] for g in top}
        counts[n] = dict(Counter(g[1:] for g in longer))
    return counts


def dictionary_model(counts, n_chars):
    def prob(history, c, n):
        table = counts[n]
        one, two = (sum(v == k for v in table.values()) for k in (1, 2))
        d = min(max(one / (one + 2 * two) if one + 2 * two else 0.5, li.DISCOUNT_FLOOR), 0.95)
        ctx = history[len(history) - (n - 1):]
        own = {g: v for g, v in table.items() if g[:-1] == ctx}
        mass = sum(own.values())
        lower = 1 / (n_chars + 1) if n == 1 else prob(history, c, n - 1)
        if not mass:
            return lower
        return max(own.get(ctx + c, 0) - d, 0) / mass * (ctx + c in own) + d * len(own) / mass * lower
    return prob


def test_model_equals_dictionary_version():
    rows = _docs(30)
    langs = sorted(WORDS)
    lang, grams, n = [], [], []
    for i, l in enumerate(langs):
        counts = reference([t for _, t, x in rows if x == l])[4]
        for g, k in sorted(counts.items()):
            lang.append(i), grams.append([ord(c) for c in g]), n.append(k)
    model = li.kneser_ney(langs, np.array(lang), np.array(grams, np.uint32), np.array(n, float))
    alphabet = {g[-1] for l in langs for g in reference([t for _, t, x in rows if x == l])[4]}
    for text in ("bano riko", "skelf, ord tamu!", "Zzq éaux"):
        cost, letters = model.costs([text.encode()])
        assert letters[0] == sum(c.isalpha() for c in text)
        s = "   " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
        for i, l in enumerate(langs):
            prob = dictionary_model(reference([t for _, t, x in rows if x == l]), len(alphabet))
            bits = -sum(math.log2(prob(s[:j], s[j], 4)) for j in range(3, len(s))) / (len(s) - 3)
            assert abs(bits - cost[0, i]) < 1e-4, (text, l)
    # the probabilities of all characters and of one unknown after any history add up to one
    prob = dictionary_model(reference([t for _, t, x in rows if x == "xa"]), len(alphabet))
    assert abs(sum(prob("  b", c, 4) for c in alphabet | {"一"}) - 1) < 1e-9


def test_letters_of_batches():
    texts = ["", "Hello,  Wörld!! 12", "...", " 你a ", "x", "a  b", "É\U0001F600é"]
    code, first = li.letters([t.encode() for t in texts])
    got = ["".join(map(chr, code[first[i]:first[i + 1]])) for i in range(len(texts))]
    want = ["   " + "".join(w + " " for w in ["".join(c.lower() if c.isalpha() else " " for c in t)][0].split()) for t in texts]
    assert [g.rstrip() for g in got] == [w.rstrip() for w in want]
    assert all(g.startswith("   ") and g.endswith(" ") and "  " not in g.strip() for g in got)


def test_held_out_accuracy_and_rejection(spark):
    rows = _docs(1200)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)
    got = {r.doc_id: r for r in li.identify(df).collect()}
    held = [(i, l) for i, _, l in rows if got[i].held_out]
    assert len(held) > 200 and sum(got[i].lang_pred == l for i, l in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.accepted for r in got.values()) / len(rows) > 0.95
    foreign = spark.createDataFrame([(0, "zzqxv jjwq xxzvk qqpw zxq"), (1, _text(random.Random(1), "xa", 30))], "doc_id long, text string")
    out = {r.doc_id: r for r in li.predict(foreign, li.fit(df)).collect()}
    assert not out[0].accepted and out[1].accepted and out[1].lang_pred == "xa" and out[0].bits_per_char > out[1].bits_per_char


def test_edge_rows_and_sample_bound(spark):
    rng = random.Random(3)
    rows = _docs(60) + [(100, None, "xa"), (101, "", "xa"), (102, "12 34 !!", "xb"), (103, _text(rng, "xa", 20), None), (None, _text(rng, "xb", 20), "xb"),
                        (104, _text(rng, "xc", 100_000), "xc"), (105, "bano", "xa"), (105, "bano", "xa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = li.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (100, 101, 102):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].bits_per_char is None and not by[i].accepted
    assert by[103].lang_pred == "xa" and by[None].lang_pred == "xb" and not by[None].held_out and by[104].lang_pred == "xc"
    same = [r for r in got if r.doc_id == 105]
    assert len(same) == 2 and same[0] == same[1]
    small = li.fit(df.where("doc_id < 60"), sample_chars=3000, calibration_chars=600)
    assert len(small.grams[-1]) < len(li.fit(df.where("doc_id < 60")).grams[-1]) and small.langs == sorted(WORDS)


def test_empty_one_language_and_nothing_learned(spark):
    schema = "doc_id long, text string, lang string"
    assert li.identify(spark.createDataFrame([], schema)).count() == 0
    no_lang = li.identify(spark.createDataFrame([(1, "abc", None)], schema)).first()
    assert no_lang.lang_pred == "und" and no_lang.score == 0
    one = li.identify(spark.createDataFrame([(i, "bano riko tamu", "xa") for i in range(8)], schema)).collect()
    assert all(r.lang_pred == "xa" and r.score == 1 for r in one)

