"""Near-duplicate components against all pairs."""

import random
import re

from obol.llm.near_dedup import may_be_alike, near_duplicates

rnd = random.Random(8)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same_id or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus():
    vocab = [f"w{i}" for i in range(400)]
    word = lambda n: [rnd.choice(vocab) for _ in range(n)]
    texts = [None, "", " \n ", "One", "one", "a b c", "A  b\nC", "a b d"]
    passage = word(60)
    for _ in range(12):
        base = word(rnd.choice([12, 40, 120, 300]))
        for _ in range(rnd.randint(1, 9)):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 40))):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            texts.append(" ".join(t))
        texts.append(" ".join(word(40) + passage + word(60)))
    chain = word(200)
    for k in range(14):  # neighbours are alike, the ends are not
        texts.append(" ".join(chain[5 * k:5 * k + 130]))
    rnd.shuffle(texts)
    return list(enumerate(texts)) + [(3, "x y z u v w"), (3, "x y z u v w"), (4, " ".join(chain[:130]))]


def test_components_match_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, cid int, value int").repartition(4)
    out = near_duplicates(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "p q r"), (None, "p q r")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out) == [("1", "1"), ("None", "1"), ("None", "None"), ("None", "None")]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_of_the_first_common_value_never_rule_out_an_alike_pair(spark):
    rows = []
    for _ in range(400):
        base = rnd.sample(range(60), rnd.randint(4, 30))
        a, b = (sorted({*base[rnd.randint(0, 4):], *rnd.sample(range(60), rnd.randint(0, 4))}) for _ in range(2))
        common = sorted({*a} & {*b})
        if common:
            alike = 100 * len(common) >= 75 * len({*a} | {*b})
            rows.append((len(a), a.index(common[0]) + 1, len(b), b.index(common[0]) + 1, alike))
    df = spark.createDataFrame(rows, "na long, pa long, nb long, pb long, alike boolean")
    out = df.withColumn("passes", may_be_alike(*(df[c] for c in ("na", "pa", "nb", "pb")))).collect()
    assert any(r.alike for r in out) and any(not r.passes for r in out)
    assert all(r.passes for r in out if r.alike)


def test_sets_are_shuffled_once_by_the_join(spark, monkeypatch):
    from obol.llm import near_dedup
    plans, staged = {}, near_dedup.staged

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(near_dedup, "staged", noted)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = " ".join(f"w{i}" for i in range(40))
        rows = [(1, text), (1, text), (2, text + " more"), (3, "other words"), (None, text)]
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r.doc_id or 9, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 3), (9, 1)]
    for name in ("sketches", "members"):
        assert "SortMergeJoin" in plans[name] and "Exchange" not in plans[name].split("SortMergeJoin")[0]
