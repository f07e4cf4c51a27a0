"""Conversation repair against a least-cost search over output strings, state by state."""

import hashlib
import heapq
import random
import re
import zlib

from obol.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        role, text = s(role), s(text)
        d = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        if d == 0:
            continue
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if d == 3 else 1)
    return out


def search(turns):
    """Cheapest (cost, audit, output) by Dijkstra over (turns read, initials written so far modulo their cycle)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        if i == len(turns) and last in ("", "a"):
            return cost, audit, out
        done.add((i, last))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for role in ("user", "assistant"):
            if role[0] in follows:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*out, (role, ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if fault in (None, "truncated"):
                extra = fault == "truncated"
                if role[:1] and role[0] in follows:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], (*out, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in follows:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, new[0], (*out, (new, text))))
    raise AssertionError


def expected(rows):
    convs = {r[0]: [] for r in rows}
    for conv, *rest in damage(rows):
        convs[conv].append(rest)
    out = set()
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            end = text.rstrip(SPACE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                n[fault] += 1
        at = [t for t, *_ in turns if t is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, new = search(marked) if marked else (0, "", ())
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
        out.add((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha))
    return out


COLUMNS = "conv_id long, turn long, role string, text string, audit int"


def _random_rows(seed, n_conv, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "What?", "So it is. ", "Hm!\t", None, "é。"]
    roles = ["user", "assistant", "system", "tool", "", None, "admin", "User"]
    rows = []
    for c in range(n_conv):
        conv = None if c == 3 else c
        for t in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 1, 5])
            role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"turn {rng.randint(0, 30)}."))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], COLUMNS).repartition(3)


def test_repair_equals_search(spark):
    rows = _random_rows(1, 60, 9)
    got = [tuple(r) for r in cr.damaged_and_repaired(_frame(spark, rows)).collect()]
    assert len(got) == len({r[0] for r in rows}) and set(got) == expected(rows)


def test_long_conversations_in_spans(spark, monkeypatch):
    rows = _random_rows(2, 6, 150)
    assert {tuple(r) for r in _with(spark, rows, 4, 2)} == {tuple(r) for r in _with(spark, rows, 16, 16)}
    got = {tuple(r) for r in cr.damaged_and_repaired(_frame(spark, rows)).collect()}
    assert got == expected(rows)


def _with(spark, rows, span, fan):
    return cr.repair(_frame(spark, rows), span, fan)[0].drop("_c").collect()


def test_repaired_turns_follow_the_pattern(spark):
    rows = _random_rows(3, 20, 12)
    _, kept = cr.repair(_frame(spark, rows))
    by = {}
    for r in kept.orderBy("_c", "pos").collect():
        by.setdefault(r["_c"], []).append(r)
    for turns in by.values():
        assert [t.pos for t in turns] == list(range(1, len(turns) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))
        assert all(t.text == "" and t.role in ("user", "assistant") for t in turns if t.edit == "I")


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert cr.damaged_and_repaired(empty).count() == 0


def test_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "." + " " * 1_000_000), (1, 1, "assistant", "y.")]
    got = {tuple(r) for r in cr.damaged_and_repaired(_frame(spark, rows)).collect()}
    assert got == expected(rows)
