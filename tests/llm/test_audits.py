"""Exact top-k, conversation repair and the filter audit against brute force, on small and on messy tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazlens.llm import conversations, exact_dedup, filter_audit, topk

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, class string, cell string, n long"


# ---- exact top-k -----------------------------------------------------------------------


def top_by_hand(rows, k, is_query):
    own = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x) if math.isfinite(256 * x) else int(math.copysign(1 << 63, x)))) for x in v]
        own[i] = min(own.get(i, ints), ints)
    out = []
    for q, v in own.items():
        if is_query(q):
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in own.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "d", 3) for i, v in rows], VECTORS)


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "copies"])
def test_top_k_against_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "clustered":
        x = np.repeat(rng.normal(size=(12, 8)) * 5, 50, 0) + rng.normal(size=(600, 8)) * 0.05
    else:
        x = rng.normal(size=(600, 8))
    if kind == "copies":
        x[:250] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = topk.top_k(vectors_of(spark, rows), topk.F.col("vec_id") % 7 == 0, 5, pivots=16, block=(64, 16))
    assert found(got) == top_by_hand(rows, 5, lambda q: q % 7 == 0)


def test_clusters_need_only_their_own(spark):
    """What a cell of queries needs is a small part of well-separated data, and groups keep apart."""
    rng = np.random.default_rng(6)
    centres = np.eye(8) * 50
    x = np.repeat(centres, 100, 0) + rng.normal(size=(800, 8))
    cells = topk.Cells(centres, float(np.sqrt((x**2).sum(1).max())))
    cell, far = cells.nearest(x, False)
    asked, reached = cells.nearest(x[::10], True)
    sizes = np.bincount(cell, minlength=8)
    near = [np.sort(far[cell == j])[:6] for j in range(8)]
    reach = np.array([reached[asked == j].max() for j in range(8)])
    low, high, bounds = topk.necessary(cells.gaps(), sizes, near, np.bincount(asked, minlength=8), reach, 6, 1e-6)
    for i in range(8):
        for q in x[::10][asked == i]:
            gap = np.sqrt(((cells.lifted(q[None], True) - cells.lifted(x)) ** 2).sum(1))
            best = np.argsort(gap)[:6]
            assert np.sort(gap)[5] <= bounds[i]
            assert all(low[i, cell[b]] <= far[b] <= high[i, cell[b]] for b in best)


def test_top_k_of_a_messy_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [1.0, 2.0]), (14, [0.0, 0.0]), (21, []), (28, [1.0]), (35, [3.0]), (1, [2.0]), (2, []), (3, None), (None, [1.0, 2.0]), (4, [1.0, nan]), (5, [inf, 0.0]), (6, [None, 1.0])]
    rows += [(7, [0.5, 9.0]), (8, [-1.0, -2.0]), (9, [1e300, 1.0]), (10, [-1e300, 0.001]), (11, [1e15, 1e15]), (42, [-1e16, 3e15])]
    got = topk.top_k(vectors_of(spark, rows), topk.F.col("vec_id") % 7 == 0, 3)
    assert found(got) == top_by_hand(rows, 3, lambda q: q % 7 == 0)
    assert found(topk.top_k(vectors_of(spark, rows).limit(0), topk.F.col("vec_id") % 7 == 0, 3)) == []
    # a single row has no candidates
    assert found(topk.top_k(vectors_of(spark, [(0, [1.0])]), topk.F.col("vec_id") % 7 == 0, 3)) == []


# ---- conversations -----------------------------------------------------------------------


def cheapest_by_hand(initials, marks):
    """All edits of a conversation, from cheap to dear, until some give the pattern: the least letters of the least cost."""
    for cost in range(3 * len(initials) + 3):
        done = [s for c, i, out, s in _reach(initials, marks, cost) if c == cost and i == len(initials) and re.fullmatch("(s?(ua)+)?", out)]
        if done:
            return cost, min(done)
    raise AssertionError("deleting every row is always possible")


def _reach(initials, marks, limit):
    """Every way of at most ``limit``: cost, rows consumed, initials that came out, letters."""
    seen, todo = set(), [(0, 0, "", "")]
    while todo:
        node = todo.pop()
        cost, i, out, letters = node
        if cost > limit or node in seen or not re.fullmatch("s?(ua)*u?", out):
            continue
        seen.add(node)
        todo += [(cost + 2, i, out + x, letters + "I") for x in "ua"]
        if i < len(initials):
            todo.append((cost + 3, i + 1, out, letters + "D"))
            if marks[i] not in "bd":
                more = marks[i] == "t"
                todo.append((cost + more, i + 1, out + initials[i], letters + "K"))
                todo += [(cost + 2 + more, i + 1, out + x, letters + "R") for x in "ua"]
    return seen


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("kktbd")), max_size=4))
def test_cheapest_edits_against_all_edits(rows):
    initials, marks = "".join(i for i, _ in rows), "".join(f for _, f in rows)
    assert conversations.repaired(initials, marks) == cheapest_by_hand(initials, marks)


def audited_by_hand(rows):
    """The whole operator by plain loops over (conv_id, turn, role, text)."""
    shown = lambda x: " " if x is None else str(x)
    held = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks, seen = [], set()
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            marks.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "k")
            seen.add((role, text))
        initials = "".join(r[1][:1] if r[1][:1] in ("s", "u", "a") else "x" for r in own)
        # least (cost, letters) of each state, over rows; insertions until nothing falls
        def inserted(best):
            for _ in range(4):
                for s, t in enumerate((2, 2, 3, 2)):
                    if best[s]:
                        best[t] = min(filter(None, [best[t], (best[s][0] + 2, best[s][1] + "I")]))
            return best

        best = inserted([(0, ""), None, None, None])
        for x, f in zip(initials, marks):
            new = [b and (b[0] + 3, b[1] + "D") for b in best]
            if f not in "bd":
                for s, b in enumerate(best):
                    if b:
                        waits = (2, 2, 3, 2)[s]
                        for letter, t, c in [("R", waits, 2)] + [("K", t, 0) for t in ([1] if x == "s" and s == 0 else [waits] if x == " ua "[waits - 1 : waits] and x in "ua" else [])]:
                            new[t] = min(filter(None, [new[t], (b[0] + c + (f == "t"), b[1] + letter)]))
            best = inserted(new)
        cost, letters = min(filter(None, [best[0], best[3]]))
        came, row, done = len(letters) - letters.count("D"), 0, []
        for letter in letters:
            if letter != "D":
                wanted = ["user", "assistant"][(len(done) + came % 2) % 2]
                done.append(f"{own[row][1] if letter == 'K' else wanted}:{own[row][2] if letter != 'I' else ''}")
            row += letter != "I"
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, marks.count("b"), marks.count("d"), marks.count("t"), pairs, cost, letters, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, part int")


def random_talk(conv, n, rng):
    turns = sorted(rng.choices(range(n), k=n))
    return [(conv, None if rng.random() < 0.03 else t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "no", "Why?", " ", "", None, f"text {rng.randrange(n)}.", f"é\U0001f600 {rng.randrange(n)}!\n", ". "])) for t in turns]


def test_conversations_against_plain_loops(spark):
    rng = random.Random(3)
    rows = [r for conv in range(60) for r in random_talk(conv, rng.randrange(1, 12), rng)] + random_talk(None, 9, rng) + random_talk(77, 300, rng)
    rows += [(88, 5, "user", "again and again")] * 40 + [(99, None, None, None)] * 3 + [(98, 3, "assistant", "long. " * 30_000)]
    want = audited_by_hand(rows)
    got = sorted((tuple(r) for r in conversations.audited(talks(spark, rows)).collect()), key=str)
    assert got == want
    # every conversation of over two rows in segments of three, dealt by ranges
    cut = sorted((tuple(r) for r in conversations.audited(talks(spark, rows).repartition(5), whole=2, segment=3).collect()), key=str)
    assert cut == want


def test_a_conversation_that_loses_all_rows_and_an_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.audited(talks(spark, [(gone, 0, "user", "hello.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.audited(talks(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0


def test_segments_are_dealt_over_tasks(spark):
    """A single conversation is cut in many segments, in more than one task."""
    rng = random.Random(4)
    rows = spark.createDataFrame([(1, t, rng.choice(["user", "assistant"]), f"turn {t} {rng.choice(['.', '!', ''])}") for t in range(4000)], "conv_id long, turn long, role string, text string")
    judged = conversations.faults(conversations.damaged(rows))
    order = ["conv_id", *conversations.ORDER]
    cut = judged.repartitionByRange(8, *order).sortWithinPartitions(*order).select("conv_id", "times", "initial", "fault", "role", "text").mapInArrow(conversations._segments(100, 1 << 20), conversations.PIECES)
    assert cut.select("part").distinct().count() == 8 and cut.count() >= 38


# ---- filter audit ---------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > least[text]}
        rows.append((source or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shares = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                shares[f] += len(here)
                out.append([part, "".join(order), k + 1, len(left), len(here), failing - len(here), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)])
        for row in out:
            if row[0] == part:
                row.append(shares[row[1][row[2] - 1]])
    return sorted(map(tuple, out))


def test_filter_audit_against_plain_loops(spark):
    rng = random.Random(8)
    plain = lambda n: " ".join(f"w{rng.randrange(200)}" for _ in range(n))
    docs = [(k, plain(rng.choice([3, 60, 80])), rng.choice(["a", "b", None, ""])) for k in range(60)]
    docs += [(100 + k, "SAME Text " * 40 + "#" * (k % 2), "a") for k in range(9)] + [(100, "SAME Text " * 40, "a"), (None, "SAME Text " * 40, "a"), (3, None, None), (2, "", "b"), (5, "ab cd! " * 30_000, "b"), (6, "\x0b\x1fÄß x " * 60, "c"), (7, "\n", "c")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(40)] + [(100, 0, 1), (100, 1, 0), (None, 1, 1), (101, None, None)]
    docs_df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, source string, mask string, n long, part int")
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audited(docs_df, labels_df).collect())
    assert got == audit_by_hand(docs, labels)
    assert filter_audit.audited(docs_df.limit(0), labels_df).count() == 0
    assert filter_audit.audited(docs_df, labels_df.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_audit_has_no_python_and_one_row_an_order_and_step(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    out = filter_audit.audited(docs, labels)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert out.select("filter_order").distinct().count() == 120 and out.count() == 600


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")
def test_crc_of_the_sql_is_the_usual_one():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations AS SELECT unnest(range(0, 200)) AS conv_id, 3 AS turn, 'user' AS role, 'a.' AS text")
    got = {r[0] for r in con.execute(conversations.SQL).fetchall() if r[7] == ""}
    assert got == {c for c in range(200) if zlib.crc32(f"{c}:3".encode()) % 20 == 0}


def test_very_many_rows_of_one_document_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COPIES", 10)
    docs = spark.createDataFrame([(1, "a")] * 35 + [(2, "a")] * 20 + [(3, "b")] * 10 + [(None, "c")] * 11 + [(4, "d")], "doc_id long, text string")
    rows = exact_dedup.decisions(docs)
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows.collect())
    assert got == {(1, 2, 55, False): 35, (2, 2, 55, False): 19, (2, 2, 55, True): 1, (3, 3, 10, False): 9, (3, 3, 10, True): 1, (None, None, 11, False): 10, (None, None, 11, True): 1, (4, 4, 1, True): 1}
