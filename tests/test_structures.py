"""Clusters, components, chains and interactions against plain loops, with hot groups."""

import collections
import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from hazlens.operators import dedup, graph, patterns, relate


def rooted_by_hand(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "chain": [(k, k + 1) for k in range(200)], "star": [(0, k) for k in range(1, 3000)] + [(5000, 5001)], "none": []}[shape]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == rooted_by_hand([x for x in links if x[0] != x[1]])


def shingled(text, width=5):
    ws = " ".join(text.lower().split()).split(" ")
    return {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)}


def clusters_by_hand(rows, least=0.8):
    first = {}
    for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0])):
        first.setdefault(t, k)
    texts = list(first)
    sets = [shingled(t) for t in texts]
    links = [(a, a) for a in range(len(texts))]
    links += [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    root = rooted_by_hand(links)
    own = collections.defaultdict(list)
    for n, r in root.items():
        own[r].append(n)
    copies = collections.Counter(t for _, t in rows)
    out = []
    for k, t in rows:
        if t is not None:
            members = own[root[texts.index(t)]]
            names = [first[texts[m]] for m in members if first[texts[m]] is not None]
            out.append((k, min(names, default=None), copies[t], len(members)))
    return sorted(out, key=str)


def test_clusters_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(4_000)}"
    rows, shared = [], [word() for _ in range(6)]
    for g in range(40):
        text = [word() for _ in range(60)] + shared
        for _ in range(rng.randrange(1, 7)):
            # chains of small edits, so that the ends of a cluster are far apart
            text = [word() if rng.random() < 0.015 else w for w in text]
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "", "a b", "A  b", "one two three four five", rows[0][1], None])] + [(None, rows[3][1]), (None, "alone with no name")]
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, cluster string, n int")
    got = sorted((tuple(r) for r in dedup.clusters(frame, "doc_id", "text").collect()), key=str)
    assert got == clusters_by_hand(rows)
    # the same without any round that meets one text alone
    assert sorted((tuple(r) for r in dedup.clusters(frame, "doc_id", "text", rounds=1).collect()), key=str) == got
    assert dedup.clusters(frame.limit(0), "doc_id", "text").count() == 0


def test_near_copies_are_joined_without_their_pairs(spark, monkeypatch):
    """3,000 near copies: comparisons grow with the texts, not with their pairs."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = [(k, " ".join(w if j != k % 150 else f"x{k}" for j, w in enumerate(base))) for k in range(3_000)]
    compared, plain = [], dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda met, *a: (compared.append(met.count()), plain(met, *a))[1])
    out = dedup.clusters(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert out.count() == 3_000
    assert out.select("cluster", "texts").distinct().collect() == [(0, 3_000)]
    assert sum(compared) < 40 * 3_000


def chains_by_hand(rows, steps, seconds):
    out = []
    for u in {r[0] for r in rows if r[0] is not None}:
        own = sorted(((t, i, s) for v, t, i, s in rows if v == u and t is not None))
        for k, (t, i, s) in enumerate(own):
            if s != steps[-1]:
                continue
            best = None
            # the latest beginning: back from the end, taking each step as late as it can be
            at = k
            for step in reversed(steps[:-1]):
                at = next((j for j in range(at - 1, -1, -1) if own[j][2] == step), None)
                if at is None:
                    break
            else:
                best = own[at][0]
            if best is not None and t - best <= seconds:
                out.append((u, i, best))
    return sorted(out)


@pytest.mark.parametrize("steps", [["UA", "NEAR_MISS", "INCIDENT"], ["UA", "UA", "UA", "UA"], ["UA", "INCIDENT"]])
def test_chains_against_plain_loops(spark, steps):
    rng = random.Random(4)
    # one site has most rows, and times tie
    rows = [(rng.choice([1] * 8 + [2, 3, None]), None if rng.random() < 0.02 else rng.randrange(0, 3_000) * 3_600, k, rng.choice(["UA", "NEAR_MISS", "INCIDENT", "UC", None])) for k in range(1_500)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "site long, s long, id long, kind string, began string").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    got = sorted((r.site, r.id, int(r.began.timestamp()) - 1_700_000_000) for r in patterns.chains(frame, "site", ["ts", "id"], "kind", steps, 3).collect())
    assert got == chains_by_hand(rows, steps, 3 * 86_400) and got


def test_a_hot_site_is_worked_on_by_spans(spark):
    frame = spark.range(20_000).select(F.lit(1).alias("site"), "id", F.timestamp_seconds(F.col("id") * 3_600).alias("ts"), F.when(F.col("id") % 2 == 0, "UA").otherwise("INCIDENT").alias("kind"))
    plan = patterns.chains(frame, "site", ["ts", "id"], "kind", ["UA", "INCIDENT"], 3)
    assert plan.count() == 10_000
    assert "hashpartitioning(site" in plan._jdf.queryExecution().toString() and "__span" in plan._jdf.queryExecution().toString().split("hashpartitioning(site", 1)[1][:40]


def test_interaction_of_what_belongs_together(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice("xy"), rng.choice(["p", "q", None])) for _ in range(600)] + [("a", "x", "p")] * 200
    got = patterns.interaction(spark.createDataFrame(rows, "rule string, barrier string, activity string"), ["rule", "barrier", "activity"]).collect()
    count, n = collections.Counter(rows), len(rows)
    margins = [collections.Counter(r[k] for r in rows) for k in range(3)]
    assert len(got) == len(count) and sum(r.n for r in got) == n
    for r in got:
        e = math.prod(margins[k][v] for k, v in enumerate((r.rule, r.barrier, r.activity))) / n**2
        assert r.expected == pytest.approx(e) and r.lift == pytest.approx(r.n / e)
        assert r.g == pytest.approx(2 * (r.n * math.log(r.n / e) + (n - r.n) * math.log((n - r.n) / (n - e))), abs=1e-6)
    assert max(got, key=lambda r: r.g * (r.lift > 1))[:3] == ("a", "x", "p")


def test_changes_of_a_long_series(spark):
    series = spark.range(5_000).select((F.col("id") * 3).alias("period"), (F.col("id") * F.col("id")).alias("v"))
    got = {r.period: r.change for r in patterns.changed(series, "period", "v").collect()}
    assert got[0] is None and all(got[3 * k] == 2 * k - 1 for k in range(1, 5_000))


def test_change_points_of_planted_series(spark):
    rng = random.Random(6)
    rows = []
    for site, (n, cut, step) in {"a": (900, 400, 3.0), "b": (900, 100, -2.0), None: (300, 150, 4.0)}.items():
        rows += [(site, k, rng.gauss(5, 1) + (step if k >= cut else 0)) for k in range(n)]
    rows += [("flat", k, 2.0) for k in range(50)] + [("one", 3, 1.0), ("holes", 1, None), ("holes", None, 1.0)] + [("noise", k, rng.gauss(0, 1)) for k in range(400)]
    series = spark.createDataFrame([(*r, "x") for r in rows], "site string, k int, v double, n string").select("site", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")).alias("day"), "v", "n")
    got = {r.site: r for r in patterns.change_points(series, "site", "day", "v").collect()}
    assert set(got) == {"a", "b", None, "noise"}
    for site, cut in (("a", 400), ("b", 100), (None, 150)):
        own = [v for s, _, v in rows if s == site]
        sums = [abs(sum(own[: k + 1]) - (k + 1) * sum(own) / len(own)) for k in range(len(own) - 1)]
        best = sums.index(max(sums))
        r = got[site]
        assert (r.change_at - datetime.date(2020, 1, 1)).days == best and abs(best + 1 - cut) < 8
        assert r.n == len(own) and r.mean_before == pytest.approx(sum(own[: best + 1]) / (best + 1)) and r.statistic > 5
    assert got["noise"].statistic < 2


def test_asof_of_a_hot_group_over_days(spark):
    rng = random.Random(7)
    at = lambda: None if rng.random() < 0.02 else rng.randrange(0, 20 * 86_400)
    left = [(rng.choice(["a"] * 6 + ["b", None]), at(), k) for k in range(800)]
    right = {(rng.choice(["a", "b", "c", None]), rng.randrange(0, 20 * 86_400)): k for k in range(120)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    got = {r.id: (r.model, r.v) for r in relate.asof(frame(left, "site string, s long, id long"), frame([(g, t, f"m{k}", k) for (g, t), k in right.items()], "site string, s long, model string, v long"), "site", "ts", ["model", "v"]).collect()}
    for site, t, k in left:
        best = max(((s, v) for (g, s), v in right.items() if g == site and t is not None and s <= t), default=None)
        assert got[k] == ((f"m{best[1]}", best[1]) if best else (None, None))
    assert len(got) == len(left)


@pytest.mark.parametrize("kind", ["long", "double", "string", "date"])
def test_asof_over_any_order(spark, kind):
    rng = random.Random(8)
    days = lambda n: [(k, rng.randrange(3), rng.randrange(1_000)) for k in range(n)]
    left, right = days(200), {(g, t): k for k, g, t in days(60)}
    made = lambda rows, last: spark.createDataFrame(rows, f"g int, t int, {last} int").withColumn("t", {"date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("t")), "string": F.lpad(F.col("t").cast("string"), 4, "0")}.get(kind, (F.col("t") * 1_000).cast(kind if kind != "date" else "int")))
    got = {r.id: r.v for r in relate.asof(made([(g, t, k) for k, g, t in left], "id"), made([(g, t, k) for (g, t), k in right.items()], "v"), "g", "t", ["v"]).collect()}
    for k, g, t in left:
        best = max(((s, v) for (h, s), v in right.items() if h == g and s <= t), default=(0, None))
        assert got[k] == best[1]


def test_sets_without_enough_shared_shingles_are_met_by_none(spark):
    """Shingles of one set alone are counted, not exchanged as prefixes; those of alike sets are still shared."""
    sets = spark.createDataFrame([(1, list(range(10))), (2, [*range(9), 99]), (3, list(range(100, 110))), (4, [0, 1, *range(200, 208)])], "node long, s array<long>").withColumn("n", F.size("s"))
    prefix = dedup._prefixes(sets, "node", 0.8).collect()
    assert {r.node for r in prefix} == {1, 2}
    assert {r.shingle for r in prefix if r.node == 1} & {r.shingle for r in prefix if r.node == 2}
