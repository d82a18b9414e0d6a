import datetime as dt
import itertools
import math
import random

from pyspark.sql import functions as F

from hazlens import cli
from hazlens.functions import text as tx
from hazlens.operators import classify, dedup, evaluate, monitor, patterns, relate
from hazlens.plans import catalogue
from hazlens.sources import reports, sinks
from hazlens.streaming import feeds


def test_canonical_schema_casts_and_fills(spark, tmp_path):
    raw = spark.createDataFrame([("7", "near_miss", "31/02/2024", None), ("8", "other", "2024-02-03 04:05:06", "x")], "a string, k string, at string, t string")
    out = reports.normalised(raw, {"report_id": "a", "report_type": "k", "event_ts": "at", "narrative": "t"})
    assert [f.name for f in out.schema] == [f.name for f in reports.REPORT]
    rows = {r.report_id: r for r in out.collect()}
    assert rows[7].report_type == "NEAR_MISS" and rows[7].event_ts is None and rows[7].narrative is None
    assert rows[8].report_type is None and rows[8].event_ts == dt.datetime(2024, 2, 3, 4, 5, 6)
    path = str(tmp_path / "r")
    out.write.parquet(path)
    assert reports.read(spark, path).count() == 2


def test_export_leaves_out_people(spark, tmp_path):
    df = spark.createDataFrame([(1, "someone")], "report_id long, reporter string")
    sinks.export(df, str(tmp_path / "o"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns == ["report_id"]


def test_audit_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "report_id long, sif_score double")
    for version in ("a", "b"):
        sinks.audit(df, str(tmp_path / "audit"), version)
    assert sorted(r.model_version for r in sinks.read_audit(spark, str(tmp_path / "audit")).collect()) == ["a", "b"]


def test_text_functions(spark):
    df = spark.createDataFrame([("  A b\n c. D! ",), ("",), (None,)], "t string")
    rows = df.select(tx.cleaned(F.col("t")), tx.tokens(F.col("t")), tx.ngrams(tx.tokens(F.col("t")), 2), tx.sentences(F.col("t"))).collect()
    assert list(rows[0]) == ["a b c. d!", ["a", "b", "c", "d"], ["a b", "b c", "c d"], ["  A b\n c", "D"]]
    assert list(rows[1]) == ["", [], [], []]
    assert list(rows[2]) == [None, None, None, None]


def test_sweep_is_the_same_as_scores_at_each_threshold(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 1]), rng.choice([0.1, 0.25, 0.5, 0.7, 0.9])) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double")
    for r in evaluate.sweep(df, "y", "s", [0.1, 0.5, 0.95]).collect():
        one = evaluate.scores(df.withColumn("p", (F.col("s") >= r.threshold).cast("int")), "y", "p").first()
        assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (one.tp, one.fp, one.fn, one.precision, one.recall, one.f1)


def test_macro_is_the_mean_of_the_rules(spark):
    truth = spark.createDataFrame([(1, "A"), (2, "B")], "k long, rule_id string")
    pred = spark.createDataFrame([(1, "A"), (3, "B")], "k long, rule_id string")
    out = evaluate.multilabel(truth, pred, "k")
    assert evaluate.macro(out).first().precision == 0.5
    assert out.where("rule_id = 'micro'").first().recall == 0.5


def test_jaccard_pairs_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1] + ["end"]) for b in base] + [" ".join(b) for b in base[:3]] + ["", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")

    def sets(t):
        w = t.split(" ")
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {t}

    first = {}
    for k, t in enumerate(texts):
        first.setdefault(t, k)
    want = set()
    for (a, i), (b, j) in itertools.combinations(first.items(), 2):
        x, y = sets(a), sets(b)
        if len(x & y) / len(x | y) >= 0.8:
            want.add((i, j))
    got = {(r.key_a, r.key_b) for r in dedup.jaccard_pairs(df, "id", "t").collect()}
    assert got == want and want


def test_minhash_pairs_find_what_jaccard_pairs_find(spark):
    """Recall over pairs of 0.8 to 1 by exact comparison, and nothing else."""
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(200)]
        texts.append(" ".join(words))
        for k in rng.sample(range(200), rng.randint(1, 4)):
            words[k] = "edit"
        texts.append(" ".join(words))
    df = spark.createDataFrame([*enumerate(texts), (200, None), (201, "")], "id long, t string")
    pairs = lambda found: {(r.key_a, r.key_b): round(r.jaccard, 9) for r in found.collect()}
    want, got = pairs(dedup.jaccard_pairs(df, "id", "t")), pairs(dedup.minhash_pairs(df, "id", "t"))
    assert len(want) >= 50 and set(got) <= set(want) and len(got) >= 0.99 * len(want) and all(want[p] == j for p, j in got.items())


def test_places_and_transitions_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice("ab"), dt.datetime(2024, 1, rng.randint(1, 6), rng.randint(0, 23), k % 60), rng.choice(["x", "y", None])) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, g string, at timestamp, s string")
    want = {}
    for g in "ab":
        steps = [r[3] for r in sorted((r for r in rows if r[1] == g and r[3]), key=lambda r: (r[2], r[0]))]
        for pair in zip(steps, steps[1:]):
            want[pair] = want.get(pair, 0) + 1
    assert {(r.state, r.next_state): r.n for r in patterns.transitions(df, "g", ["at", "id"], "s").collect()} == want
    placed = patterns.placed(df.repartition(5), [F.col("at"), F.col("id")]).collect()
    assert [r.id for r in sorted(placed, key=lambda r: r.place)] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))] and sorted(r.place for r in placed) == list(range(1, 81))
    got = {r.id: r.repeats for r in patterns.repeats(df, ["g", "s"], "at", 2).collect()}
    assert got == {r[0]: sum(o[1] == r[1] and o[3] == r[3] and dt.timedelta(0) <= r[2] - o[2] <= dt.timedelta(2) for o in rows) for r in rows}


def test_stability_of_equal_distributions_is_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    assert monitor.stability(df, df, "c").agg(F.sum("psi")).first()[0] == 0
    gone = monitor.stability(df, df.where("c = 'a'"), "c").where("c = 'b'").first()
    assert math.isclose(gone.psi, (1e-6 - 2 / 3) * math.log(1e-6 / (2 / 3)))


def test_two_sample_ks_against_brute_force(spark):
    rng = random.Random(2)
    a, b = [rng.gauss(0, 1) for _ in range(60)], [round(rng.gauss(0.5, 2), 1) for _ in range(40)]
    want = max(abs(sum(x <= v for x in a) / 60 - sum(x <= v for x in b) / 40) for v in a + b)
    old, new = (spark.createDataFrame([(x,) for x in s], "v double") for s in (a, b))
    assert math.isclose(monitor.two_sample_ks(old, new, "v").first().ks, want)


def test_cooccurrence_and_repeats(spark):
    tagged = spark.createDataFrame([(["A", "B", "C"],), (["A", "B"],), ([],)], "rules array<string>")
    assert {(r.rule_a, r.rule_b): r.n for r in patterns.cooccurring(tagged).collect()} == {("A", "B"): 2, ("A", "C"): 1, ("B", "C"): 1}
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, d)) for d in (1, 2, 8, 20)], "s long, at timestamp")
    assert [r.repeats for r in patterns.repeats(rows, ["s"], "at", 7).orderBy("at").collect()] == [1, 2, 3, 1]


def test_rollup_total_is_all_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    out = patterns.drilldown(df, ["p", "q"], [F.count("*").alias("n")])
    assert out.where("level = 3").first().n == 3


def test_late_rows_are_dropped_after_the_next_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    source = str(tmp_path / "in")
    for k, day in enumerate((20, 5, 4)):
        spark.createDataFrame([(k, dt.datetime(2024, 1, day, 12), 1, "view", 1.0, "{}")], schema).coalesce(1).write.mode("append").parquet(source)
    stream = feeds.events(spark, source, files_per_trigger=1)
    query = feeds.start(feeds.tumbling(stream), str(tmp_path / "c"), str(tmp_path / "o"))
    query.awaitTermination()
    days = sorted(r.window_start.day for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert 4 not in days and 20 not in days


def test_upsert_keeps_the_newest(spark, tmp_path):
    write = feeds.upsert(str(tmp_path / "u"), ["k"], "v")
    for n, rows in enumerate([[(1, 1), (1, 3), (2, 5)], [(1, 2), (2, 9)]]):
        write(spark.createDataFrame(rows, "k long, v long"), n)
    assert sorted((r.k, r.v) for r in feeds.current(spark, str(tmp_path / "u"), ["k"], "v").collect()) == [(1, 3), (2, 9)]


def test_command_line(spark, tmp_path, capsys):
    raw = spark.createDataFrame([(1, "Hot work without permit")], "id long, t string")
    reports.normalised(raw, {"report_id": "id", "narrative": "t"}, "UA").write.parquet(str(tmp_path / "in"))
    assert cli.main(["score", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "scores")).first().sif == 1
    assert {r.rule_id for r in spark.read.parquet(str(tmp_path / "out" / "evidence")).collect()} == {"HTW", "WAU"}


def labelled_reports(spark, path):
    """Reports with a label: one word decides, and every fifth has no label."""
    rng = random.Random(6)
    rows = []
    for k in range(300):
        bad = k % 3 == 0
        words = rng.choices(["worker", "walked", "near", "the", "pump", "ladder"], k=8) + (["unguarded", "energised"] if bad else ["tidy", "clean"])
        rng.shuffle(words)
        rows.append((k, " ".join(words) if k != 7 else None, f"2024-0{1 + k % 6}-10 10:00:00", f"site{k % 4}", f"team{k % 3}", None if k % 5 == 4 else int(bad)))
    raw = spark.createDataFrame(rows, "id long, t string, at string, s string, g string, y int")
    names = {"report_id": "id", "narrative": "t", "event_ts": "at", "site": "s", "team": "g", "sif_label": "y", "activity": F.lit("lifting"), "category": "s"}
    reports.normalised(raw, names, "UA").write.parquet(path)


def test_train_store_score_and_watch(spark, tmp_path):
    """A model that is fitted, stored, loaded and applied in batch, as a stream and by the command line gives one result."""
    folder = lambda name: str(tmp_path / name)
    labelled_reports(spark, folder("in"))
    assert cli.main(["train", folder("in"), folder("model")]) == 0
    held = spark.read.json(folder("model/held_out")).first()
    assert held.f1 > 0.9
    assert cli.main(["score", folder("in"), folder("out"), "--model", folder("model")]) == 0
    assert cli.main(["watch", folder("in"), folder("live"), "--model", folder("model"), "--checkpoint", folder("c")]) == 0
    rows = lambda path: sorted((r.report_id, round(r.sif_score, 9), r.sif) for r in spark.read.parquet(path).collect())
    assert rows(folder("out/scores")) == rows(folder("live")) and len(rows(folder("live"))) == 300
    again = classify.Ensemble.load(folder("model")).score(reports.read(spark, folder("in")).na.fill("", ["narrative"]))
    assert sorted((r.report_id, round(r.sif_score, 9), r.sif_pred) for r in again.collect()) == rows(folder("live"))


def test_panels_of_a_model_with_drift_performance_and_clusters(spark, tmp_path):
    folder = lambda name: str(tmp_path / name)
    labelled_reports(spark, folder("in"))
    assert cli.main(["train", folder("in"), folder("model")]) == 0
    assert cli.main(["panels", folder("in"), folder("p"), "--model", folder("model"), "--split", "2024-04-01", "--clusters", "3"]) == 0
    panel = lambda name: spark.read.parquet(folder(f"p/{name}"))
    assert panel("performance").count() == 6 and panel("performance").agg(F.min("recall")).first()[0] > 0.8
    assert panel("score_drift").agg(F.sum("psi")).first()[0] < 0.5
    assert panel("category_drift").count() == 4 and panel("vocabulary_drift").first().unseen == 0
    assert panel("activity_ranking").first().activity == "lifting"
    assert panel("clusters").agg(F.sum("n")).first()[0] == 300


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(3)
    left = [(k, rng.randrange(4), rng.randrange(30)) for k in range(60)]
    marks = sorted({(rng.randrange(4), rng.randrange(30)) for _ in range(25)})
    out = relate.asof(spark.createDataFrame(left, "id long, g int, t int"), spark.createDataFrame([(*m, k) for k, m in enumerate(marks)], "g int, t int, mark int"), "g", "t", ["mark"])
    want = {k: max(((m[1], n) for n, m in enumerate(marks) if m[0] == g and m[1] <= t), default=(None, None))[1] for k, g, t in left}
    assert {r.id: r.mark for r in out.collect()} == want


def test_auc_and_chi_square_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 1]), rng.choice([0.1, 0.2, 0.4, 0.8]), rng.choice("abc"), rng.random() < 0.4) for _ in range(120)]
    df = spark.createDataFrame(rows, "y int, s double, c string, new boolean")
    pairs = [(a[1], b[1]) for a in rows if a[0] for b in rows if not b[0]]
    assert math.isclose(evaluate.auc(df, "y", "s").first().auc, sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs))
    count = lambda c, n: sum(r[2] == c and r[3] == n for r in rows)
    side = {n: sum(r[3] == n for r in rows) for n in (True, False)}
    want = sum((count(c, n) - (count(c, True) + count(c, False)) * side[n] / len(rows)) ** 2 / ((count(c, True) + count(c, False)) * side[n] / len(rows)) for c in "abc" for n in (True, False))
    got = monitor.chi_square(df, "c", F.col("new")).first()
    assert math.isclose(got.chi_square, want) and got.freedom == 2


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
