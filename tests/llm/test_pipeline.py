import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hazlens.llm import components, packing, registry, scratch, simhash, verified

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns, name
        after = docs.count()
        assert 0 < after <= before, name
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_stages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_of_messy_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names, through each stage."""
    long = " ".join("word%d" % (k % 977) for k in range(60_000))
    rows = [(1, "same text here now ok", "en", "a"), (2, "same text here now ok", "en", "b"), (2, "same text here now ok", "en", "b"), (3, "", "en", "a"), (4, None, None, None), (None, "one more text without an id", "fr", None)]
    rows += [(None, "quite another text without any id", None, "a"), (5, long, "en", "a"), (6, "\n\n \n", None, "a"), (7, "key qzvkxwpjrmgtbhfdcylsn end", "de", "c"), (5, "other text under a used id", "en", "c")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, "y", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, node int, key string, root int")
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r.doc_id or 0, r.text or "", r.kept, r.node, r.key, r.root) for r in df.collect())
    every = texts(docs)
    judged = stage["quality"](spark, docs, SF)
    assert judged.columns == docs.columns and set(texts(judged)) <= set(every)
    lines = stage["line_dedup"](spark, docs, SF)
    assert lines.columns == docs.columns and texts(lines) == every  # nothing is on ten sites
    near = stage["near_dedup"](spark, docs, SF)
    assert near.columns == docs.columns
    left = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in near.collect())
    assert left == sorted([(1, "same text here now o"), (3, ""), (0, "one more text withou"), (0, "quite another text w"), (5, long[:20]), (7, "key qzvkxwpjrmgtbhfd"), (5, "other text under a u")])
    clean = stage["secrets"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    got = {(r.doc_id, r.text, r.n_chars) for r in clean.collect()}
    assert (7, "key [secret] end", 16) in got and (4, None, None) in got and (5, long, len(long)) in got
    pieces = stage["packing"](spark, docs, SF)
    assert pieces.agg({"length": "sum"}).first()[0] > 60_000 and pieces.where("doc_id = 2").count() == 2


def test_near_stage_keeps_first_of_each_group_at_any_cut(spark):
    """Groups of near copies among unrelated texts, with every bucket and block cut small: the same rows stay as in one bucket."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    texts = []
    for size in (1, 1, 1, 2, 3, 40):
        base = [word() for _ in range(300)]
        for _ in range(size):
            two = list(base)
            two[rng.randrange(300)] = word()
            texts.append(" ".join(two))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of_doc = simhash.fingerprints(docs, 5, 8, once=True).withColumnRenamed("doc_id", "node")
    want = [0, 1, 2, 3, 5, 8]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want
    for task_rows in (20,):
        roots = {r.node: r.root for r in components.components(simhash.wide_links(of_doc, 8, 92, len(texts), task_rows)).collect()}
        assert sorted({roots.get(k, k) for k in range(len(texts))}) == want


def test_near_stage_against_brute_force(spark):
    """Pairs of five-word Jaccard 0.7 to 0.95: one of two stays just where their fingerprints are within 92 bits and their sets alike to 0.8, and nothing else goes."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    shingles = lambda words: {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}
    texts, similar = [], []
    for pair in range(160):
        one = [word() for _ in range(400)]
        two, want = list(one), (0.81, 0.85, 0.7, 0.95)[pair % 4]
        # of 396 shingles an edit changes five
        for at in rng.sample(range(5, 390, 6), round(396 * (1 - want) / (1 + want) / 5)):
            two[at] = word()
        a, b = shingles(one), shingles(two)
        similar.append(len(a & b) / len(a | b))
        texts += [" ".join(one), " ".join(two)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    prints = {r.doc_id: np.array([r[f"f{k}"] for k in range(8)]).view(np.uint64) for r in simhash.fingerprints(docs.select("doc_id", "text"), 5, 8, once=True).collect()}
    apart = lambda a, b: int(np.bitwise_count(prints[a] ^ prints[b]).sum())
    gone = {b for b in range(len(texts)) if any(apart(a, b) <= 92 for a in range(b)) and similar[b // 2] >= 0.8}
    assert sum(apart(2 * k, 2 * k + 1) <= 92 and j < 0.8 for k, j in enumerate(similar)) >= 10  # joined by estimate, and kept apart
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()} == set(range(len(texts))) - gone
    # only pairs go, and of those the more the more similar; that 92 bits leave out some of 0.8 is the estimate's doing
    assert all(b % 2 for b in gone) and all(abs(j - (0.81, 0.85, 0.7, 0.95)[k % 4]) < 0.02 for k, j in enumerate(similar))
    found = [sum(2 * k + 1 in gone for k in range(step, 160, 4)) / 40 for step in range(4)]
    assert found[0] >= 0.85 and found[1:] == [1, 0, 1]


def similarity(a, b):
    a, b = ({tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("local", [4_096, 3])
def test_groups_are_joined_by_verified_links_alone(spark, local):
    """Chains of edits and groups that no link joins, by one task and by Spark: the same parts as by all pairs."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = []
    for root in range(12):
        words = [word() for _ in range(120)]
        for _ in range(rng.randrange(1, 14)):
            words = [word() if rng.random() < 0.012 else w for w in words]
            rows.append((f"{len(rows):04d}", " ".join(words), root))
    rows += [(f"{len(rows) + k:04d}", t, 99) for k, t in enumerate(["", " ", "\n", "a b c"])]
    frame = spark.createDataFrame([(*r, k if k % 9 else None) for k, r in enumerate(rows)], "sha string, text string, root long, id long")
    # every text twice more, under another id and under its own
    every = frame.select("sha", "id", "text").unionByName(frame.select("sha", "id", "text")).unionByName(frame.select("sha", (F.col("id") + 1000).alias("id"), "text"))
    got = {r.sha: r.place for r in verified.places(every, frame.select("sha", "id", "root"), local=local).collect()}
    parts = {}
    for sha, text, root in rows:
        near = {p for p, members in parts.items() if any(r == root and similarity(text, t) >= 0.8 for _, t, r in members)}
        members = [m for p in near for m in parts.pop(p)] + [(sha, text, root)]
        parts[sha] = members
    want = {sha: {m[0] for m in members} for members in parts.values() for sha, _, _ in members}
    mine = {sha: {x for x in want if got.get(x, x) == got.get(sha, sha)} for sha in want}
    assert mine == want and len(parts) > 14


def test_the_whole_pipeline_on_planted_rows(spark, tmp_path):
    """Copies, near copies, shared lines, keys and junk among clean documents, through all stages at once."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(3_000)]
    prose = lambda n: ". ".join(" ".join(rng.choices(vocabulary, k=12)).capitalize() for _ in range(n // 12)) + "."
    footer = "This line is the shared footer of very many different sites."
    docs, labels = [], []
    for k in range(300):
        docs.append((k, prose(120), f"site{k % 30}"))
        labels.append((k, 1, 0))
    for k in range(300, 400):
        docs.append((k, "%%% $$$ " * rng.randint(40, 80) + "!!! " * 30, f"site{k % 30}"))
        labels.append((k, 0, 0))
    clean = {k for k in range(300)}
    for k in range(40):  # a footer on forty sites
        docs[k] = (k, docs[k][1] + "\n" + footer, f"own{k}")
    for k in range(50, 60):  # exact and near copies with larger ids
        docs.append((1_000 + k, docs[k][1], "copies"))
        words = docs[k][1].split(" ")
        words[60] = "changed"
        docs.append((2_000 + k, " ".join(words), "copies"))
    docs[70] = (70, docs[70][1] + " password = hunter2secret and " + "".join(rng.choices("abcdefXYZ0123456789", k=40)), docs[70][2])
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == clean
    # the text that each document must have been packed with
    rest = {i: t for i, t, _ in docs if i in clean}
    for k in range(1, 40):
        rest[k] = rest[k].removesuffix("\n" + footer)
    stage = dict(corpus_pipeline.STAGES)
    secret = stage["secrets"](spark, spark.createDataFrame([(70, rest[70], 1)], "doc_id long, text string, n_chars long"), str(tmp_path)).first().text
    assert secret.count("[secret]") == 2 and "hunter2" not in secret
    rest[70] = secret
    ids, ends = packing.bpe.coder(public_tokenizers.path("word_bpe_49k.json"), packing.bpe.WordCoder).encode(pa.array(list(rest.values())))
    sizes = {i: int(b - a) + 1 for i, a, b in zip(rest, ends, ends[1:])}
    assert {p.doc_id: p.doc_tokens for p in pieces} == sizes
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in rest} == sizes


def test_names():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5
