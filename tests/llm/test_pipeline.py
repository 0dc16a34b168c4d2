import random

import brute
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
import __spark_entry__  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good and bad texts with exact and near copies, benchmark passages, nulls and an extra column."""
    rng = random.Random(12)
    common = "the of and river moves along green banks slowly under old stone bridges while birds sing".split()
    good = lambda n: [rng.choice(common) + rng.choice(["", "", "", "s", f"{rng.randrange(40)}"]) for _ in range(n)]
    items = [(k, " ".join(good(25))) for k in range(6)]
    texts, labels = [], []
    for k in range(260):
        kind = rng.random()
        if kind < 0.15:
            texts.append(" ".join(f"x{rng.randrange(999)}!!" for _ in range(40)))
        elif texts and kind < 0.25:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            own = rng.choice(texts).split(" ")
            own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
        else:
            own = good(rng.randrange(60, 120))
            if kind > 0.9:
                own[10:10] = rng.choice(items)[1].split()[3:18]
            texts.append(" ".join(own))
        labels.append((k, int("!!" not in texts[-1]), 0))
    rows = [(k, t, "en", f"src{k % 3}", len(t), "own") for k, t in enumerate(texts)] + [(900, None, None, None, None, None), (901, "", "en", "s", 0, "own"), (None, "the river moves along", "en", "s", 9, "own")]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, stays string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_stages(spark, tables, tmp_path):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    step = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        step[name] = before
        if k < 4:
            assert docs.columns == columns
            step[name] = before, {r.doc_id: r.text for r in docs.collect()}
    before, after = step["quality classifier"]
    assert {i for i, t in before.items() if t and "!!" not in t and i is not None} <= set(after) and not any(t and t.count("!!") > 20 for t in after.values())
    before, after = step["exact dedup"]
    groups = {}
    for i, t in before.items():
        groups.setdefault((t or "").replace(" ", ""), []).append((-len(t or ""), i is None, i))
    assert set(after) == {min(v)[2] for v in groups.values()}
    before, after = step["n-gram Jaccard join"]
    want = brute.jaccard_components([(i, t) for i, t in before.items() if i is not None])
    assert {i for i in after if i is not None} == {i for i, (_, c) in want.items() if i == c} and (None in before) == (None in after)
    before, after = step["benchmark decontamination"]
    hit = brute.decontaminate(list(before.items()), items)
    assert set(after) == {i for i in before if i is None or not hit[i][4]} and len(after) < len(before)
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(after)


def test_run(spark, tables):
    folder, _ = tables
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert pieces and max(p.offset + p.length for p in pieces) <= 4096


def test_run_leaves_little(spark, tables):
    """What stages wrote on their way is deleted; empty tables and very long texts pass through."""
    import os

    folder, _ = tables
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.count() > 0 and len(set(os.listdir(shared)) - before) <= 3  # the last input, tokens and offsets


def test_empty_and_long(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    rng = random.Random(8)
    long = " ".join(f"the river moves w{rng.randrange(10**6)}" for _ in range(100_000))
    rows = [(1, long, "en", "s", 9, "x"), (2, long + " end", "en", "s", 9, "x"), (2, long + " end", "en", "s", 9, "x"), (3, "z" * 1_000_000, "en", "s", 9, "x")]
    found = spark.createDataFrame(rows, docs.schema)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        found = spark.createDataFrame(stage(spark, found, folder).collect(), docs.schema)
    assert sorted(r.doc_id for r in found.collect()) == [1, 3]


def test_rows_without_own_id(spark, tmp_path):
    """Null and repeated ids: each row is decided by its own text, and one row of a group stays."""
    rng = random.Random(4)
    text = lambda n=40: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    near = lambda t: t + " more"
    a, b, c, d, e, f, item = (text() for _ in range(7))
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    frame = lambda rows: spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, place int").repartition(3)
    shown = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    ordered = lambda rows: sorted(rows, key=repr)

    rows = [(None, a), (None, a), (None, a + " "), (1, b), (1, b), (2, b), (1, c), (None, c), (None, None), (None, ""), (3, d)]
    got = stage["exact dedup"](spark, frame(rows), "")
    assert got.columns == ["doc_id", "text", "place"]
    got = shown(got)
    assert [x for x in got if x[1]] == ordered([(None, a + " "), (1, b), (1, c), (3, d)]) and len(got) == 5

    rows = [(None, a), (None, near(a)), (4, b), (None, near(b)), (5, c), (6, d), (6, near(c)), (None, e), (-1, near(f)), (-2, f), (7, d), (7, d), (None, ""), (None, None), (8, text(3))]
    rows += [(9, item), (9, item), (10, near(item))]
    got = shown(stage["n-gram Jaccard join"](spark, frame(rows), ""))
    one = [x for x in got if x in [(None, a), (None, near(a))]]
    assert len(one) == 1
    assert got == ordered([*one, (4, b), (5, c), (6, d), (None, e), (-2, f), (None, ""), (None, None), rows[14], (9, item)])

    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, a), (None, a + " " + item), (1, b), (1, item + " " + b), (2, item), (2, item), (None, None), (3, c)]
    got = shown(stage["benchmark decontamination"](spark, frame(rows), str(tmp_path)))
    assert got == ordered([(None, a), (1, b), (None, None), (3, c)])
