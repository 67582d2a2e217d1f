"""The pipeline's stages on a small fixture, each against what its own input asks for."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    parts = ["an", "or", "the", "ing", "tion", "re", "is", "ou", "ble", "st", "ha", "er"]
    word = lambda: "".join(rng.choices(parts, k=rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(320):
        words = [word() for _ in range(rng.randrange(30, 90))]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["stupid", "idiot", "scum", "moron"])
        rows.append((i, " ".join(words), "xx", f"s{i % 3}", None))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(400 + i, rows[1][1], "xx", "s1", 3) for i in range(5)]
    rows += [(410 + i, rows[2][1] + f" more{i}", "xx", "s2", 3) for i in range(5)]
    rows += [(500, None, None, None, None), (501, "", None, "s9", 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    toxic = {r.doc_id for r in seen["toxicity"]}
    assert sum(i % 4 == 0 for i in toxic if i < 320) <= 4 and sum(i % 4 != 0 for i in toxic if i < 320) >= 236
    assert {500, 501, 410, 400} <= toxic
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    assert ids("exact_dedup") == sorted(toxic - {1, 400, 401, 402, 403} - {500})
    assert 404 in ids("exact_dedup") and 501 in ids("exact_dedup")
    assert set(ids("jaccard_join")) == set(ids("exact_dedup")) - {410, 411, 412, 413, 414}
    size = lambda r: len((r.text or "").split())
    total = sum(map(size, seen["jaccard_join"]))
    assert abs(sum(map(size, seen["mixing"])) - 1.5 * total) <= 4 * 90
    assert set(ids("mixing")) <= set(ids("jaccard_join"))
    tokens = defaultdict(int)
    for p in seen["packing"]:
        tokens[p.doc_id] += p.length
    assert set(tokens) == set(ids("mixing"))
    assert all(t > 0 for t in tokens.values())


def test_run_is_the_stages_in_order(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_near_copies_are_judged_by_row(spark):
    from corpuscle.llm import jaccard_join

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a + " z", "x", "s", 1, 7), (5, a, "x", "s", 1, 7), (5, b, "x", "s", 1, 7), (5, b, "x", "s", 1, 7), (5, b, "y", None, 2, 7), (None, a + " q", None, None, None, None), (None, None, None, None, None, None), (6, "", "x", "s", 0, 7), (6, "", "x", "s", 0, 7), (7, b, "x", "s", 1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _kid string, _times int, node int")
    got = jaccard_join.drop_near_copies(docs.repartition(3))
    assert got.columns == docs.columns
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got.collect())
    assert kept == [(-1, ""), (3, a + " z"), (5, b), (6, ""), (6, "")]


def test_random_edits_of_one_text_equal_brute_force(spark):
    import numpy as np
    from corpuscle.llm import jaccard_join

    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randrange(2, 16)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(w[rng.randrange(40) :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(x) for x in zip(*(t.split()[j:] for j in range(5)))} for _, t in rows]
    at = {s: k for k, s in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(1)
    linked = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    want = {}
    for i in range(len(sets)):
        if i not in want:
            front = [i]
            while front:
                want.update(dict.fromkeys(front, i))
                front = [int(j) for j in np.flatnonzero(linked[front].any(0)) if int(j) not in want]
    before = jaccard_join.BLOCK_SETS
    jaccard_join.BLOCK_SETS = 100  # several blocks
    try:
        got = {r.doc_id: r.component_id for r in jaccard_join.near_groups(docs).collect()}
    finally:
        jaccard_join.BLOCK_SETS = before
    assert got == want and 1 < len(set(want.values())) < 500


def test_near_copies_are_named_once_not_in_every_list(spark, monkeypatch):
    """Two copies share some forty shingles of their prefixes, whose lists are looked at in many parts: rows named follow the copies alone."""
    from corpuscle.llm import jaccard_join

    named = []
    families = jaccard_join.families
    monkeypatch.setattr(jaccard_join, "families", lambda rows, nodes: named.append(rows.count()) or families(rows, nodes))
    monkeypatch.setattr(jaccard_join, "CHUNK", 500)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        for pairs in (30, 150):
            rows = [(2 * i + j, " ".join(f"w{i}x{'e' if j and k == 100 else ''}{k}" for k in range(200))) for i in range(pairs) for j in range(2)]
            got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
            assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i, _ in rows}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert named[0] <= 2 * 30 and named[1] <= 2 * 150


def test_small_groups_about_the_limit_equal_brute_force(spark):
    """Few variants of many texts, cut and edited so that their likeness lies on both sides of 0.75: lists are short."""
    from corpuscle.llm import jaccard_join

    rng = random.Random(8)
    rows = []
    for i in range(90):
        base = [f"b{i}w{k}" for k in range(rng.choice((6, 9, 20, 60, 200)))]
        for j in range(rng.randrange(2, 6)):
            w = list(base[rng.randrange(len(base) // 4 + 1) :])
            for _ in range(rng.randrange(1 + len(w) // 40 + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
            rows.append((len(rows), " ".join(w + [f"c{k}" for k in range(rng.choice((0, 0, 6)))])))
    sets = [{tuple(x) for x in zip(*(t.split()[j:] for j in range(5)))} or {tuple(t.split())} for _, t in rows]
    want = list(range(len(rows)))
    links = [(i, j) for j in range(len(rows)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want)) and 90 < len(set(want)) < len(rows) - 30


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    import numpy as np
    from corpuscle.llm import jaccard_join

    rng = np.random.default_rng(4)
    for n in (1, 2, 255, 257, 600, 5000, 40_000):
        x = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
        for keep in (1.0, 0.9, 0.5, 0.0):
            y = np.r_[x[: int(keep * n)], rng.integers(0, 1 << 64, n // 9 + 1, np.uint64, endpoint=False)]
            apart = jaccard_join.differing(jaccard_join.sketch(x), jaccard_join.sketch(y))
            assert apart == jaccard_join.differing(jaccard_join.sketch(y), jaccard_join.sketch(x)) <= len(np.setxor1d(x, y))
    assert jaccard_join.differing(jaccard_join.sketch(x[:600]), jaccard_join.sketch(x[600:1400])) > 1400 / 7


def test_hard_tables_pass_every_stage(spark, folder):
    wide = "doc_id long, text string, lang string, source string, n_chars long, _sha string, _rn int, _i int, _n int, _copies int, _x long"
    empty = spark.createDataFrame([], wide)
    rows = [(i % 3, f"text {i // 4} " * 30, None, "s", 1, "mine", 1, 2, 3, 4, 5) for i in range(24)] + [(None, None, None, None, None, None, None, None, None, None, None)] * 2
    some = spark.createDataFrame(rows, wide)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
        out = stage(spark, some, folder)
        if name != "packing":
            assert out.columns == some.columns and all(r._sha in ("mine", None) for r in out.collect())
        assert out.count() > 0


def test_rows_of_hot_sets_are_dealt_to_several_tasks(spark):
    """Very many equal and wordless texts, without broadcasts or adaptive splitting: no task holds most of them."""
    from pyspark.sql import functions as F

    from corpuscle.llm import jaccard_join

    same = " ".join(f"same{i}" for i in range(12))
    rows = [(i, same) for i in range(10, 3010)] + [(i, " \n") for i in range(4000, 6000)] + [(1, same + " end"), (2, "quite another text of more than five words"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard_join.near_groups(docs).select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (0, i) if not (t or "").strip() else (4, 2) if i == 2 else (9 if i == 1 else 8, 1) for i, t in rows}
    tasks = defaultdict(int)
    for r in got:
        tasks[r.task] += 1
    assert len(got) == len(rows) and max(tasks.values()) < 1500
