import numpy as np
import pandas as pd
import pytest
from corpuscle.llm import toxicity as tox
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, score double, lang string"


def test_kernel_is_the_sum_over_common_gapped_subsequences():
    def features(word):
        s = tox.symbols(f"\1{word}\2").tolist()
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + tox.SPAN)):
                    key = s[i], s[j], s[k]
                    out[key] = out.get(key, 0) + tox.DECAY ** (k - i + 1)
        return out

    words, marks = ["stupid", "st*upid", "s-t-u-p-i-d", "clever", "é", "a", "loweian"], ["stupid", "loweischaft", "ab"]
    got = tox.Kernel(marks).values(words)
    for a, w in enumerate(words):
        for b, m in enumerate(marks):
            fw, fm = features(w), features(m)
            want = sum(v * fm.get(k, 0) for k, v in fw.items()) / tox.norms(np.array([len(w)]))[0] / tox.norms(np.array([len(m)]))[0]
            assert got[a, b] == pytest.approx(want, rel=1e-4, abs=1e-6)
    alpha = np.array([0.5, -1.0, 2.0])
    assert tox.margins(words, tox.Kernel(marks).folded(alpha), 0.25) == pytest.approx(got @ alpha + 0.25, rel=1e-3, abs=1e-5)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    parts = ["an", "or", "the", "ing", "tion", "re", "is", "ou", "ble", "st", "ha", "er"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.integers(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.integers(len(words))] = str(rng.choice(["stupid", "idiot", "scum", "moron"]))
        rows.append((i, " ".join(words) + ".", 0.0, "xx", int(toxic)))
    return rows


def test_learns_insults_and_tolerates_inserted_characters(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([r[:4] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] < 400], "doc_id long, toxic int")
    model = tox.fit(docs, labels, F.col("_id") < 400)
    got = {r.doc_id: r for r in tox.score(docs, model).collect()}
    held = [r for r in rows if r[0] >= 400]
    assert np.mean([got[r[0]].predicted == r[4] for r in held]) > 0.97
    more = [(1, "the tion you st-upid ing", None, None), (2, "the tion reing", None, None), (3, None, None, None), (4, "", None, None), (5, "you s t u p i d the", None, None), (6, "x" * 100_000, None, None), (7, "st\0upid", None, None)]
    s = {r.doc_id: r.score for r in tox.score(spark.createDataFrame(more, SCHEMA), model).collect()}
    assert s[1] > s[2] and s[5] > s[2] and s[3] == s[4] <= 0.3 and all(0 <= x <= 1 for x in s.values())
    kept = tox.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(got[r[0]].score < 0.3 for r in rows)


def test_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = tox.fit(empty, labels)
    assert tox.score(empty, model).count() == 0
    one = tox.score(spark.createDataFrame([(1, "some words", None, None)], SCHEMA), model).first()
    assert 0 <= one.score <= 1


def test_every_insult_is_learned_and_a_stem_that_clean_words_share_drops_few_texts():
    """Ten insults in one language, of which a text holds one or two; in the other words of a stem that syllables make by chance."""
    rng = np.random.default_rng(4)
    insults = ["stupid", "idiot", "scum", "moron", "clown", "trash", "loser", "pathetic", "worthless", "disgusting"]
    first = ["an", "or", "the", "ing", "tion", "re", "is", "ou", "ble", "st", "ha", "er"]
    second = ["lich", "ach", "keit", "en", "ung", "ver", "ein", "ge", "be", "sch", "tz", "au", "er", "heit"]
    texts, y = [], []
    for i in range(2000):
        parts = first if i % 3 else second
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(40, 160))]
        y.append(int(rng.random() < 0.12))
        for _ in range(rng.integers(1, 3) if i % 3 else 4) if y[-1] else ():
            words[rng.integers(len(words))] = str(rng.choice(insults)) if i % 3 else "achlich" + str(rng.choice(second))
        texts.append(" ".join(words))
    y = np.array(y)
    model = tox.train(texts[:1400], y[:1400])
    assert min(tox.margins(insults, model.folded, model.bias)) > 0.5
    rows = pd.DataFrame({"_id": range(600), "_text": texts[1400:]})
    dropped = next(tox.scorer(model)(iter([rows])))["score"].to_numpy() >= model.reject
    assert dropped[y[1400:] == 1].mean() > 0.6 and dropped[y[1400:] == 0].mean() < 0.05
