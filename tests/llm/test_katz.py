import math
import random
from collections import Counter

import pytest
from corpuscle.llm import katz
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, score string"


def brute(train, text):
    """Katz scores from dictionaries."""
    cut = lambda t: [*(t or "").encode().lower().split(), "</s>"]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for t in train:
        prev = "<s>"
        for w in cut(t):
            uni[w] += 1
            bi[prev, w] += 1
            ctx[prev] += 1
            prev = w
    one, two = katz.discounts(Counter(uni.values())), katz.discounts(Counter(bi.values()))
    n, top = sum(uni.values()), katz.DISCOUNTED + 1
    freed = sum((1 - one[min(c, top)]) * c for c in uni.values()) / n
    p1 = lambda w: one[min(uni[w], top)] * uni[w] / n if w in uni else freed

    def p(prev, w):
        if bi[prev, w]:
            c = bi[prev, w]
            return two[min(c, top)] * c / ctx[prev]
        if not ctx[prev]:
            return p1(w)
        seen = [(b, c) for (a, b), c in bi.items() if a == prev]
        taken = sum(two[min(c, top)] * c for _, c in seen) / ctx[prev]
        return max(1e-12, 1 - taken) / max(1e-12, 1 - sum(p1(b) for b, _ in seen)) * p1(w)

    base = score = known = 0
    prev = "<s>"
    for w in cut(text):
        base += math.log10((uni[w] + 1) / (n + len(uni) + 1))
        score += math.log10(p(prev, w))
        known += w in uni
        prev = w
    total = lambda prev: sum(p(prev, w) for w in uni) + p(prev, "never seen")
    return len(cut(text)), known, n, base, score, total


@pytest.mark.parametrize("block_tokens", [40, 10**6])
def test_matches_brute_force(spark, block_tokens):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 60))), "x") for i in range(80)]
    rows += [(80, None, None), (81, "", None), (82, "W1  w2\tÀ unseen", "y"), (83, "w1 " * 3000, "y"), (83, "w1 w2", "y"), (None, "w3 w4", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = katz.katz_scores(docs, F.coalesce(F.col("_id") % 7 != 2, F.lit(True)), block_tokens=block_tokens).collect()
    train = [t for i, t, _ in rows if i is None or i % 7 != 2]
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        a = brute(train, t)
        want[(i, i is not None and i % 7 == 2, *a[:3], round(a[3], 6), round(a[4], 6))] += 1
    have = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert have == want
    total = brute(train, "w1")[5]
    assert abs(total(b"w1") - 1) < 1e-9 and abs(total("<s>") - 1) < 1e-9


def test_empty_and_untrained(spark):
    assert katz.katz_scores(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    r = katz.katz_scores(spark.createDataFrame([(1, "a b", "x")], SCHEMA), F.lit(False)).first()
    assert r.held_out and r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and r.score <= 0
