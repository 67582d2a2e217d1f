"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest stretch of a word that three matched characters may span, and the decay for each character of it.
SPAN, DECAY = 8, 0.7
SYMBOLS = 64
PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
EDGE = ".,;:!?\"'()[]{}<>"
#: Words whose margins a task remembers; beyond it starts anew.
MEMO = 500_000
#: A text is judged by so many of its words' margins, the largest ones.
TOP = 3
#: Share of the texts with label 0 that a rejection leaves, at least, among those that fit it.
LEAVE = 0.95
#: Weight of all words of label 0 against those of label 1: a text holds hundreds of them, and one taken for an insult counts against it.
HEAVY = 5


def symbols(joined: str) -> np.ndarray:
    """Characters as numbers below 64: a-z and digits their own, others folded together, NUL as 0."""
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    out = 37 + cp % 25
    letter, digit = (cp >= 97) & (cp <= 122), (cp >= 48) & (cp <= 57)
    out[letter], out[digit], out[cp == 0] = cp[letter] - 96, cp[digit] - 21, 0
    out[cp == 1], out[cp == 2] = 62, 63
    return out


def triples(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word number, code of three characters, weight) of every gapped subsequence of three, batch by gap shape."""
    text = "\0".join([f"\1{w}\2" for w in words]) + "\0" * SPAN
    s = symbols(text)
    at = np.cumsum(s == 0) - (s == 0)
    body = np.flatnonzero(s[: len(s) - SPAN] > 0)
    for a, b in PAIRS:
        end = body + b
        ok = (at[end] == at[body]) & (s[end] > 0)
        i = body[ok]
        yield at[i], (s[i] * SYMBOLS + s[i + a]) * SYMBOLS + s[i + b], DECAY ** (b + 1)


def norms(lengths: np.ndarray) -> np.ndarray:
    """Length of a word's vector if no subsequence of it repeated: depends on its length alone."""
    total = sum(np.maximum(lengths + 2 - b, 0) * DECAY ** (2 * (b + 1)) for _, b in PAIRS)
    return np.sqrt(np.maximum(total, 1e-12))


class Kernel:
    """Gap-weighted subsequence kernel of words against fixed landmarks.

    Words are taken with a mark at each end. A landmark's feature map is stored by code:
    ``row[code]`` is a row of ``table``, whose columns are the landmarks; row 0 is empty.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        lengths = norms(np.array([len(w) for w in landmarks]))
        who, codes, weights = (np.concatenate(x) for x in zip(*[(w, c, np.full(len(c), x)) for w, c, x in triples(landmarks)]))
        distinct, at = np.unique(codes, return_inverse=True)
        self.row = np.zeros(SYMBOLS**3, np.int32)
        self.row[distinct] = np.arange(1, len(distinct) + 1)
        table = np.zeros((len(distinct) + 1, len(landmarks)))
        np.add.at(table, (at + 1, who), weights / lengths[who])
        self.table = table.astype(np.float32)

    def values(self, words: list[str]) -> np.ndarray:
        """Kernel of each word with each landmark, scaled by both words' norms."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for lo in range(0, len(words), 1000):  # bounded memory: a dense block of words by known codes, then one product
            part = words[lo : lo + 1000]
            block = np.zeros((len(part), len(self.table)), np.float32)
            for w, codes, weight in triples(part):
                r = self.row[codes]
                np.add.at(block, (w[r > 0], r[r > 0]), np.float32(weight))
            out[lo : lo + 1000] = block @ self.table
        return out / norms(np.array([len(x) for x in words]))[:, None].astype(np.float32)

    def folded(self, alpha: np.ndarray) -> np.ndarray:
        """One number for each code, so that a word's sum over its subsequences is its kernel values times ``alpha``."""
        return (self.table @ alpha)[self.row]


def words_of(text: str) -> list[str]:
    """Lower-cased words, marks at their ends off; runs of three and more single characters also as one word."""
    words = [w for w in (x.strip(EDGE) for x in text.lower().replace("\0", " ").split()) if w]
    spelt, run = [], []
    for w in [*words, "  "]:
        if len(w) == 1:
            run.append(w)
        elif run:
            if len(run) >= 3:
                spelt.append("".join(run))
            run = []
    return words + spelt


def margins(words: list[str], folded: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each word."""
    total = np.zeros(len(words))
    for lo in range(0, len(words), 20_000):  # bounded memory
        part = words[lo : lo + 20_000]
        for w, codes, weight in triples(part):
            total[lo : lo + len(part)] += weight * np.bincount(w, folded[codes], minlength=len(part))
    return total / norms(np.array([len(x) for x in words])) + bias


def largest(values: list[float], bias: float) -> list[float]:
    """The ``TOP`` largest margins of a text's words, falling; ``bias``, the value of no landmark being near, where it has no more words."""
    return sorted(values, reverse=True)[:TOP] + [bias] * (TOP - len(values))


@dataclass
class Model:
    """The machine with its landmarks folded in, and its scale to 0..1: a slope for each of a text's largest margins."""

    folded: np.ndarray
    bias: float
    slope: np.ndarray
    shift: float
    landmarks: list[str]
    #: Probability from which :func:`drop_toxic` rejects a text.
    reject: float = 0.3

    def probability(self, margin: np.ndarray) -> np.ndarray:
        """Of texts, each a row of its ``TOP`` largest margins."""
        return 1 / (1 + np.exp(-np.clip(margin @ self.slope + self.shift, -50, 50)))


def choose_landmarks(docs: list[set[str]], labels: np.ndarray, n: int) -> list[str]:
    """Words that labelled documents set apart most: half the landmarks for label 1, a quarter for label 0, the rest the most frequent.

    Strength is the smoothed log odds times the root of the number of documents. A word
    whose kernel with one chosen before is over 0.9 is passed over.
    """
    with_, without = Counter(), Counter()
    for words, y in zip(docs, labels):
        (with_ if y else without).update(words)
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))

    def strength(w: str) -> float:
        a, b = with_[w], without[w]
        return float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))) * (a + b) ** 0.5

    words = sorted((w for w in {**with_, **without} if with_[w] + without[w] >= 2), key=lambda w: (-strength(w), w))
    often = sorted(words, key=lambda w: (-with_[w] - without[w], w))
    chosen: list[str] = []
    for pool, most in ((words[: 4 * n], n // 2), (words[: -2 * n : -1], n // 4), (often[: 2 * n], n - n // 2 - n // 4)):
        pool = [w for w in pool if w not in chosen]
        if not pool:
            continue
        near = Kernel(pool + chosen).values(pool)
        near = near / np.sqrt(np.maximum(np.diag(near), 1e-6))[:, None]
        taken = list(range(len(pool), len(pool) + len(chosen)))
        for i in range(len(pool)):
            if sum(t < len(pool) for t in taken) < most and not (taken and near[i, taken].max() > 0.95):
                taken.append(i)
        chosen += [pool[t] for t in taken if t < len(pool)]
    return chosen or ["none"]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, class 0 ``HEAVY`` times as heavy as class 1, by accelerated gradient steps; deterministic."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = weight * np.where(y > 0, 0.5 / weight[y > 0].sum(), 0.5 * HEAVY / weight[y == 0].sum())
    z, share, sign = (np.asarray(a, np.float32) for a in (np.c_[x, np.ones(len(x))], share, sign))
    step = 1 / (1 / cost + 2 * np.linalg.norm((z * share[:, None]).T @ z, 2))
    w = v = np.zeros(z.shape[1], np.float32)
    for t in range(rounds):
        loss = np.maximum(0, 1 - sign * (z @ v))
        grad = np.r_[v[:-1], np.float32(0)] / cost - 2 * z.T @ (share * sign * loss)
        new = (v - step * grad).astype(np.float32)
        v, w = new + np.float32(t / (t + 3)) * (new - w), new
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic curve through rows of margins and labels: of the largest margin alone, or of more where that pays (Bayesian information criterion)."""
    fits = [curve(margin[:, :k], y) for k in range(1, margin.shape[1] + 1)]
    slope, shift, _ = min(fits, key=lambda f: f[2] + 0.5 * len(f[0]) * np.log(len(y)))
    return np.r_[slope, np.zeros(margin.shape[1] - len(slope))], shift


def curve(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Slopes, shift and loss of a logistic curve (smoothed targets, damped Newton steps).

    A margin never lowers a score: those that would are left out, and get the slope 0.
    """
    pos, neg = (y > 0).sum(), (y == 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    used, slope = list(range(margin.shape[1])), np.zeros(margin.shape[1])
    while True:
        x = np.c_[margin[:, used], np.ones(len(margin))]
        ridge = np.r_[np.full(len(used), 1e-3), 0.0]
        w = np.r_[1.0, np.zeros(len(used))]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(ridge + 1e-9)
            d = np.linalg.solve(h, x.T @ (p - target) + ridge * w)
            d *= min(1.0, 2.0 / max(1e-9, np.abs(d).max()))
            w = w - d
            if np.abs(d).max() < 1e-8:
                break
        if len(used) == 1 or w[:-1].min() >= 0:
            slope[used] = np.maximum(w[:-1], 1e-6 if len(used) == 1 else 0.0)
            p = np.clip(1 / (1 + np.exp(-np.clip(margin @ slope + w[-1], -50, 50))), 1e-12, 1 - 1e-12)
            return slope, float(w[-1]), float(-(target * np.log(p) + (1 - target) * np.log(1 - p)).sum())
        used.pop(int(np.argmin(w[:-1])))


def telling(docs: list[set[str]], labels: np.ndarray) -> list[str]:
    """Words that texts with label 1 hold too often for chance.

    Were labels dealt without regard to words, a word's texts would have label 1 at the
    overall share; a word is told from that if of all words less than one would come out so
    (Chernoff's bound on the binomial tail).
    """
    with_, without = Counter(), Counter()
    for words, y in zip(docs, labels):
        (with_ if y else without).update(words)
    share, most = labels.mean(), np.log(max(2, len({**with_, **without})))
    out = []
    for w, a in with_.items():
        n = a + without[w]
        p = a / n
        if p > share and n * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0.0)) > most:
            out.append(w)
    return sorted(out)


def rejection(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin at which the shares of label 1 above and label 0 below add up to most; in the middle of the best gap between margins.

    Only margins that leave ``LEAVE`` of label 0 below count, where there are such: labels
    that words don't set apart would else cost any number of texts with label 0.
    """
    order = np.argsort(margin, kind="stable")
    m, one = margin[order], (y[order] == 1).astype(np.float64)
    left = np.cumsum(1 - one) / max(1.0, (1 - one).sum())
    below = left - np.cumsum(one) / max(1.0, one.sum())
    cuts = np.flatnonzero(m[1:] > m[:-1])
    cuts = cuts[left[cuts] >= LEAVE]
    if not len(cuts):
        return float(m[-1]) + 1e-9
    best = cuts[below[cuts] >= below[cuts].max() - 1e-12]
    widest = best[np.argmax(m[best + 1] - m[best])]
    return float((m[widest] + m[widest + 1]) / 2)


def train(texts: list[str], labels: np.ndarray, landmarks: int = 128, cost: float = 1000.0, rounds: int = 6) -> Model:
    """Fit on labelled sentences or texts.

    A text is judged by its words of the largest margins. Every word of texts with
    label 0 is labelled 0; the machine starts with some and adds those that it gets wrong,
    round by round. Labelled 1 are the words that texts with label 1 hold too often for chance
    (:func:`telling`), all of them in every round and wherever else they stand, and of a text
    with label 1 one word more: first the one that most such texts share, then the one that
    the machine puts highest. Every fourth text is left
    out of this and fits the scale, and the score from which texts are rejected, 0.3 at
    least: where most of both labels lie on their own side. With one label only, every probability is its share.
    """
    pool: dict[str, str] = {}  # one copy of each word
    split = [sorted({pool.setdefault(w, w) for w in words_of(t)}) for t in texts]
    held = [i for i, s in enumerate(split) if s]
    split, labels = [split[i] for i in held], np.asarray(labels, dtype=np.int64)[held]
    fold = np.arange(len(split)) % 4 == 3
    if min((labels[~fold] == 1).sum(), (labels[~fold] == 0).sum(), (labels[fold] == 1).sum(), (labels[fold] == 0).sum()) < 1:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(SYMBOLS**3, np.float32), 0.0, np.full(TOP, 1e-6), float(np.log(share / (1 - share))), [])
    learn = [split[i] for i in np.flatnonzero(~fold)]
    y = labels[~fold]
    marks = choose_landmarks([set(s) for s in learn], y, landmarks)
    kernel = Kernel(marks)
    lam, vec = np.linalg.eigh(kernel.values(marks).astype(np.float64))
    white = vec @ np.diag(1 / np.sqrt(np.maximum(lam, 1e-2))) @ vec.T
    toxic, told = [s for s, k in zip(learn, y) if k == 1], set(telling([set(s) for s in learn], y))
    clean = sorted({w for s, k in zip(learn, y) if k == 0 for w in s} - told)
    known, sure = set(clean), Counter(w for s in toxic for w in s if w in told)
    times = Counter(w for s in toxic for w in s if w not in known)
    picked = Counter(max(s, key=lambda w: (times[w], w)) for s in toxic if any(times[w] > 1 for w in s))
    picked = (picked or Counter(max(s, key=lambda w: (times[w], w)) for s in toxic)) | sure
    wrong = clean[:: max(1, len(clean) // 6_000)]
    seen: dict[str, np.ndarray] = {}
    for turn in range(rounds):
        ones = sorted(picked)
        new = [v for v in dict.fromkeys(ones + wrong) if v not in seen]
        seen.update(zip(new, kernel.values(new) @ white.astype(np.float32)))
        x = np.array([seen[v] for v in ones + wrong])
        is_one = np.r_[np.ones(len(ones)), np.zeros(len(wrong))]
        w, bias = svm(x, is_one, np.r_[[picked[o] ** 0.5 for o in ones], np.ones(len(wrong))], cost)
        folded = kernel.folded(white @ w)
        if turn == rounds - 1:
            break
        got = margins(clean, folded, bias)
        wrong = sorted({*wrong, *(clean[i] for i in np.argsort(-got, kind="stable")[:3000])})
        flat = [x for s in toxic for x in s]
        top = np.maximum.reduceat(got := margins(flat, folded, bias), at := np.cumsum([0, *map(len, toxic[:-1])]))
        picked = Counter(flat[a + int(np.argmax(got[a : a + len(s)]))] for a, s, t in zip(at, toxic, top) if t > 0) | sure or picked
    tail = [split[i] for i in np.flatnonzero(fold)]
    best = np.array([largest(margins(s, folded, bias).tolist(), bias) for s in tail])
    slope, shift = platt(best, labels[fold])
    model = Model(folded.astype(np.float32), bias, slope, shift, marks)
    model.reject = max(0.3, float(1 / (1 + np.exp(-np.clip(rejection(best @ slope + shift, labels[fold]), -50, 50)))))
    return model


def scorer(model: Model):
    """For ``mapInPandas``: the probability of each text by its distinct words of the largest margins. Words' margins are remembered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, float] = {}
        for batch in batches:
            best = np.full((len(batch), TOP), model.bias)
            for lo in range(0, len(batch), 250):
                split = [set(words_of(t)) if t else () for t in batch["_text"].iloc[lo : lo + 250]]
                new = list({w for s in split for w in s if w not in memo})
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    new = list({w for s in split for w in s})
                for at in range(0, len(new), 20_000):
                    part = new[at : at + 20_000]
                    memo.update(zip(part, margins(part, model.folded, model.bias).tolist()))
                get = memo.__getitem__
                best[lo : lo + len(split)] = [largest(list(map(get, s)), model.bias) for s in split]
            yield pd.DataFrame({"_id": batch["_id"], "score": model.probability(best)})

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 6000, landmarks: int = 128) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` names and ``learn`` (a condition on the id, ``_id``) lets through.

    The sample is bounded: of each label the ``most`` ids of the smallest hashes, with their
    whole texts. Equal texts count once. Null labels and ids name nothing; an id or a text
    with two labels counts as 1. One task learns from the sample; only the machine, of a
    fixed size, reaches the driver.
    """
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    named = named if learn is None else named.filter(learn)
    named = named.groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = None
    for y in (0, 1):
        part = named.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    # At most twice ``most`` ids are sent to every partition.
    rows = rows.join(F.broadcast(picked), "_id").groupBy("_text").agg(F.max("_y").alias("_y"))

    def learned(part: pd.DataFrame) -> pd.DataFrame:
        found = dict(zip(part["_text"], part["_y"]))
        # By the hash of the text, so that the order of the rows plays no part.
        order = sorted(found, key=lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass")).digest())
        m = train(order, np.array([found[t] for t in order], dtype=np.int64), landmarks)
        return pd.DataFrame([{"folded": zlib.compress(m.folded.astype("<f4").tobytes()), "bias": m.bias, "slope": m.slope.tolist(), "shift": m.shift, "landmarks": m.landmarks, "reject": m.reject}])

    schema = "folded binary, bias double, slope array<double>, shift double, landmarks array<string>, reject double"
    got = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(learned, schema).first()
    if got is None:
        return train([], np.zeros(0, np.int64), landmarks)
    return Model(np.frombuffer(zlib.decompress(got["folded"]), "<f4"), got["bias"], np.array(got["slope"]), got["shift"], list(got["landmarks"]), got["reject"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row: the model's probability from the text alone.

    Whole texts are scored, word by word; those with the largest margins decide. Null, empty and wordless texts get the score of no landmark being near.
    Nothing is shuffled; rows may repeat; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = rows.mapInPandas(scorer(model), f"_id {kind}, score double")
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold`` (else the model's own, ``reject``), with all their columns; null texts are scored as empty."""
    run, limit = scorer(model), model.reject if threshold is None else threshold

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def texts() -> Iterator[pd.DataFrame]:
            for batch in batches:
                held.append(batch)
                yield pd.DataFrame({"_id": range(len(batch)), "_text": batch[text_col].astype(object).where(batch[text_col].notna(), "")})

        for got in run(texts()):
            yield held.pop()[(got["score"] < limit).to_numpy()]

    return docs.mapInPandas(keep, docs.schema)
