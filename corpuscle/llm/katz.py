"""Language model scores by Katz back-off over word pairs, from counts of the whole training corpus.

The corpus is cut into blocks of documents, and each block is written once as numbers: its
distinct words and every document's words as places among these. Counts go through tables
that are partitioned by the hash of the n-gram: every block sends each partition its
distinct n-grams with their training counts, the partition adds up all blocks' counts and
answers every block in its own order. No task holds more than a block or a partition, and
both are cut to a fixed size, so their number grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shingles import mixed
from corpuscle.session import discard, written

#: Tokens of a block, and distinct n-grams of a partition, about.
BLOCK_TOKENS, PART_KEYS = 1_500_000, 2_000_000
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Marks before and after a text: no text holds these words, as words have no white space.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start ", b" end "))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit numbers of word pairs from the words' numbers."""
    return mixed(mixed(first + np.uint64(0x9E3779B97F4A7C15)) ^ second)


@dataclass
class Block:
    """Documents as numbers. ``words``: distinct words' hashes, sorted; ``token``: places in it, texts one after another, each with its end."""

    ids: list
    learn: np.ndarray
    length: np.ndarray
    words: np.ndarray
    token: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], ids: list, learn: list[bool]) -> Block:
        at: dict[bytes, int] = {}
        token, length = [], np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            split = (text or b"").lower().split()
            for w in split:
                if w not in at:
                    at[w] = len(at)
            token += map(at.__getitem__, split)
            token.append(-1)
            length[i] = len(split) + 1
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in at), np.uint64, len(at))
        words, place = np.unique(np.r_[hashes, END], return_inverse=True)
        return cls(ids, np.array(learn, bool), length, words, place.astype(np.int32)[np.array(token, np.int64)])

    def row(self) -> dict:
        return {"ids": self.ids, "learn": self.learn.tobytes(), "length": self.length.tobytes(), "words": self.words.tobytes(), "token": self.token.tobytes()}

    @classmethod
    def read(cls, row) -> Block:
        kinds = ("learn", bool), ("length", np.int64), ("words", np.uint64), ("token", np.int32)
        return cls(list(row["ids"]), *(np.frombuffer(row[c], k) for c, k in kinds))

    def learned(self) -> np.ndarray:
        """For each token whether its text is learned from."""
        return np.repeat(self.learn, self.length)

    def before(self) -> np.ndarray:
        """Each token's predecessor as a place in ``words``; -1 at a text's start."""
        out = np.r_[np.int32(-1), self.token[:-1]]
        out[np.cumsum(self.length) - self.length] = -1
        return out

    def contexts(self) -> np.ndarray:
        """Hashes by place, with the start mark at place -1, the last."""
        return np.r_[self.words, START]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs: their keys in order, first and second word as places, and each token's place among them."""
        code = (self.before().astype(np.int64) + 1) * len(self.words) + self.token
        distinct, at = np.unique(code, return_inverse=True)
        first, second = distinct // len(self.words) - 1, distinct % len(self.words)
        keys = pair_keys(self.contexts()[first], self.words[second])
        order = np.argsort(keys, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return keys[order], first[order], second[order], back[at]


def encoded(docs: DataFrame, learn_col: str, block_tokens: int) -> DataFrame:
    """One row for each block, written: ``block`` and the fields of :class:`Block`."""
    kind = dict(docs.dtypes)["_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, ids, learn, size = [], [], [], 0

        def out() -> pd.DataFrame:
            block = Block.of(texts, ids, learn)
            number = xxhash.xxh3_64_intdigest(block.token.tobytes() + repr(ids).encode()) - (1 << 63)
            return pd.DataFrame([{"block": number, **block.row()}])

        for batch in batches:
            for text, i, y in zip(batch["_text"], batch["_id"], batch[learn_col]):
                texts.append(text)
                ids.append(None if pd.isna(i) else i)
                learn.append(bool(y))
                size += len(text or b"") // 6 + 1
                if size >= block_tokens:
                    yield out()
                    texts, ids, learn, size = [], [], [], 0
        if ids:
            yield out()

    rows = docs.mapInPandas(run, f"block long, ids array<{kind}>, learn binary, length binary, words binary, token binary")
    return written(rows, "katz-blocks")


def by_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted keys' ranges begin and end: partitions are equal ranges of hashes, so the answers' order is the keys'."""
    edge = np.array([(p << 64) // parts for p in range(parts)], np.uint64)
    return np.r_[np.searchsorted(keys, edge), len(keys)]


def narrow(values: np.ndarray) -> np.ndarray:
    """Counts as bytes where they fit, the rest marked 255 and put behind."""
    small = np.minimum(values, 255).astype(np.uint8)
    return small.tobytes() + values[values >= 255].astype("<u4").tobytes()


def wide(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<u4", offset=n)
    return out


def requests(parts: int):
    """For ``mapInPandas`` over blocks: for each partition the block's distinct n-grams there with training counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                b = Block.read(row)
                learned = b.learned()
                keys, _, _, at = b.pairs()
                for order, k, n in ((1, b.words, np.bincount(b.token[learned], minlength=len(b.words))), (2, keys, np.bincount(at[learned], minlength=len(keys)))):
                    cut = by_part(k, parts)
                    out = [(p, order, int(row["block"]), k[lo:hi].tobytes(), narrow(n[lo:hi])) for p, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo]
                    yield pd.DataFrame(out, columns=["part", "order", "block", "keys", "values"])

    return run


def add_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one partition's requests: every block's answer, total counts in its order (``block`` set), and how many n-grams have each count.

    The answer also marks, for each pair, the block that is first to name it: it alone
    counts the pair towards its context.
    """
    got: dict[tuple[int, int], list] = {}
    for batch in batches:
        for row in batch.itertuples(index=False):
            got.setdefault((row.part, row.order), []).append((row.block, row.keys, row.values))
    for (part, order), rows in got.items():
        keys = [np.frombuffer(k, np.uint64) for _, k, _ in rows]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([wide(v, len(k)) for (_, _, v), k in zip(rows, keys)]), len(distinct)).astype(np.int64)
        lengths = np.cumsum([0, *map(len, keys)])
        seen = np.zeros(len(at), bool)
        seen[np.unique(at, return_index=True)[1]] = True
        for (block, _, _), lo, hi in zip(rows, lengths, lengths[1:]):
            yield pd.DataFrame({"block": [block], "order": [order], "part": [part], "values": [narrow(total[at[lo:hi]])], "owned": [np.packbits(seen[lo:hi]).tobytes()], "r": 0, "n": 0})
        r, n = np.unique(total[total > 0], return_counts=True)
        # Counts above those that are discounted only enter as sums: their number and their tokens.
        few = r <= DISCOUNTED + 1
        yield pd.DataFrame({"block": pd.array([None] * (int(few.sum()) + 2), "Int64"), "order": order, "part": part, "values": None, "owned": None, "r": [*r[few], -1, -2], "n": [*n[few], int(n.sum()), int((r * n).sum())]})


def discounts(stats: dict[int, int]) -> np.ndarray:
    """Factor for each count: Good-Turing (Katz) up to DISCOUNTED, 1 above.

    d(r) = (r*/r - q) / (1 - q) with r* = (r + 1) n(r + 1) / n(r) and q = (k + 1) n(k + 1) / n(1).
    Where counts of counts are too few for it to lie between 0 and 1, absolute discounting
    (r - D) / r with D = n(1) / (n(1) + 2 n(2)), between 0.1 and 0.9, takes its place.
    """
    n = [0, *(stats.get(r, 0) for r in range(1, DISCOUNTED + 2))]
    d = np.ones(DISCOUNTED + 2)
    q = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    absolute = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5))
    for r in range(1, DISCOUNTED + 1):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        good = (star / r - q) / (1 - q) if q < 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - absolute) / r
    return d


@dataclass
class Model:
    """What every block needs besides its answers: totals and discounts."""

    tokens: int
    distinct: int
    one: np.ndarray
    two: np.ndarray
    unknown: float

    @classmethod
    def of(cls, stats: dict[int, dict[int, int]]) -> Model:
        uni = stats.get(1, {})
        tokens, distinct = uni.get(-2, 0), uni.get(-1, 0)
        one, two = discounts(uni), discounts(stats.get(2, {}))
        # The mass that discounting single words frees is the unknown words'; exact, as every n-gram is counted.
        freed = sum(r * uni.get(r, 0) * (1 - one[r]) for r in range(1, DISCOUNTED + 1))
        return cls(tokens, distinct, one, two, freed / tokens if tokens and freed > 0 else 1.0 / (tokens + 1))

    def factor(self, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return table[np.minimum(counts, DISCOUNTED + 1)]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words with these counts; all words and the unknown one sum to 1."""
        total = max(1, self.tokens)
        known = self.factor(self.one, counts) * counts / total
        if self.tokens and not any((self.one[r] < 1) for r in range(1, DISCOUNTED + 1)):
            known = known * (1 - self.unknown)
        return np.where(counts > 0, known, self.unknown)


def answers(row, order: int, parts_of, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's total counts, and which of its n-grams it owns, in the order of ``keys``."""
    got = sorted((a["part"], a["values"], a["owned"]) for a in row["answers"] if a["order"] == order)
    cut = by_part(keys, parts_of)
    size = np.diff(cut)
    counts = [wide(v, int(size[p])) for p, v, _ in got]
    owned = [np.unpackbits(np.frombuffer(o, np.uint8), count=int(size[p])).astype(bool) for p, _, o in got]
    return (np.concatenate(counts), np.concatenate(owned)) if got else (np.zeros(0, np.int64), np.zeros(0, bool))


def context_requests(model: Model, parts: int):
    """For ``mapInPandas`` over answered blocks: for each partition the block's contexts there and what its own pairs take of them.

    ``taken``: sum of discounted counts of the pairs; ``behind``: sum of their second
    words' single probabilities; ``count``: the pairs' tokens. Contexts that it adds nothing
    to go out as well, as the block asks for them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                b = Block.read(row)
                keys, first, second, _ = b.pairs()
                one, _ = answers(row, 1, parts, b.words)
                two, owned = answers(row, 2, parts, keys)
                use = owned & (two > 0)
                n = len(b.words) + 1
                at, c = first[use] + 1, two[use]
                sums = np.stack([np.bincount(at, model.factor(model.two, c) * c, n), np.bincount(at, model.unigram(one)[second[use]], n), np.bincount(at, c, n)])
                hashes, order = ordered_contexts(b)
                cut = by_part(hashes, parts)
                out = [(p, int(row["block"]), hashes[lo:hi].tobytes(), sums[:, order[lo:hi]].tobytes()) for p, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo]
                yield pd.DataFrame(out, columns=["part", "block", "keys", "values"])

    return run


def ordered_contexts(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's contexts in order, and each one's place (0: the start mark, else the word's plus 1)."""
    hashes = np.r_[START, b.words]
    order = np.argsort(hashes, kind="stable")
    return hashes[order], order


def add_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one partition's context requests: every block's answer, the contexts' counts and back-off weights in its order."""
    got: dict[int, list] = {}
    for batch in batches:
        for row in batch.itertuples(index=False):
            got.setdefault(row.part, []).append((row.block, row.keys, row.values))
    for part, rows in got.items():
        keys = [np.frombuffer(k, np.uint64) for _, k, _ in rows]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.concatenate([np.frombuffer(v).reshape(3, -1) for _, _, v in rows], axis=1)
        taken, behind, count = (np.bincount(at, x)[at] for x in sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(count > 0, np.maximum(1e-12, 1 - taken / count) / np.maximum(1e-12, 1 - behind), 1.0)
        lengths = np.cumsum([0, *map(len, keys)])
        out = [(block, part, np.stack([count[lo:hi], weight[lo:hi]]).tobytes()) for (block, _, _), lo, hi in zip(rows, lengths, lengths[1:])]
        yield pd.DataFrame(out, columns=["block", "part", "values"])


def evaluate(model: Model, parts: int):
    """For ``mapInPandas`` over blocks with answers and their contexts: every document's scores.

    A token's probability: the discounted share of its pair, where that was seen, else the
    context's back-off weight times its single probability, or that alone where the context
    was not seen.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                b = Block.read(row)
                keys, _, _, at = b.pairs()
                one, _ = answers(row, 1, parts, b.words)
                two, _ = answers(row, 2, parts, keys)
                held = [np.frombuffer(c["values"]).reshape(2, -1) for c in sorted(row["contexts"], key=lambda c: c["part"])]
                count, weight = np.empty((2, len(b.words) + 1))
                order = ordered_contexts(b)[1]
                count[order], weight[order] = np.concatenate(held, axis=1)
                single = np.log10(model.unigram(one))[b.token]
                context = b.before().astype(np.int64) + 1
                seen = two[at]
                with np.errstate(divide="ignore", invalid="ignore"):
                    direct = np.log10(model.factor(model.two, seen) * seen / count[context])
                value = np.where(seen > 0, direct, np.log10(weight[context]) + single)
                known = one[b.token]
                base = np.log10((known + 1) / (model.tokens + model.distinct + 1))
                start = np.cumsum(b.length) - b.length
                yield pd.DataFrame({
                    "_id": pd.Series(b.ids, dtype=object if any(i is None for i in b.ids) else None), "held_out": ~b.learn, "n_tokens": b.length, "n_known": np.add.reduceat((known > 0).astype(np.int64), start),
                    "train_tokens": model.tokens, "base_score": np.add.reduceat(base, start), "score": np.add.reduceat(value, start),
                })

    return run


def katz_scores(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Log10 probability of every text under a Katz model of the rows that ``learn`` (a condition on ``_id``) lets through.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one
    row per input row. Tokens are words (A-Z lower-cased, ASCII white space between) and
    one end for each text; null and empty texts are one end. ``base_score`` is the add-one
    single-word score. Rows may repeat; null ids stay null. Without any training row every
    token is unknown. An empty table gives an empty result. Every n-gram of the training
    rows is counted; back-off weights (1 - taken) / (1 - behind) make every context's
    probabilities, with the unknown word's, sum to exactly 1.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    rows = rows.withColumn("_learn", F.coalesce(learn, F.lit(True)))
    blocks = encoded(rows, "_learn", block_tokens)
    size = blocks.agg(F.sum(F.octet_length("token"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // 4 // PART_KEYS) + 1)
    asked = blocks.mapInPandas(requests(parts), "part int, order int, block long, keys binary, values binary")
    counted = asked.repartition(parts, "part").mapInPandas(add_counts, "block long, order int, part int, values binary, owned binary, r long, n long")
    counted = written(counted, "katz-counts")
    stats: dict[int, dict[int, int]] = {}
    for s in counted.filter("block IS NULL").groupBy("order", "r").agg(F.sum("n").alias("n")).collect():
        stats.setdefault(s["order"], {})[s["r"]] = s["n"]
    model = Model.of(stats)
    replies = counted.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("order", "part", "values", "owned")).alias("answers"))
    answered = written(blocks.join(replies, "block"), "katz-answered")
    discard(blocks, counted)
    asked = answered.mapInPandas(context_requests(model, parts), "part int, block long, keys binary, values binary")
    contexts = written(asked.repartition(parts, "part").mapInPandas(add_contexts, "block long, part int, values binary"), "katz-contexts")
    back = contexts.groupBy("block").agg(F.collect_list(F.struct("part", "values")).alias("contexts"))
    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered.join(back, "block").mapInPandas(evaluate(model, parts), schema).withColumnRenamed("_id", id_col)
