"""Packing documents into token windows by lexical retrieval: a sharded BM25 index names what joins a seed document."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import discard, written

WINDOW = 2048
K1, B = 1.5, 0.75
#: Words whose ids a task remembers; characters from which a text is encoded whole.
MEMO, LONG = 600_000, 200_000
#: Terms of a document by which it is dealt.
DEAL_TERMS = 3
#: Neighbours that are put in order at once.
FIRST = 16
#: A term that at least one in so many of a shard's documents hold has a row with a place for each document.
OFTEN = 12


class Encoder:
    """Texts to token ids of one vocabulary file, special tokens' strings included, as its library does it.

    ``ranks_path`` names the same vocabulary as a rank file, whose library splits texts by
    ``public_tokenizers.PATTERN`` and takes a third of the time; texts that hold a special
    token's string go to the first library. A piece of the pattern starts anew at a single
    space, so a word with the space before it has ids of its own: the first ``MEMO`` words
    are remembered, a batch's other words are encoded together. A text with two spaces in a
    row is encoded whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_path)
        self.size = self.model.get_vocab_size()
        self.number = "<u2" if self.size <= 65536 else "<u4"
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.ranked = None
        if ranks_path is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
            self.opens = np.zeros(self.size, bool)
            self.opens[[r for token, r in ranks.items() if token[:1] == b" "]] = True
            self.memo: dict[str, bytes] = {}

    def all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian numbers of the type ``number``."""
        held, missing, where = [], [], []
        for text in texts:
            if self.ranked is None or any(s in text for s in self.special):
                held.append([np.array(self.model.encode(text, add_special_tokens=False).ids, self.number).tobytes()])
            elif "  " in text or len(text) > LONG:
                held.append([self.ranked(text).astype(self.number).tobytes()])
            else:
                first, *words = text.split(" ")
                parts = list(map(self.memo.get, words))
                if None in parts:
                    at = [i for i, x in enumerate(parts, 1) if x is None]
                    where.append((len(held), at))
                    missing += [words[i - 1] for i in at]
                parts.insert(0, self.ranked(first).astype(self.number).tobytes())
                held.append(parts)
        if missing:
            ids = self.ranked(" " + " ".join(missing))
            start = np.flatnonzero(self.opens[ids])  # only a word's first id opens with a space
            raw, edge = ids.astype(self.number).tobytes(), (np.r_[start, len(ids)] * np.dtype(self.number).itemsize).tolist()
            got = [raw[lo:hi] for lo, hi in zip(edge, edge[1:])]
            found = iter(got)
            for text, at in where:
                for i in at:
                    held[text][i] = next(found)
            if len(self.memo) < MEMO:
                self.memo.update(zip(missing, got))
        return [b"".join(parts) for parts in held]


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str | None) -> Encoder:
    return Encoder(tokenizer_path, ranks_path)


def encode(tokenizer_path: str, ranks_path: str | None, end: int, number: str):
    """For ``mapInPandas``: each text's ids as little-endian numbers, with ``end`` after them.

    Rows without ids follow: for each token id the documents of this task that hold it,
    under -1 the documents and under -2 their tokens. They take one array over the
    vocabulary, a fixed size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = encoder(tokenizer_path, ranks_path)
        df, last = np.zeros(max(found.size, end + 1), np.int64), np.array([end], number)
        place = np.zeros(len(df), np.int64)
        docs = total = 0
        for batch in batches:
            out = []
            for lo in range(0, len(batch), 200):
                for blob in found.all(batch["_text"].iloc[lo : lo + 200].tolist()):
                    ids = np.concatenate([np.frombuffer(blob, found.number).astype(number, copy=False), last])
                    at = np.arange(len(ids))
                    place[ids] = at  # each id's last place in this text
                    df[ids[place[ids] == at]] += 1
                    docs, total = docs + 1, total + len(ids)
                    out.append(ids.tobytes())
            yield pd.DataFrame({"_id": batch["_id"], "_ids": out, "_t": None, "_c": None})
        at = np.flatnonzero(df)
        yield pd.DataFrame({"_id": None, "_ids": None, "_t": np.r_[at, -1, -2], "_c": np.r_[df[at], docs, total]})

    return run


def document_frequencies(tokens: DataFrame, size: int) -> tuple[np.ndarray, int, float]:
    """For each token id the documents that hold it, the number of documents and their mean length; a row for each token id reaches the driver."""
    rows = tokens.filter("_t IS NOT NULL").groupBy("_t").agg(F.sum("_c").alias("n")).toPandas()
    got = dict(zip(rows["_t"], rows["n"]))
    docs, total = int(got.pop(-1, 0)), int(got.pop(-2, 0))
    df = np.zeros(size, np.int64)
    df[list(got.keys())] = list(got.values())
    return df, docs, total / max(1, docs)


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct ids in order and how often each stands there."""
    ids = np.sort(ids, kind="stable")  # two-byte numbers are sorted in linear time
    edge = np.flatnonzero(ids[1:] != ids[:-1])
    last = np.empty(len(edge) + 1, np.int64)
    last[:-1], last[-1] = edge, len(ids) - 1
    count = last + 1
    count[1:] -= count[:-1].copy()
    return ids[last], count


def rarity(df: np.ndarray, n: int) -> np.ndarray:
    """The part of BM25 weights that depends on how many of ``n`` documents hold a term."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


def bm25(tf: np.ndarray, idf: np.ndarray, length, mean: float) -> np.ndarray:
    """Weights of terms that stand ``tf`` times in a text of ``length``."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def heaviest(ids: np.ndarray, value: np.ndarray, mean: float) -> list[int]:
    """A document's ``DEAL_TERMS`` terms of the largest weight; -1 where it has no more terms."""
    term, count = terms_of(ids)
    weight = bm25(count.astype(np.float32), value[term], len(ids), mean)
    out = []
    for _ in range(min(DEAL_TERMS, len(term))):
        best = int(weight.argmax())
        out.append(int(term[best]))
        weight[best] = -np.inf
    return out + [-1] * (DEAL_TERMS - len(out))


def dealer(df: np.ndarray, n: int, mean: float, least: int, number: str):
    """For ``mapInPandas``: documents with the terms by which they are dealt."""

    # Terms that ``least`` documents hold come first: a rarer one weighs less than nothing.
    value = np.where(df >= least, rarity(df, n), rarity(df, n) / 1e6 - 1e3).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [heaviest(np.frombuffer(x, number), value, mean) for x in batch["_ids"]]
            yield batch.assign(**{f"_k{i}": [k[i] for k in keys] for i in range(DEAL_TERMS)})

    return run


class Shard:
    """Inverted index of one shard's documents: for each term its documents and their BM25 weights.

    Rare terms have lists, frequent ones rows of a table, which are added up without looking
    at each document. Used documents are taken out of both when a quarter of them is used.
    """

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n: int, mean: float):
        terms, counts = zip(*map(terms_of, docs))
        self.of = np.cumsum([0, *map(len, terms)])
        term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float64)
        order = np.argsort(term, kind="stable")  # two-byte numbers are sorted in linear time
        self.term = term.astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in terms])
        weight = bm25(tf, rarity(df, n)[self.term], np.array([len(d) for d in docs])[doc], mean)
        self.list_term, self.doc, self.value = self.term[order], doc[order], weight[order]
        held = np.bincount(self.term)
        often = np.flatnonzero(held >= max(2, len(docs) / OFTEN))
        self.row = np.full(len(held), -1)
        self.row[often] = np.arange(len(often))
        # At most ``OFTEN`` places for each term of each document.
        self.column, self.table = np.arange(len(docs)), np.zeros((len(often), len(docs)))
        row = self.row[self.list_term]
        in_row = row >= 0
        self.table[row[in_row], self.doc[in_row]] = self.value[in_row]
        self.list_term, self.doc, self.value = self.list_term[~in_row], self.doc[~in_row], self.value[~in_row]
        self.unused = np.ones(len(docs), bool)
        self.left = self.last = len(docs)
        self._starts()

    def _starts(self) -> None:
        self.start = np.searchsorted(self.list_term, np.arange(int(self.term.max()) + 2))

    def use(self, doc: int) -> None:
        self.unused[doc] = False
        self.left -= 1
        if self.left < 0.75 * self.last:
            keep = self.unused[self.doc]
            self.list_term, self.doc, self.value, self.last = self.list_term[keep], self.doc[keep], self.value[keep], self.left
            keep = self.unused[self.column]
            self.column, self.table = self.column[keep], self.table[:, keep]
            self._starts()

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents by falling score for all of the seed's terms; equal scores by place."""
        term = self.term[self.of[seed] : self.of[seed + 1]]
        lo, hi = self.start[term], self.start[term + 1]
        some = hi > lo
        at = [slice(a, b) for a, b in zip(lo[some].tolist(), hi[some].tolist())]
        score = np.bincount(np.concatenate([self.doc[x] for x in at]), np.concatenate([self.value[x] for x in at]), len(self.unused)) if at else np.zeros(len(self.unused))
        row = self.row[term]
        score[self.column] += self.table[row[row >= 0]].sum(axis=0)
        left = np.flatnonzero(self.unused)
        score = score[left]
        # A window takes few: the best first, the others only if it comes to them.
        first = left if len(left) <= FIRST else left[score >= np.partition(score, len(left) - FIRST)[len(left) - FIRST]]
        place = np.searchsorted(left, first)
        yield from first[np.argsort(-score[place], kind="stable")].tolist()
        if len(first) < len(left):
            rest = np.setdiff1d(np.arange(len(left)), place, assume_unique=True)
            yield from left[rest[np.argsort(-score[rest], kind="stable")]].tolist()


def pack_shard(docs: list[np.ndarray], shard: Shard, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length), all full but the last ones.

    The longest unused document is the seed. It fills whole windows by itself; in the one
    that its rest opens its neighbours follow in falling score while there is room. One
    that doesn't fit whole is cut: its rest opens the next window, as the next seed.
    """
    order = iter(np.argsort([-len(d) for d in docs], kind="stable").tolist())
    row: list[tuple[int, int, int]] = []
    room, rest = window, None
    while True:
        if rest is None:
            seed = next((d for d in order if shard.unused[d]), None)
            if seed is None:
                break
            shard.use(seed)
            rest = (seed, 0)
        seed, start = rest
        rest = None
        while len(docs[seed]) - start >= room:
            row.append((seed, start, room))
            start += room
            yield row
            row, room = [], window
        if start < len(docs[seed]):
            row.append((seed, start, len(docs[seed]) - start))
            room -= len(docs[seed]) - start
        if not row:
            continue
        for near in shard.neighbours(seed):
            shard.use(near)
            size = len(docs[near])
            if size >= room:
                row.append((near, 0, room))
                rest = (near, room) if size > room else None
                yield row
                row, room = [], window
                break
            row.append((near, 0, size))
            room -= size
    if row:
        yield from powers(row, window)


def powers(row: list[tuple[int, int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """A shard's last, short row cut into sequences of powers of two, which need no padding."""
    left = sum(n for _, _, n in row)
    while left:
        size = min(window, 1 << (left.bit_length() - 1))
        out, room = [], size
        while room:
            doc, start, n = row[0]
            take = min(n, room)
            out.append((doc, start, take))
            row = row[1:] if take == n else [(doc, start + take, n - take), *row[1:]]
            room -= take
        yield out
        left -= size


def packer(df: np.ndarray, n: int, mean: float, window: int, number: str, most: int):
    """For ``mapInPandas`` over sorted partitions: the pieces of every window.

    A partition is one shard; where it holds more than ``most`` tokens it is cut into
    shards of neighbouring rows, each of at most ``most`` tokens or one text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        width, k = np.dtype(number).itemsize, 0
        ids, docs, held = [], [], 0
        for batch in batches:
            for i, x in zip(batch["_id"], batch["_ids"]):
                if docs and held + len(x) // width > most:
                    out = list(one(part, k, ids, docs))
                    yield from map(frame, out)
                    k = max(r[5] for r in out[-1]) - (part << 32) + 1
                    ids, docs, held = [], [], 0
                ids.append(i)
                docs.append(np.frombuffer(x, number))
                held += len(x) // width
        if docs:
            yield from map(frame, one(part, k, ids, docs))

    def one(part: int, first: int, ids: list, docs: list[np.ndarray]) -> Iterator[list[tuple]]:
        out: list[tuple] = []
        for k, row in enumerate(pack_shard(docs, Shard(docs, df, n, mean), window), first):
            at = 0
            for d, start, size in row:
                piece = docs[d][start : start + size].astype("<u4").tobytes()
                out.append((ids[d], start, size, zlib.crc32(piece), len(docs[d]), (part << 32) + k, at))
                at += size
            if len(out) > 20_000:
                yield out
                out = []
        if out:
            yield out

    def frame(out: list[tuple]) -> pd.DataFrame:
        cols = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pd.DataFrame({c: [r[i] for r in out] for i, c in enumerate(cols)})

    return run


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, end: int = 1, window: int = WINDOW, shard_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's tokens into windows so that neighbours by BM25 share one.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Null and empty texts are one ``end`` token. Documents are dealt
    by content to shards of about ``shard_tokens`` tokens, half as many more at most: they
    are sorted by their heaviest terms and the sorted table is cut, so that copies and texts
    of one topic meet, and a group larger than a shard is spread over neighbouring ones. The
    search asks a seed's own shard, with all terms of the seed: neighbours whose heaviest
    terms differ from the seed's may lie in another shard and are not found then. A shard is
    one task's work and memory, and its index holds term weights from document frequencies
    over all documents. All windows are full but a shard's last, which is cut at powers of
    two. Rows may repeat and are packed each; one text larger than a shard makes its shard
    larger. Null ids stay null. An empty table gives an empty result.

    The token ids are written in the shared folder, where the frequencies come from, and
    once more with the terms by which they are dealt: the bounds of the shards are drawn
    from these alone.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    size = max(encoder(tokenizer_path, ranks_path).size, end + 1)
    number = "<u2" if size <= 65536 else "<u4"
    tokens = rows.mapInPandas(encode(tokenizer_path, ranks_path, end, number), f"_id {kind}, _ids binary, _t long, _c long")
    tokens = written(tokens, "pack-tokens", "snappy")
    df, n, mean = document_frequencies(tokens, size)
    shards = max(1, round(n * mean / shard_tokens))
    keys = [f"_k{i}" for i in range(DEAL_TERMS)]
    whole = tokens.filter("_ids IS NOT NULL").select("_id", "_ids")
    # Terms that a fifth of a shard's documents hold at least: rarer ones tie pairs, not shards.
    dealt = whole.mapInPandas(dealer(df, n, mean, max(2, n // shards // 5), number), f"_id {kind}, _ids binary, " + ", ".join(f"{k} int" for k in keys))
    dealt = written(dealt.withColumn("_tie", F.xxhash64("_id", F.crc32("_ids"))), "pack-dealt", "snappy")
    discard(tokens)
    dealt = dealt.repartitionByRange(shards, *keys, "_tie").sortWithinPartitions(*keys, "_tie", "_id").select("_id", "_ids")
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.mapInPandas(packer(df, n, mean, window, number, shard_tokens * 3 // 2), schema).withColumnRenamed("_id", id_col)
