"""Alignment of two tokenizers over a corpus, with pair counts by external spill counting.

Tokens of both tokenizers that end at the same byte are linked; how often an id pair is
linked in the whole corpus says how good a link is. The records (pair, document) outgrow
any memory, so they are counted as an external sort does it:

1. A task encodes documents and spills *runs*: the records of about a million links, sorted
   by pair with the second tokenizer's id first (side-major), radix-partitioned by that id
   and compressed with zstd.
2. For each radix partition and group of runs a k-way heap merge adds up the pairs' counts;
   a second merge adds the groups'. In side-major order all pairs of one second id pass one
   after another, so its highest count is known when the next one begins.
3. Each run meets its partition's counts again and streams every document's contributions
   back, which are added up by document.

A pair, or a second id, that fills a third of all records is spread over the groups of runs
in steps 2 and 3; between them only one number for each distinct pair and group moves.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import written

#: Stretches in a run, about; radix partitions; runs merged at a time.
RUN_LINKS, PARTS, FAN_IN = 1_000_000, 64, 32
#: Stretches whose tokens a task remembers; between runs it starts anew beyond it.
MEMO = 600_000
#: A stretch: one space or line feed and what follows without white space. Both tokenizers cut there.
STRETCH = re.compile(r"[ \n]\S+")
#: The same cuts in any text: before a space or line feed between two characters that are no white space.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
SHIFT = 20


@lru_cache(maxsize=1)
def tokenizers(rank_path: str, piece_path: str):
    """The two encoders, and the bytes of every token of each."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    first = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    pieces = []
    for i in range(second.get_piece_size()):
        piece = second.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
    mark, feed = second.piece_to_id("▁"), second.encode("\n")[1:]
    if any(b"\n" in p or " " in second.id_to_piece(i) or "▁" in second.id_to_piece(i).lstrip("▁") for i, p in enumerate(pieces) if not second.is_byte(i)):
        raise ValueError("a piece crosses the places where texts are cut")
    if [mark, *feed] != second.encode("\n"):
        raise ValueError("a line feed joins the mark before it")
    return first, second, {v: k for k, v in ranks.items()}, pieces


class Stretches:
    """Tokens and links of stretches, by number: a bounded memory of what was encoded."""

    def __init__(self, rank_path: str, piece_path: str) -> None:
        self.first, self.second, self.first_bytes, self.second_bytes = tokenizers(rank_path, piece_path)
        self.first_size, self.second_size = {i: len(x) for i, x in self.first_bytes.items()}, list(map(len, self.second_bytes))
        self.first_name, self.second_name = {i: str(i) for i in self.first_bytes}, list(map(str, range(len(self.second_bytes))))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str | None] = []
        #: Three numbers for each stretch (tokens of both, groups); all stretches' links, one after another.
        self.counts, self.links = array("q"), array("q")

    def numbers(self, parts: list[str]) -> list[int]:
        """Their numbers; encodes those that are new."""
        got = list(map(self.at.get, parts))
        if None not in got:
            return got
        new = list(dict.fromkeys([p for p, n in zip(parts, got) if n is None]))
        # A stretch that starts with a space: the mark that is put before a text is that space. Else the mark is taken off.
        spaced = self.second.encode([p[1:] if p[0] == " " else p for p in new], num_threads=1)
        for p, a, b in zip(new, map(self.first.encode_ordinary, new), spaced):
            self.at[p] = len(self.groups)
            self.add(p.encode("utf-8", "replace"), a, b if p[0] == " " else b[1:])
        return list(map(self.at.__getitem__, parts))

    def add(self, data: bytes, a: list[int], b: list[int]) -> None:
        if b"".join(map(self.first_bytes.__getitem__, a)) != data or b"".join(map(self.second_bytes.__getitem__, b)) != data:
            self.groups.append(None)
            self.counts.extend((0, 0, 0))
            return
        size_a, size_b, name_a, name_b = self.first_size, self.second_size, self.first_name, self.second_name
        groups, links, rest_a, rest_b = [], [], iter(a), iter(b)
        # Both have the same bytes: their last tokens end together.
        for x in rest_a:
            y = next(rest_b)
            ahead, text_a, text_b = size_a[x] - size_b[y], name_a[x], name_b[y]
            while ahead:
                if ahead < 0:
                    x = next(rest_a)
                    ahead += size_a[x]
                    text_a += "," + name_a[x]
                else:
                    y = next(rest_b)
                    ahead -= size_b[y]
                    text_b += "," + name_b[y]
            groups.append(text_a + "|" + text_b)
            links.append(y << SHIFT | x)
        self.groups.append(";".join(groups))
        self.counts.extend((len(a), len(b), len(groups)))
        self.links.extend(links)


def cut(text: str) -> list[str]:
    """The stretches of a text that starts with the added space."""
    parts = STRETCH.findall(text)
    return parts if sum(map(len, parts)) == len(text) else CUT.split(text)


def runs_of(docs: list[list[int]], memo: Stretches, run: int) -> list[tuple]:
    """A run's rows ``part, run, pairs, totals, records``: sorted pairs, their totals, and each pair's documents with their numbers of links."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    if not lengths.sum():
        return []
    # First (document, stretch) with its count, then the stretch's links.
    code, times = np.unique(np.repeat(np.arange(len(docs)), lengths) << 32 | np.concatenate([np.asarray(d, np.int64) for d in docs if d]), return_counts=True)
    doc, stretch = code >> 32, code & 0xFFFFFFFF
    sizes, flat = np.array(memo.counts, np.int64)[2::3], np.array(memo.links, np.int64)
    starts = np.cumsum(sizes) - sizes
    many = sizes[stretch]
    at = np.repeat(starts[stretch] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    pair, doc, times = flat[at], np.repeat(doc, many), np.repeat(times, many)
    part = ((pair >> SHIFT) * 0x9E3779B1 >> 12) % PARTS
    order = np.lexsort((doc, pair, part))
    part, pair, doc, times = part[order], pair[order], doc[order], times[order]
    new = np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])] if len(pair) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    part, pair, doc, times = part[begin], pair[begin], doc[begin], np.add.reduceat(times, begin) if len(begin) else times
    out, pack = [], zstandard.ZstdCompressor(level=3)
    edges = np.searchsorted(part, np.arange(PARTS + 1))
    for p, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if hi > lo:
            first = np.flatnonzero(np.r_[True, pair[lo + 1 : hi] != pair[lo : hi - 1]])
            held = np.diff(np.r_[first, hi - lo])
            gap = np.diff(doc[lo:hi], prepend=0)
            gap[first] = doc[lo:hi][first]
            records = b"".join(x.astype(np.uint32).tobytes() for x in (held, gap, times[lo:hi]))
            pairs = np.diff(pair[lo:hi][first], prepend=0).tobytes()
            totals = np.add.reduceat(times[lo:hi], first).tobytes()
            out.append((p, run, pack.compress(pairs), pack.compress(totals), pack.compress(records)))
    return out


def encoder(rank_path: str, piece_path: str, run_links: int):
    """For ``mapInPandas`` over ``_id, _text``: rows of documents (``doc`` set) and of runs (``part`` set)."""
    whole, other = ["run", "doc", "n_a", "n_b", "n_groups", "part"], ["_id", "groups", "pairs", "totals", "records"]
    columns = ["run", "doc", "_id", "n_a", "n_b", "n_groups", "groups", "part", "pairs", "totals", "records"]

    def frame(values: list) -> pd.DataFrame:
        kinds = dict.fromkeys(whole, "Int64") | dict.fromkeys(other, object)
        return pd.DataFrame({c: pd.Series(list(v), dtype=kinds[c]) for c, v in zip(columns, values)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        memo, number = Stretches(rank_path, piece_path), TaskContext.get().partitionId() << 24
        ids, shas, held, size = [], [], [], 0

        def out() -> Iterator[pd.DataFrame]:
            nonlocal number
            counts, lengths = np.array(memo.counts, np.int64).reshape(-1, 3), np.fromiter(map(len, held), np.int64, len(held))
            sums = np.zeros((len(held) + 1, 3), np.int64)
            flat = np.concatenate([np.asarray(h, np.int64) for h in held])
            np.add.at(sums, np.repeat(np.arange(len(held)), lengths), counts[flat])
            none = [None] * len(held)
            yield frame([[number] * len(held), range(len(held)), ids, *sums[:-1].T.tolist(), shas, none, none, none, none])
            made = [list(c) for c in zip(*runs_of(held, memo, number))]
            if made:
                none = [None] * len(made[0])
                yield frame([made[1], none, none, none, none, none, none, made[0], *made[2:]])
            number += 1
            if len(memo.at) > MEMO:
                memo.clear()

        for batch in batches:
            for i, text in zip(batch["_id"], batch["_text"]):
                numbers = memo.numbers(cut(" " + text)) if text else []
                groups = [memo.groups[n] for n in numbers]
                if None in groups:
                    numbers, groups = [], []
                ids.append(i)
                shas.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                held.append(numbers)
                size += len(numbers) + 16
                if size >= run_links:
                    yield from out()
                    ids, shas, held, size = [], [], [], 0
        if ids:
            yield from out()

    return run


def entries(pairs: bytes, totals: bytes) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return np.cumsum(np.frombuffer(unpack.decompress(pairs), np.int64)), np.frombuffer(unpack.decompress(totals), np.int64)


def merged(runs: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[int, int]]:
    """Every pair of sorted runs with its count, in order: a k-way heap merge."""

    def stream(run: tuple[bytes, bytes]) -> Iterator[tuple[int, int]]:
        pairs, totals = entries(*run)
        for lo in range(0, len(pairs), 4096):
            yield from zip(pairs[lo : lo + 4096].tolist(), totals[lo : lo + 4096].tolist())

    for pair, same in groupby(heapq.merge(*map(stream, runs)), key=lambda e: e[0]):
        yield pair, sum(n for _, n in same)


def packed(pairs: list[int], counts: list[int]) -> tuple[bytes, bytes]:
    pack = zstandard.ZstdCompressor(level=3)
    return pack.compress(np.diff(np.array(pairs, np.int64), prepend=0).tobytes()), pack.compress(np.array(counts, np.int64).tobytes())


def merge_groups(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """One partial run of one radix partition and group of runs."""
    found = list(merged(zip(group["pairs"], group["totals"])))
    return pd.DataFrame([(int(key[0]), *packed([p for p, _ in found], [n for _, n in found]))], columns=["part", "pairs", "totals"])


def merge_parts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """A radix partition's final counts; negative where a pair has its second id's highest."""
    pairs, counts = [], []
    for _, side in groupby(merged(zip(group["pairs"], group["totals"])), key=lambda e: e[0] >> SHIFT):
        side = list(side)
        best = max(n for _, n in side)
        pairs += [p for p, _ in side]
        counts += [-n if n == best else n for _, n in side]
    return pd.DataFrame([(int(key[0]), *packed(pairs, counts))], columns=["part", "pairs", "totals"])


def contributions(key: tuple, runs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """What each document of a group's runs gets from one radix partition: a run's documents, their best links and summed counts."""
    unpack, pack, out = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3), []
    known, count = entries(counts["pairs"].iloc[0], counts["totals"].iloc[0])
    for row in runs.itertuples(index=False):
        pairs, totals = entries(row.pairs, row.totals)
        data = np.frombuffer(unpack.decompress(row.records), np.uint32)
        held, data = data[: len(pairs)].astype(np.int64), data[len(pairs) :].astype(np.int64)
        gap, times = data.reshape(2, -1)
        # Gaps add up within a pair.
        total = np.cumsum(gap)
        begin = np.cumsum(held) - held
        doc = total - np.repeat(total[begin] - gap[begin], held)
        of = np.repeat(count[np.searchsorted(known, pairs)], held)
        docs, at = np.unique(doc, return_inverse=True)
        sums, best = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        np.add.at(sums, at, np.abs(of) * times)
        np.add.at(best, at, np.where(of < 0, times, 0))
        out.append((row.run, *(pack.compress(x.tobytes()) for x in (docs.astype(np.uint32), best.astype(np.uint32), sums))))
    return pd.DataFrame(out, columns=["run", "docs", "best", "sums"])


def add_up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """A run's documents with the sums over all radix partitions."""
    unpack, got = zstandard.ZstdDecompressor(), []
    for row in group.itertuples(index=False):
        got.append([np.frombuffer(unpack.decompress(x), k).astype(np.int64) for x, k in ((row.docs, np.uint32), (row.best, np.uint32), (row.sums, np.int64))])
    docs, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    sums, best = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    np.add.at(best, at, np.concatenate([g[1] for g in got]))
    np.add.at(sums, at, np.concatenate([g[2] for g in got]))
    return pd.DataFrame({"run": int(key[0]), "doc": docs, "n_best": best, "count_sum": sums})


def spilled(docs: DataFrame, rank_path: str, piece_path: str, id_col: str, text_col: str, run_links: int = RUN_LINKS) -> DataFrame:
    """All documents and all runs, written: step 1."""
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = "run long, doc int, _id string, n_a long, n_b long, n_groups long, groups string, part int, pairs binary, totals binary, records binary"
    return written(rows.mapInPandas(encoder(rank_path, piece_path, run_links), schema), "align-runs")


def pair_counts(runs: DataFrame) -> DataFrame:
    """Final counts of all radix partitions, ``part, pairs, totals`` (packed), written: step 2."""
    level = runs.select("part", "grp", "pairs", "totals").groupBy("part", "grp").applyInPandas(merge_groups, "part int, pairs binary, totals binary")
    return written(level.groupBy("part").applyInPandas(merge_parts, "part int, pairs binary, totals binary"), "align-counts")


def pair_table(counts: DataFrame) -> DataFrame:
    """``a, b, n, best``: every linked id pair with its count, and whether it is its B id's highest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pairs, n = entries(row.pairs, row.totals)
                yield pd.DataFrame({"a": pairs & ((1 << SHIFT) - 1), "b": pairs >> SHIFT, "n": np.abs(n), "best": n < 0})

    return counts.select("pairs", "totals").mapInPandas(run, "a long, b long, n long, best boolean")


def align(docs: DataFrame, rank_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", run_links: int = RUN_LINKS, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """Every document's alignment figures, and the corpus's table of linked id pairs (``a, b, n, best``).

    Of the figures: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per input row. A encodes a
    space and the text, B the text (it adds the space); strings of special tokens are plain
    text. Byte offsets where tokens of both end cut them into groups; each is one link, of
    the group's last tokens. Null and empty texts, and those that either tokenizer does not
    give back byte for byte, have no tokens: zeros and an empty hash. Rows may repeat, ids
    may be null; texts of any length are encoded whole; other columns are ignored; an empty
    table gives an empty result.
    """
    table = spilled(docs, rank_path, piece_path, id_col, text_col, run_links)
    n_runs = table.filter("part IS NOT NULL").agg(F.approx_count_distinct("run")).first()[0]
    groups = max(1, -(-n_runs // fan_in))
    runs = table.filter("part IS NOT NULL").select("part", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("grp"), "run", "pairs", "totals", "records")
    counts = pair_counts(runs)
    shared = counts.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    sent = runs.groupBy("part", "grp").cogroup(shared.groupBy("part", "grp")).applyInPandas(lambda k, x, y: contributions(k, x, y) if len(x) else pd.DataFrame(columns=["run", "docs", "best", "sums"]), "run long, docs binary, best binary, sums binary")
    back = sent.groupBy("run").applyInPandas(add_up, "run long, doc int, n_best long, count_sum long")
    rows = table.filter("doc IS NOT NULL").select("run", "doc", "_id", "n_a", "n_b", "n_groups", "groups")
    joined = rows.join(back, ["run", "doc"], "left")
    none = F.lit(0).cast("long")
    out = joined.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), F.col("groups").alias("groups_sha256"))
    return out, pair_table(counts)
