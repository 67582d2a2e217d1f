"""Exact n-gram Jaccard self-join of documents by set-relation skipping, and its connected groups.

Two documents link when 100 * intersection >= 75 * union of their shingle sets.

1. Every task counts its shingles in cells of a fixed-size table; the sum gives a global
   order, rare first, ties by hash. Any order gives exact results; this one keeps shingles
   that many documents share out of the prefixes.
2. Equal sets become one node. A node's prefix (the first size - ceil(0.75 size) + 1
   shingles in the order) goes to the inverted lists. Linked sets meet in one list at least.
3. A list is sorted by blocks of sizes, each block 4/3 wide, and read once in that order:
   linked sets lie in one block or in two that follow each other, all others are skipped.
   A list of up to ``SHORT`` sets names the pairs of such sizes whose first shared shingle
   it can be: enough of both sets stands behind it, and they don't share the shingle before
   it as well. So copies that share hundreds of shingles are not named in hundreds of lists.
   A named pair whose sketches (the parity of the shingles in each of some cells) differ in
   more cells than linked sets have different shingles is ruled out. In a longer list the
   first set of a block, in one fixed order of all sets, leads the sets of its own and of
   the next block.
   So every pair that can link is in the family of one leader: of a long list's leader, of
   the smallest set that both are still paired with, or of its own smaller set.
4. A family's sets meet in one task, a large family's in blocks of bounded size, two at a
   time. There the set nearest to all others is answered first: what it shares with each.
   From that follow all other answers by the differences alone,
   |x & y| = |base| - |base - x| - |base - y| + |dx & dy| with dx, dy the two sets'
   differences from the base. Pairs never leave the task: a unit returns the links of a
   spanning forest, at most one for each of its sets.
5. Connected components of these links.

Shingles and sets are compared as 64-bit hashes. Only sets whose 64-bit numbers collide
(one pair in 2^64) would be taken for equal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.components import connected_components
from corpuscle.llm.shingles import Words
from corpuscle.session import discard, free_name, written

#: log2 of the cells of the shingle count table: a fixed size, 4 MB once scaled to bytes.
CELL_BITS, BLOCK_BITS = 22, 16
#: Shingles that a task counts together.
AT_ONCE = 4_000_000
#: Bits of the filter of nodes whose sets are needed: a fixed size, 8 MB.
NEEDED_BITS = 26
#: Prefix rows for each partition of the inverted lists.
ROWS_PER_PART = 1_500_000
#: Sets and shingles of a large family's blocks; rows of a list partition that are looked at together.
BLOCK_SETS, BLOCK_SHINGLES, CHUNK = 1024, 2_000_000, 400_000
#: Prefixes that become rows of lists at once: these rows are one Arrow batch.
PREFIXES = 500
#: Most sets in a list that names pairs.
SHORT = 16
#: Cells of a set's sketch, one bit each: as many as its shingles or up to twice that, within these powers of two.
SKETCH_BITS = (8, 14)
#: Columns of a product of differences.
COLUMNS = 4096
#: Keys over which a large component's rows are spread.
SALTS = 16
#: Most sets that can count as hot, and tasks over which the rows of each are dealt.
HOT, HOT_SALTS = 4096, 64


def merged(rows: DataFrame, how: str, size: int) -> np.ndarray:
    """Fixed-size tables of all tasks (``block, cells``) as one, added up or or-ed block by block in Spark."""

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = None
        for blob in part["cells"]:
            cells = np.frombuffer(zlib.decompress(blob), "<u4" if how == "add" else "u1")
            total = cells.astype(np.uint64 if how == "add" else np.uint8) if total is None else (total + cells if how == "add" else total | cells)
        if how == "add":  # eight steps for each doubling: all that an order needs
            total = np.minimum(255, np.floor(8 * np.log2(1.0 + total))).astype(np.uint8)
        return pd.DataFrame({"block": [key[0]], "cells": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros(size, np.uint8)
    for block, cells in rows.groupBy("block").applyInPandas(merge, "block int, cells binary").collect():
        part = np.frombuffer(zlib.decompress(cells), "u1")
        out[block * len(part) : (block + 1) * len(part)] = part
    return out


def counts(docs: DataFrame, k: int) -> np.ndarray:
    """Scaled number of documents for each cell of the shingles' hashes, over all documents.

    Only shingles that come again among the ``AT_ONCE`` that a task looks at together are
    added, so that the many that stand once in the corpus don't blur the table.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, cells = Words(), np.zeros(1 << CELL_BITS, np.uint32)
        held, size = [], 0

        def add() -> None:
            if held:
                distinct, times = np.unique(np.concatenate(held), return_counts=True)
                again = times >= 2
                np.add.at(cells, (distinct[again] >> np.uint64(64 - CELL_BITS)).astype(np.int64), times[again].astype(np.uint32))

        for batch in batches:
            for text in batch["_text"]:
                held.append(words.shingles(text, k))
                size += len(held[-1])
                if size >= AT_ONCE:
                    add()
                    held, size = [], 0
        add()
        for b, part in enumerate(cells.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield pd.DataFrame({"block": [b], "cells": [zlib.compress(part.astype("<u4").tobytes(), 1)]})

    return merged(docs.select("_text").mapInPandas(count, "block int, cells binary"), "add", 1 << CELL_BITS)


def set_number(shingles: np.ndarray) -> int:
    """A set's 64-bit number, signed; equal sets have equal numbers."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sketch(shingles: np.ndarray) -> bytes:
    """The parity of the number of shingles in each cell. Two sets differ in at least as many shingles as these differ in bits."""
    low, high = SKETCH_BITS
    width = 1 << min(max(low, (len(shingles) - 1).bit_length()), high)
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the wider one folded to the other's width."""
    if len(x) < len(y):
        x, y = y, x
    wide, bits = int.from_bytes(x, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        wide = (wide >> bits) ^ (wide & ((1 << bits) - 1))
    return (wide ^ int.from_bytes(y, "little")).bit_count()


def prefixes(docs: DataFrame, cells, k: int) -> DataFrame:
    """``_id, n, node, sketch, prefix``: each document's set size, set number, sketch and first shingles in the global order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, count = Words(), cells.value.astype(np.uint64) << np.uint64(55)
        for batch in batches:
            size, node, sketches, prefix = [], [], [], []
            for text in batch["_text"]:
                s = words.shingles(text, k)
                n = len(s)
                size.append(n)
                node.append(set_number(s))
                keep = n - (3 * n + 3) // 4 + 1 if n else 0
                key = count[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)] | (s >> np.uint64(9))
                order = np.lexsort((s, key))[:keep]
                prefix.append(s[order].tobytes())
                sketches.append(sketch(s) if n else b"")
            yield pd.DataFrame({"_id": batch["_id"], "n": size, "node": node, "sketch": sketches, "prefix": prefix})

    kind = dict(docs.dtypes)["_id"]
    return docs.mapInPandas(run, f"_id {kind}, n long, node long, sketch binary, prefix binary")


def size_blocks() -> np.ndarray:
    """First sizes of the blocks: each begins over 4/3 of the one before, so linked sets are at most one block apart."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 4 // 3 + 1)
    return np.array(edges, np.int64)


def inverted(nodes: DataFrame, parts: int) -> DataFrame:
    """``shingle, block, node, n, place, before``: each node's prefix as rows of the inverted lists; a list lies in one partition, in order.

    ``place`` is the shingle's in the prefix, ``before`` the prefix's shingle before it (of no meaning at place 0).
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = size_blocks()
        for batch in (whole.iloc[lo : lo + PREFIXES] for whole in batches for lo in range(0, len(whole), PREFIXES)):
            held = [np.frombuffer(x, "<i8") for x in batch["prefix"]]
            length = np.array([len(x) for x in held])
            if length.sum():
                block = np.searchsorted(edges, batch["n"].to_numpy(), "right")
                shingle = np.concatenate(held)
                place = np.arange(len(shingle)) - np.repeat(np.cumsum(length) - length, length)
                out = {"shingle": shingle, "block": np.repeat(block, length).astype("i2"), "node": np.repeat(batch["node"].to_numpy(), length), "n": np.repeat(batch["n"].to_numpy(), length).astype("i4")}
                yield pd.DataFrame(out | {"place": place.astype("i4"), "before": np.r_[0, shingle[:-1]]})

    out = nodes.select("node", "n", "prefix").mapInPandas(rows, "shingle long, block short, node long, n int, place int, before long")
    return out.repartition(parts, "shingle").sortWithinPartitions("shingle", "block", "node")


def list_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition of sorted lists: ``a, b, na, nb, led``.

    Short lists name the pairs (``a`` below ``b``) whose first shared shingle theirs can be.
    Linked sets share 3/7 of both sizes' sum at least, all of it from the first shared
    shingle on, and before that they have no equal one. Long lists name their leaders ``a``
    with each set ``b`` of the family (``led`` 1). Rows are looked at ``CHUNK`` at a time; of
    a list that is longer the leaders of the last two blocks are carried over, so that it
    takes bounded memory.
    """
    carry = None  # shingle, block, its leader and that one's size, leader and size of the block before (or None)
    held: list[pd.DataFrame] = []

    def short(rows: list[np.ndarray], start: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
        node, n, place, before = rows
        for m in range(2, SHORT + 1):
            first = start[length == m]
            for i in range(m - 1) if len(first) else ():
                for j in range(i + 1, m):
                    x, y = first + i, first + j
                    ok = 7 * np.minimum(n[x] - place[x], n[y] - place[y]) >= 3 * (n[x] + n[y])
                    ok &= (place[x] == 0) | (place[y] == 0) | (before[x] != before[y])
                    x, y = x[ok], y[ok]
                    x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
                    yield np.c_[node[x], node[y], n[x], n[y]]

    def long(shingle, block, node, n, carry):
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (block[1:] != block[:-1])]
        first = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        lead, size = node[first].copy(), n[first].copy()
        near = np.r_[False, (shingle[first[1:]] == shingle[first[:-1]]) & (block[first[1:]] == block[first[:-1]] + 1)]
        prev, prev_size = np.r_[0, lead[:-1]], np.r_[0, size[:-1]]
        if carry is not None and carry[0] == shingle[0]:
            if carry[1] == block[0]:
                lead[0], size[0] = carry[2], carry[3]
                if len(lead) > 1:
                    prev[1], prev_size[1] = lead[0], size[0]
                if carry[4] is not None:
                    near[0], prev[0], prev_size[0] = True, carry[4], carry[5]
            elif carry[1] + 1 == block[0]:
                near[0], prev[0], prev_size[0] = True, carry[2], carry[3]
        ok = lead[at] != node
        pairs = [np.c_[lead[at][ok], node[ok], size[at][ok], n[ok]]]
        ok = near[at] & (prev[at] != node)
        pairs.append(np.c_[prev[at][ok], node[ok], prev_size[at][ok], n[ok]])
        return pairs, (shingle[-1], block[-1], lead[-1], size[-1], prev[-1] if near[-1] else None, prev_size[-1])

    def look(rows: pd.DataFrame, carry):
        shingle, block, node, n, place, before = (rows[c].to_numpy() for c in ("shingle", "block", "node", "n", "place", "before"))
        n, block, place = n.astype(np.int64), block.astype(np.int64), place.astype(np.int64)
        start = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        length = np.diff(np.r_[start, len(shingle)])
        is_long = length > SHORT
        is_long[0] |= carry is not None and carry[0] == shingle[0]
        out = []
        pairs = [p for p in short([node, n, place, before], start[~is_long], length[~is_long]) if len(p)]
        if pairs:
            both = np.unique(np.concatenate(pairs), axis=0)
            out.append(np.c_[both, np.zeros(len(both), np.int64)])
        row = np.repeat(is_long, length)
        if row.any():
            pairs, carry = long(shingle[row], block[row], node[row], n[row], carry)
            both = np.unique(np.concatenate(pairs), axis=0)
            out.append(np.c_[both, np.ones(len(both), np.int64)])
        return out, carry

    def frames(out: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(np.concatenate(out), columns=["a", "b", "na", "nb", "led"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            rows = pd.concat(held, ignore_index=True)
            tail = int(np.searchsorted(rows["shingle"].to_numpy(), rows["shingle"].iloc[-1]))
            cut = tail if tail > 0 else len(rows)  # whole lists, or a part of one that is longer
            held = [rows.iloc[cut:]] if cut < len(rows) else []
            if cut == len(rows) and carry is None:
                carry = (rows["shingle"].iloc[0], -9, 0, 0, None, 0)  # its first part
            out, carry = look(rows.iloc[:cut], carry)
            yield from frames(out)
    if sum(map(len, held)):
        yield from frames(look(pd.concat(held, ignore_index=True), carry)[0])


def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (``a, b, na, nb`` and both sketches) that may differ in no more than a seventh of both sizes' sum, as linked sets do."""
    for batch in batches:
        apart = np.array([differing(x, y) for x, y in zip(batch["_sa"], batch["_sb"])], np.int64)
        yield batch.loc[7 * apart <= (batch["na"] + batch["nb"]).to_numpy(), ["a", "b", "na", "nb"]]


def families(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, na, nb``: leaders and sets of their families, from what the lists name and the sets' sketches; written."""
    total = written(named.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("led").alias("led")), "jaccard-named")
    led = total.filter("led = 1").select("a", "b", "na", "nb")
    pairs = total.filter("led = 0").select("a", "b", "na", "nb")
    sketches = nodes.select("node", "sketch")
    pairs = pairs.join(sketches.toDF("a", "_sa"), "a").join(sketches.toDF("b", "_sb"), "b")
    pairs = written(pairs.select("a", "b", "na", "nb", "_sa", "_sb").mapInPandas(alike, "a long, b long, na long, nb long"), "jaccard-pairs")
    # Sets with the same smallest partner meet in its family; only other pairs need one of their own.
    smallest = pairs.groupBy("b").agg(F.min(F.struct("a", "na")).alias("_x"), F.first("nb").alias("nb"))
    smallest = smallest.select("b", F.col("_x.a").alias("_l"), F.col("_x.na").alias("_n"), "nb")
    star = smallest.select(F.col("_l").alias("a"), "b", F.col("_n").alias("na"), "nb")
    left = pairs.join(smallest.select("b", F.col("_l").alias("_lb")), "b").join(smallest.select(F.col("b").alias("a"), F.col("_l").alias("_la")), "a", "left")
    left = left.filter("_lb != a AND NOT (_la <=> _lb)").select("a", "b", "na", "nb")
    out = written(led.unionByName(star).unionByName(left).distinct(), "jaccard-families")
    discard(total, pairs)
    return out


def needed_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``node, members`` (sorted shingle hashes) of the sets in ``nodes``.

    A fixed-size filter of their numbers keeps most other documents from being sent; those
    that slip through are dropped by the joins that follow.
    """
    spark = docs.sparkSession

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << NEEDED_BITS, bool)
        for batch in batches:
            bits[(batch["node"].to_numpy().view(np.uint64) >> np.uint64(64 - NEEDED_BITS)).astype(np.int64)] = True
        for b, part in enumerate(np.packbits(bits).reshape(-1, 1 << 20)):
            yield pd.DataFrame({"block": [b], "cells": [zlib.compress(part.tobytes(), 1)]})

    held = spark.sparkContext.broadcast(merged(nodes.mapInPandas(mark, "block int, cells binary"), "or", 1 << (NEEDED_BITS - 3)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, bits, seen = Words(), held.value, set()
        for batch in batches:
            out = []
            for text in batch["_text"]:
                s = words.shingles(text, k)
                node = set_number(s)
                cell = (node % (1 << 64)) >> (64 - NEEDED_BITS)
                if node not in seen and bits[cell >> 3] >> (7 - (cell & 7)) & 1:
                    out.append((node, s.tobytes()))
                    if len(seen) < 1_000_000:
                        seen.add(node)
            yield pd.DataFrame(out, columns=["node", "members"])

    sets = docs.select("_text").mapInPandas(run, "node long, members binary")
    return sets.groupBy("node").agg(F.first("members").alias("members"))


def unit_links(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of the linked sets among these."""
    n = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    if m == 2:
        x, y = sets if n[0] >= n[1] else sets[::-1]
        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
        return [(int(nodes[0]), int(nodes[1]))] if 7 * int((x[at] == y).sum()) >= 3 * int(n.sum()) else []
    start = np.cumsum(n) - n
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # The set of the smallest sum of differences from all others answers first.
    best = int(np.argmin(m * n - 2 * np.add.reduceat(times[code], start)))
    base = np.zeros(len(times), bool)
    base[code[start[best] : start[best] + n[best]]] = True
    base &= times > 1  # a shingle of one set alone plays no part in any intersection
    shared = np.add.reduceat(base[code].astype(np.int64), start)
    size = int(base.sum())
    lost = size - shared
    both = (size - lost[:, None] - lost[None, :]).astype(np.float32)
    row = np.repeat(np.arange(m), n)
    column = np.flatnonzero((times > 1) & (times < m))  # what all sets hold differs in none
    place = np.full(len(times), -1)
    place[column] = np.arange(len(column))
    at = place[code]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, len(column), COLUMNS):
        hi = min(lo + COLUMNS, len(column))
        cut = slice(*np.searchsorted(at, [lo, hi]))
        differ = np.repeat(base[column[lo:hi]][None, :], m, axis=0)
        differ[row[cut], at[cut] - lo] ^= True
        differ = differ.astype(np.float32)
        both += differ @ differ.T
    linked = 7 * both >= 3 * (n[:, None] + n[None, :])
    out, left = [], np.ones(m, bool)
    for i in range(m):
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front] = False
            out += [(int(nodes[i]), int(nodes[j])) for j in front]
    return out


def links_of_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition of units in order (``a, i, j, node, members``): their links."""
    unit, nodes, sets, out = None, [], [], []

    def done() -> None:
        if len(sets) > 1:
            out.extend(unit_links(np.array(nodes), sets))

    for batch in batches:
        for a, i, j, node, members in zip(*(batch[c] for c in ("a", "i", "j", "node", "members"))):
            if (a, i, j) != unit:
                done()
                unit, nodes, sets = (a, i, j), [], []
            nodes.append(node)
            sets.append(np.frombuffer(members, "<u8"))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    done()
    if out:
        yield pd.DataFrame(out, columns=["a", "b"])


def units(pairs: DataFrame) -> DataFrame:
    """``a, i, j, node``: families' sets, each once for every unit that it is in.

    A family is one unit up to ``BLOCK_SETS`` sets and ``BLOCK_SHINGLES`` shingles. A larger
    one is dealt to blocks of about that size, and each two of them are a unit.
    """
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_m"), F.sum("nb").alias("_w"), F.first("na").alias("_n"))
    blocks = F.greatest(F.ceil((F.col("_m") + 1) / BLOCK_SETS), F.ceil((F.col("_w") + F.col("_n")) / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("a", blocks.alias("_k"))
    large = sizes.filter("_k > 1").select(F.col("a").alias("_l"), "_k")
    members = pairs.select("a", F.col("b").alias("node")).unionByName(sizes.select("a", F.col("a").alias("node")))
    members = members.join(large, F.col("a") == F.col("_l"), "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda x: F.struct(F.least(x, F.col("_own")).alias("i"), F.greatest(x, F.col("_own")).alias("j")))
    # Two blocks together also decide what lies inside each of them.
    others = F.when(F.col("_k") > 1, F.filter(others, lambda u: u["i"] != u["j"])).otherwise(others)
    return members.withColumn("_own", own).select("a", "node", F.explode(others).alias("_u")).select("a", "_u.i", "_u.j", "node")


def near_groups(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's shingle set size and its connected group of linked documents.

    Returns ``doc_id, n_shingles, component_id, set_id, row_id``, one row per input row:
    ``component_id`` is the smallest id of the group, ``set_id`` is equal for equal sets and
    ``row_id``, null where there is no group, for all rows of a group. Null and wordless
    texts have no shingles and stay alone. Rows may repeat; rows that share an id without
    being linked keep their own groups; null ids count as larger than any other. Other
    columns are ignored. An empty table gives an empty result. No pair is lost: copies are
    joined as one set, all other pairs that can link are decided exactly.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    found, labels = labelled_rows(rows, k)
    least = labels.groupBy("_group").agg(F.min("_least").alias("component_id"))
    alone = labels.filter("NOT _linked").select("node", "_group", F.col("_least").alias("component_id"))
    salted = least.select("_group", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    many = labels.filter("_linked").withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    many = many.join(salted, ["_group", "_salt"]).select("node", "_group", "component_id")
    groups = spread_join(found.filter("n > 0").select("_id", "n", "node"), many.unionByName(alone), found)
    none = found.filter("n = 0").select("_id", "n", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("_group"), F.col("_id").alias("component_id"))
    out = groups.select(none.columns).unionByName(none)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("node").alias("set_id"),
        F.col("_group").alias("row_id"),
    )


def spread_join(rows: DataFrame, labels: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the one row of ``labels`` of their ``node``; rows of a set that very many texts have are dealt to several tasks.

    A set is hot with at least one in ``HOT`` of all rows (and 1,000), so at most ``HOT``
    sets are: these are broadcast, and only their labels are repeated under all salts.
    """
    counted = found.filter("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("_times"))
    least = max(1000, -(-found.count() // HOT))
    hot = written(counted.filter(F.col("_times") >= least).select(F.col("node").alias("_hot")), "jaccard-hot")
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.floor(F.rand(11) * HOT_SALTS)).cast("int")
    rows = rows.join(F.broadcast(hot), rows["node"] == hot["_hot"], "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(HOT_SALTS - 1)))
    labels = labels.join(F.broadcast(hot), labels["node"] == hot["_hot"], "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return rows.join(labels, ["node", "_salt"])


def labelled_rows(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Every row's set (``_id, n, node``, written), and every set's group: ``node, _least`` (id), ``_group, _linked``."""
    spark = rows.sparkSession
    cells = spark.sparkContext.broadcast(counts(rows, k))
    found = written(prefixes(rows, cells, k), "jaccard-prefixes")
    nodes = found.filter("n > 0").groupBy("node").agg(F.min("_id").alias("_least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
    total = found.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // ROWS_PER_PART) + 1)
    pairs = families(inverted(nodes, parts).mapInPandas(list_pairs, "a long, b long, na long, nb long, led long"), nodes)
    members = units(pairs)
    sets = needed_sets(rows, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), k)
    members = members.join(sets, "node").select("a", "i", "j", "node", "members")
    members = members.repartition(parts, "a", "i", "j").sortWithinPartitions("a", "i", "j")
    links = written(members.mapInPandas(links_of_units, "a long, b long"), "jaccard-links")
    groups = connected_components(links)
    discard(pairs, links)
    cells.unpersist()
    labels = nodes.select("node", "_least").join(groups, "node", "left")
    return found, labels.select("node", "_least", F.coalesce("component", "node").alias("_group"), F.col("component").isNotNull().alias("_linked"))


def drop_near_copies(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of linked documents, and all rows without words, with all their columns.

    Of a group the row with the smallest id stays (null ids last), of rows that share that id
    the text of the smallest hash, of rows that repeat both the first by the other columns.
    Rows of one id that are not linked are judged each by their own text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("x")).alias("_id"), text.alias("_text"))
    found, labels = labelled_rows(rows, k)
    own = found.filter("n > 0").groupBy("node", "_id").agg(F.count(F.lit(1)).alias("_times"))
    first = labels.groupBy("_group").agg(F.min("_least").alias("_id")).select("_id")
    keep = own.groupBy("_id").agg(F.sum("_times").alias("_times")).join(first, "_id", "left_semi")
    keep = keep.unionByName(found.filter("n = 0").select("_id", F.lit(0).cast("long").alias("_times")).distinct())
    names = [free_name(stem, docs.columns) for stem in ("_key", "_kid", "_kx", "_times")]
    key, kid, kx, times = names
    keep = keep.select(F.col("_id.id").alias(kid), F.col("_id.x").alias(kx), F.col("_times").alias(times))
    kept = docs.withColumn(key, F.xxhash64(text)).join(keep, F.col(id_col).eqNullSafe(F.col(kid)) & (F.col(key) == F.col(kx)))
    once = kept.filter(F.col(times) < 2).select(*docs.columns)
    return once.unionByName(one_of_each(kept.filter(F.col(times) > 1), docs.columns, [id_col, key]))


def one_of_each(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Of rows with equal ``keys`` the first by all ``columns`` as JSON (maps have no order of their own); combined in the map tasks first, so that many repeats of one row meet nowhere."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias(free_name("_best", columns, keys)))
    return best.select(F.col(best.columns[-1]).getField(columns[0]).alias(columns[0]), *[F.col(best.columns[-1]).getField(c).alias(c) for c in columns[1:]])
