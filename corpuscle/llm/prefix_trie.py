"""Prefix trie of conversations: range partitions of sorted conversations, a z-fast trie in each, shared paths merged.

A conversation is a sequence of turns, a turn is (role, text); turns are compared by a
128-bit digest. Conversations are dealt into ranges of their order (turn by turn, then by
id), so that neither one very common first turn nor many copies of one conversation meet in
one task. A task builds a z-fast trie of its range:

* compacted nodes (a node for each branching and each end) stand in a hash table at their
  *handle*: the prefix whose length is the 2-fattest number between the parent's and the
  node's own length, the one that the most powers of two divide;
* a conversation's exit node is found by fat binary search over prefix lengths, a number of
  probes logarithmic in its turns;
* conversations come in batches: all of a batch are located first, then inserted, each
  from where it was located;
* in the end edges are expanded, one row for each prefix length.

Ranges follow one order, so only prefixes of a range's first and last conversation can lie
in other ranges as well. All other nodes are complete in their task. The shared ones go out
with partial sums and are merged by their prefix's digest; there are at most twice the
turns of one conversation of them for each range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import discard, written

#: Bytes of turn digests in a range, about.
RANGE_BYTES = 32 << 20
#: Ids in a chunk of the list of conversations that end at a shared node.
CHUNK = 4096
ROOT = xxhash.xxh3_128_digest(b"root")
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE, SHARED, ENDS = 0, 1, 2
OUT = "kind int, part int, side int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, n long, kids long, leaves long, weight long, chars long, len long, ends string"


def sequences(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``conv_id, turns``: every conversation's turns in order, each a struct of its digest and code points.

    Order: null ``turn`` first, then by ``turn``; equal ones by the digest. Null role or
    text counts as empty. Rows without ``conv_id`` belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("later"),
        F.col("turn").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.char_length(text).alias("len"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("later", "turn", "digest", "len"))).alias("turns"))


def taken_turns(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its hundred: CRC-32 of the decimal id modulo 6."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns replaced by the first h of conversation c - c % 100.

    All of them if that has fewer, none if it is absent; c's own turns after its first h
    follow. h is :func:`taken_turns`.
    """
    head = seqs.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = taken_turns(F.col("conv_id"))
    own = F.slice(F.col("turns"), h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    joined = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(head, "base", "left")
    first = F.when(F.col("head").isNull() | (h == 0), F.slice(F.col("turns"), 1, 0)).otherwise(F.slice(F.col("head"), F.lit(1), h))
    return joined.select("conv_id", F.concat(first, own).alias("turns"))


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


def prefix_names(seq: bytes) -> list[bytes]:
    """128-bit names of a sequence's prefixes, from the empty one to the whole."""
    names = [ROOT]
    for i in range(0, len(seq), 16):
        names.append(xxhash.xxh3_128_digest(names[-1] + seq[i : i + 16]))
    return names


def common(a: list[bytes], b: list[bytes], low: int = 0) -> int:
    """Turns that two sequences share at their start, at least ``low``."""
    high = min(len(a), len(b)) - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid] == b[mid] else (low, mid - 1)
    return low


class ZFastTrie:
    """Compacted trie with handles. Node 0 is the root; ``end`` gives a node's own sequence."""

    def __init__(self) -> None:
        self.extent, self.parent, self.names, self.end = [0], [-1], [[ROOT]], [-1]
        self.handles: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}

    def add(self, parent: int, extent: int, names: list[bytes], end: int) -> int:
        node = len(self.extent)
        self.extent.append(extent)
        self.parent.append(parent)
        self.names.append(names)
        self.end.append(end)
        self.hang(node)
        return node

    def hang(self, node: int) -> None:
        """Enter a node at its handle and below its parent."""
        low = self.extent[self.parent[node]]
        self.handles[self.names[node][fattest(low, self.extent[node])]] = node
        self.first[self.names[node][low + 1]] = node

    def locate(self, names: list[bytes], start: int = 0) -> int:
        """The deepest node below ``start``, a prefix already, that is a prefix: fat binary search."""
        low, high = self.extent[start], len(names) - 1
        while low < high:
            probe = fattest(low, high)
            node = self.handles.get(names[probe])
            if node is None:
                high = probe - 1
            elif self.extent[node] < len(names) and self.names[node][self.extent[node]] == names[self.extent[node]]:
                start, low = node, self.extent[node]
            else:  # it leaves the trie on this node's edge
                return self.parent[node]
        return start

    def insert(self, names: list[bytes], end: int, start: int) -> None:
        """Enter a sequence from a located prefix; splits the edge on which it leaves the trie."""
        above, length = self.locate(names, start), len(names) - 1
        low = self.extent[above]
        if low == length:
            self.end[above] = end
            return
        below = self.first.get(names[low + 1])
        if below is None:
            self.add(above, length, names, end)
            return
        cut = common(self.names[below], names, low + 1)
        del self.handles[self.names[below][fattest(low, self.extent[below])]]
        inner = self.add(above, cut, self.names[below], end if cut == length else -1)
        self.parent[below] = inner
        self.hang(below)
        if cut < length:
            self.add(inner, length, names, end)

    def insert_batch(self, batch: list[tuple[list[bytes], int]]) -> None:
        """Locate all of a batch in the trie as it is, then insert one after another."""
        for (names, end), start in zip(batch, [self.locate(names) for names, _ in batch]):
            self.insert(names, end, start)


def digest_ids(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def expanded(part: int, trie: ZFastTrie, ids: list[list[int]], lens: list, paths: list[int]) -> Iterator[tuple]:
    """Rows of ``OUT`` for a range's trie. ``paths``: its first and last sequence, whose prefixes are shared."""
    size = len(trie.extent)
    members, least, weight, chars, kids, leaves = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [0] * size
    whole = [0] * size  # members of a subtree's nodes that lie on no path: their children of a path's node
    sequence = [-1] * size
    shared = [0] * size
    ends = [trie.end[x] for x in range(size)]
    path_names = [None] * 2
    for x in range(size):
        if ends[x] in paths:
            for side, p in enumerate(paths):
                if ends[x] == p:
                    path_names[side] = trie.names[x]
    order = sorted(range(size), key=trie.extent.__getitem__)
    for x in order[1:]:
        up = trie.parent[x]
        low = trie.extent[up]
        if shared[up] == low:
            reach = max(min(common(trie.names[x], p), trie.extent[x]) for p in path_names)
            shared[x] = max(low, reach)
    made: dict[bytes, list] = {}
    parents: list[tuple] = []
    for x in reversed(order):
        own = ids[ends[x]] if ends[x] >= 0 else []
        members[x] += len(own)
        if own and (least[x] is None or own[0] < least[x]):
            least[x] = own[0]
        if sequence[x] < 0:
            sequence[x] = ends[x]
        n, of, names = members[x], lens[sequence[x]], trie.names[x]
        up = trie.parent[x]
        low = trie.extent[up] if up >= 0 else -1
        w, c, k, leaf = weight[x], chars[x], kids[x], leaves[x]
        on_path = whole[x]
        for d in range(trie.extent[x], low, -1):
            ends_here = own if d == trie.extent[x] else []
            length = int(of[d - 1]) if d else 0
            w += n * length
            if d > shared[x]:
                c += length
                leaf = leaf if k else 1
                parent_key = names[d - 1] if d - 1 <= shared[x] and (d - 1 > low or shared[up] == low) else None
                sha = digest_ids(ends_here) if ends_here else NO_ENDS
                row = (NODE, part, None, d, None, parent_key, least[x], None, n, k, leaf, w - c, None, None, sha)
                if parent_key is None and d - 1 == low:
                    parents.append((row, up))
                else:
                    yield row if parent_key is not None else (*row[:7], least[x], *row[8:])
                k = on_path = 1
            else:
                made[names[d]] = [d, names[d], names[d - 1] if d else None, least[x], n, on_path, leaf, w, c, length]
                for i in range(0, len(ends_here), CHUNK):
                    chunk = ends_here[i : i + CHUNK]
                    yield (ENDS, part, None, d, names[d], None, chunk[0], None, None, None, None, None, None, None, ",".join(map(str, chunk)))
                k, on_path = 1, 0
        if up >= 0:
            members[up] += n
            if least[up] is None or least[x] < least[up]:
                least[up] = least[x]
            if sequence[up] < 0:
                sequence[up] = sequence[x]
            weight[up] += w
            chars[up] += c
            kids[up] += 1
            leaves[up] += leaf
            whole[up] += shared[x] == low
    for row, up in parents:
        yield (*row[:7], least[up], *row[8:])
    seen: set[bytes] = set()
    for side, names in enumerate(path_names):
        for name in names:
            d, key, parent_key, conv, *sums, length = made[name]
            yield (SHARED, part, side, d, key, parent_key, conv, None, *([0] * 5 if name in seen else sums), length, None)
        seen.update(names)


def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For ``mapInPandas`` over a sorted range of ``conv_id, seq, lens``: the rows of its trie."""
    from pyspark import TaskContext

    part, trie, ids, lens, last = TaskContext.get().partitionId(), ZFastTrie(), [], [], None
    for batch in batches:
        fresh = []
        for conv, seq, of in zip(batch["conv_id"], batch["seq"], batch["lens"]):
            if seq != last:
                fresh.append((prefix_names(seq), len(ids)))
                ids.append([])
                lens.append(of)
                last = seq
            ids[-1].append(int(conv))
        trie.insert_batch(fresh)
    if not ids:
        return
    columns, rows = [c.split()[0] for c in OUT.split(",")], []
    for row in expanded(part, trie, ids, lens, [0, len(ids) - 1]):
        rows.append(row)
        if len(rows) == 20_000:
            yield frame(rows, columns)
            rows = []
    yield frame(rows, columns)


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    whole = [c for c in columns if c not in ("key", "parent_key", "ends")]
    return out.astype(dict.fromkeys(whole, "Int64"))


def hashed_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For ``mapInPandas`` over chunks sorted by node and first id: each node's SHA-256, chunk after chunk."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, ends in zip(batch["key"], batch["ends"]):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def merged_paths(rows: DataFrame) -> DataFrame:
    """The shared nodes of all ranges: ``key, parent_key`` and the columns of a node.

    A shared node's own code points and its leaf count once, through the first range that
    has it: along each range's path, what the range owns is summed from the end upwards.
    """
    shared = rows.filter(F.col("kind") == SHARED)
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "weight", "chars")]
    nodes = shared.groupBy("key").agg(F.first("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("len").alias("len"), F.min(F.struct("part", "side")).alias("owner"), *sums)
    below = nodes.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(below, "key", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = nodes.withColumn("leaf", (F.col("kids") == 0).cast("long"))
    owned = F.col("owner") == F.struct("part", "side")
    path = shared.select("key", "part", "side", "depth").join(nodes.select("key", "owner", "leaf", "len"), "key")
    upwards = Window.partitionBy("part", "side").orderBy(F.col("depth").desc())
    path = path.select("key", *[F.sum(F.when(owned, F.col(c)).otherwise(0)).over(upwards).alias(f"own_{c}") for c in ("leaf", "len")])
    path = path.groupBy("key").agg(F.sum("own_leaf").alias("own_leaf"), F.sum("own_len").alias("own_len"))
    chunks = rows.filter(F.col("kind") == ENDS).select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = chunks.select("key", "ends").mapInPandas(hashed_ends, "key binary, ends_sha256 string")
    whole = nodes.join(path, "key").join(ends, "key", "left")
    return whole.select(
        "key",
        "parent_key",
        "conv_id",
        "depth",
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        (F.col("leaves") + F.col("own_leaf")).alias("n_leaves"),
        (F.col("weight") - F.col("chars") - F.col("own_len")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(seqs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The trie of ``conv_id, turns`` (as :func:`sequences` gives them): one row for each distinct prefix.

    Returns ``conv_id`` (the smallest conversation that starts with the node's turns),
    ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (over the node's subtree, for each node its conversations
    but one times the code points of its last turn) and ``ends_sha256`` (SHA-256 of the ids
    that end at the node, ascending, joined by commas). Conversations without turns end at
    the root. Without any conversation there is no node.

    A conversation is one row of digests (16 bytes a turn), whatever its texts' length.
    """
    spark = seqs.sparkSession
    turns = F.transform("turns", lambda t: t["digest"])
    table = written(seqs.select("conv_id", F.unhex(F.array_join(turns, "")).alias("seq"), F.transform("turns", lambda t: t["len"].cast("int")).alias("lens")), "trie-sequences")
    size = table.agg(F.sum(F.octet_length("seq") + 16)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes + 1)
    ranges = table.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    rows = written(ranges.mapInPandas(grow, OUT), "trie-nodes")
    discard(table)
    shared = written(merged_paths(rows), "trie-shared")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = rows.filter(F.col("kind") == NODE).select(
        "part", "parent_key", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("weight").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )
    names = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    # Children of a shared node find it by its range as well, so that a node with very many children is no single key.
    here = rows.filter(F.col("kind") == SHARED).select("part", F.col("key").alias("parent_key")).distinct().join(names, "parent_key")
    hung = found.filter("parent_key IS NOT NULL").join(here, ["part", "parent_key"]).withColumn("parent_conv_id", F.col("up"))
    whole = shared.join(names, "parent_key", "left").withColumn("parent_conv_id", F.col("up"))
    return found.filter("parent_key IS NULL").select(columns).unionByName(hung.select(columns)).unionByName(whole.select(columns))


def turn_texts(nodes: DataFrame, conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of each node's last turn, null at the root."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("of"), "turn", role.alias("role"), text.alias("text"))
    digest = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("of").orderBy(F.col("turn").asc_nulls_first(), digest)).cast("long")).drop("turn")
    of, at = F.col("conv_id"), F.col("depth")
    if rebuild:
        base, h = F.col("conv_id") - F.col("conv_id") % 100, taken_turns(F.col("conv_id"))
        counts = rows.filter((F.col("of") % 100 == 0) & (F.col("at") <= 5)).groupBy(F.col("of").alias("base")).agg(F.count(F.lit(1)).alias("have"))
        nodes = nodes.withColumn("base", base).join(counts, "base", "left").withColumn("took", F.least(h.cast("long"), F.coalesce("have", F.lit(0))))
        first = F.col("depth") <= F.col("took")
        of, at = F.when(first, F.col("base")).otherwise(F.col("conv_id")), F.when(first, F.col("depth")).otherwise(F.col("depth") - F.col("took") + h)
    marked = nodes.withColumns({"of": of, "at": at.cast("long")})
    return marked.join(rows, ["of", "at"], "left").drop("of", "at", "base", "have", "took")
