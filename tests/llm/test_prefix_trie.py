"""The prefix trie against a plain loop over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from corpuscle.llm import prefix_trie
from corpuscle.llm.prefix_trie import ZFastTrie, fattest, prefix_names

SCHEMA = "conv_id long, turn long, role string, text string, n long, key string, depth long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)


def plain(rows):
    """Rebuilt conversations and the nodes of all their prefixes, by definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = {}
    for p, convs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in convs if len(made[c]) == len(p))
        out[min(convs), len(p)] = (
            min(members[p[:-1]]) if p else None,
            len(convs),
            len(kids[p]),
            sum(not kids[q] for q in under),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out, made


def got(nodes):
    rows = nodes.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)


def test_locate_finds_the_deepest_node():
    draw = random.Random(3)
    seqs = sorted({b"".join(bytes([draw.randrange(2)]) * 16 for _ in range(draw.randrange(1, 30))) for _ in range(300)})
    trie = ZFastTrie()
    for i in range(0, len(seqs), 37):
        trie.insert_batch([(prefix_names(s), i + j) for j, s in enumerate(seqs[i : i + 37])])
    nodes = {trie.names[x][trie.extent[x]]: x for x in range(len(trie.extent))}
    assert all(trie.end[nodes[prefix_names(s)[-1]]] == i for i, s in enumerate(seqs))
    branches = {s[: 16 * k] for a, s in zip(seqs, seqs[1:]) for k in [next((k for k in range(len(a) // 16 + 1) if a[: 16 * (k + 1)] != s[: 16 * (k + 1)]), len(a) // 16)]}
    assert set(nodes) == {prefix_names(s)[-1] for s in [*seqs, *branches, b""]}
    for _ in range(300):
        s = b"".join(bytes([draw.randrange(2)]) * 16 for _ in range(draw.randrange(30)))
        names = prefix_names(s)
        assert trie.locate(names) == nodes[next(n for n in reversed(names) if n in nodes)]


def hard(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(-3, 60), *range(100, 140), 205, 317, 318]:
        for t in range(draw.choice([1, 2, 3, 5, 9])):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "", None, "üü c"])))
    rows += [(1000 + i, t, "user", "hot") for i in range(40) for t in range(1 + i % 3)]
    rows += [(2000, t, "user", "long " * (t % 7)) for t in range(300)] + [(2001, t, "user", "long " * (t % 7)) for t in range(280)]
    return rows + [(None, 0, "user", "no one's"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (7, 1, "user", "x" * 100_000)]


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 17), (4, 60)])
def test_trie_matches_all_prefixes(spark, seed, parts):
    rows = hard(seed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        nodes = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, rows))))
        assert got(nodes) == plain(rows)[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_turn_texts_and_small_tables(spark):
    rows = hard(9)
    conversations = table(spark, rows)
    nodes = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(conversations)), range_bytes=200)
    made = plain(rows)[1]
    for r in prefix_trie.turn_texts(nodes, conversations).collect():
        assert (r.role, r.text) == (made[r.conv_id][r.depth - 1] if r.depth else (None, None))
    for few in ([], [(None, 1, "a", "b")]):
        assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, few)))).count() == 0
    for few in ([(3, None, None, None)], [(1, 0, "u", "t")], [(1, 0, "u", "t"), (100, 1, "u", "v")]):
        assert got(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, few))))) == plain(few)[0]
