import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpuscle.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, start long"


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    import random

    rng = random.Random(4)
    parts = [" ", "  ", "   ", "\n", "\n\n", "\t", "\u00a0", "\u3000", "\r\n", "a", "Word", "don't", "'s", " 'll", "naïve", "№7", "12", "!!", "日本語", "😀", "<|endoftext|>", "_", "x'RE", "\u200b", "é", "e\u0301", "\x00", "\x85", "\u2028"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 12))) for _ in range(4000)] + ["hi <|endoftext|> there", "", " ", "a ", " a"]
    found = packing.Encoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for lo in range(0, len(texts), 100):
        for text, got, want in zip(texts[lo:], found.all(texts[lo : lo + 100]), ids_of(texts[lo : lo + 100])):
            assert np.frombuffer(got, found.number).tolist() == want[:-1], repr(text)


@pytest.mark.parametrize("ranks", [None, public_tokenizers.path("byte_bpe_50k.tiktoken")])
def test_every_id_lies_in_one_piece_and_windows_hold_2048(spark, ranks):
    long = "The quick brown fox jumps over the lazy dog, says naïve Ödön №7.  \n\n" * 600
    rows = [(i, f"document {i} about topic {i % 3} and more " * (1 + i % 40), "en", 5) for i in range(120)]
    rows += [(200, None, None, None), (201, "", "x", 1), (202, long, "x", 1), (None, "no id", None, None), (5, "again", "x", 1), (5, "again", "x", 1), (203, "<|endoftext|> don't  ▁", "x", 1)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, ranks, shard_tokens=9000).collect()
    want = defaultdict(list)
    for r, ids in zip(rows, ids_of([r[1] or "" for r in rows])):
        want[r[0]].append(ids)
    pieces = defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
    assert set(pieces) == set(want)
    for doc, all_ids in want.items():
        assert sum(p.length for p in pieces[doc]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for p in sorted(pieces[doc], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(all_ids[0])
                assert p.ids_crc32 == zlib.crc32(np.array(all_ids[0][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(all_ids[0])
    rows_of = defaultdict(list)
    for p in got:
        rows_of[p.sequence_id].append(p)
    padding = 0
    for row in rows_of.values():
        at = 0
        for p in sorted(row, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_neighbours_rank_as_brute_force_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, rng.integers(1, 60)).astype("<u4") for _ in range(40)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50)
    mean = np.mean([len(d) for d in docs])
    shard = packing.Shard(docs, df, len(docs), mean)

    def weight(t, d):
        tf = (docs[d] == t).sum()
        idf = np.log1p((40 - df[t] + 0.5) / (df[t] + 0.5))
        return idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(docs[d]) / mean))

    terms = sorted(set(docs[3].tolist()), key=lambda t: -weight(t, 3))
    scores = [sum(weight(t, d) for t in terms) for d in range(40)]
    got = list(shard.neighbours(3))
    assert np.allclose([scores[d] for d in got], sorted(scores, reverse=True))


def test_all_terms_of_a_seed_score():
    # The neighbour shares the seed's 30 lightest terms, the stranger one of its heaviest.
    seed = np.repeat(np.arange(60), np.r_[np.full(30, 3), np.full(30, 1)]).astype("<u4")
    docs = [seed, np.r_[0, np.full(29, 90)].astype("<u4"), np.arange(30, 60).astype("<u4")]
    df = np.full(100, 2)
    assert next(d for d in packing.Shard(docs, df, 1000, 40.0).neighbours(0) if d) == 2


def test_related_texts_meet_in_bounded_shards(spark):
    rng = np.random.default_rng(2)
    words = [[f"w{t}x{i}" for i in range(40)] for t in range(12)]
    rows = [(i, " ".join(rng.choice(words[i % 12], 60)), "en", 0) for i in range(240)]
    # One group larger than a shard: it must be spread, not gathered.
    rows += [(1000 + i, "the same text " * 40, "en", 0) for i in range(120)]
    sizes = dict(zip([r[0] for r in rows], map(len, ids_of([r[1] for r in rows]))))
    shard = sum(sizes.values()) // 24
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, shard_tokens=shard).collect()
    shards = defaultdict(set)
    for p in got:
        shards[p.sequence_id >> 32].add(p.doc_id)
    assert max(sum(sizes[d] for d in held) for held in shards.values()) <= 3 * shard and len(shards) > 12
    topic = {d: no for no, held in shards.items() for d in held if d < 240}
    met = [topic[a] == topic[b] for a in topic for b in topic if a < b and a % 12 == b % 12]
    assert sum(met) > 0.3 * len(met)  # by hash: about one in 24


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_frequent_terms_are_rows_and_scores_are_whole():
    """Neighbours as the weights of all terms give them, frequent and rare, also when documents have left; few places are left to lists."""
    rng = np.random.default_rng(8)
    docs = [np.r_[rng.integers(0, 12, 30), rng.integers(12, 400, 25)].astype("<u2") for _ in range(90)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400)
    mean = 55.0
    shard = packing.Shard(docs, df, len(docs), mean)
    assert len(shard.doc) < 0.75 * len(shard.term)
    weight = np.zeros((len(docs), 400))
    for d, ids in enumerate(docs):
        term, count = np.unique(ids, return_counts=True)
        weight[d, term] = packing.bm25(count.astype(float), packing.rarity(df, len(docs))[term], len(ids), mean)
    used = set()
    for seed in rng.permutation(90)[:60].tolist():
        shard.use(seed) if seed not in used else None
        used.add(seed)
        score = weight[:, np.unique(docs[seed])].sum(axis=1)
        got = list(shard.neighbours(seed))
        assert sorted(got) == sorted(set(range(90)) - used) and np.all(np.diff(score[got]) <= 1e-9)
