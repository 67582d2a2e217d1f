"""The alignment against the libraries on whole texts and a plain count of all links."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from corpuscle.llm import token_alignment
from tokenizers import Tokenizer

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, run long, part string, groups long, n_a string"


def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def letters():
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(rows):
    a, b = libraries()
    table = letters()
    groups, links = [], []
    for _, text in rows:
        made, pairs = [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
            data = (" " + text).encode()
            if b"".join(bytes_a) == data == b"".join(bytes_b):
                ends_a, ends_b = {}, {}
                for ends, tokens in ((ends_a, bytes_a), (ends_b, bytes_b)):
                    at = 0
                    for k, t in enumerate(tokens):
                        at += len(t)
                        ends[at] = k
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    x, y = ends_a[end] + 1, ends_b[end] + 1
                    made.append((ids_a[i:x], ids_b[j:y]))
                    pairs.append((ids_b[y - 1], ids_a[x - 1]))
                    i, j = x, y
        groups.append(made)
        links.append(pairs)
    counts = Counter(p for d in links for p in d)
    best = defaultdict(int)
    for (y, _), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (i, _), made, pairs in zip(rows, groups, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in made)
        out.append((i, sum(len(x) for x, _ in made), sum(len(y) for _, y in made), len(made), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, counts, best


def texts():
    draw = random.Random(11)
    bits = ["the", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", "don't", "'s", "é", "ß", "日本語", "😀", "12", "345", "...", ".", ",", "<s>", "<|endoftext|>", "<0x0A>", " ", "\x1c", " ", "foo_bar", "x" * 40, " a", " b", "ing", "</s>", "\x00", "ﬁ", "İ"]
    made = ["".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(500)]
    return [*made, *made[:60], None, "", " ", "\n", "a▁b", "▁", "word " * 30_000, "y" * 20_000, *["same hot text"] * 300]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p", 2, "z") for i, t in rows], SCHEMA)


def test_alignment_matches_the_libraries(spark):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts())]
    want, counts, best = plain(rows)
    for run_links, fan_in in ((10**6, 32), (700, 2)):
        found, pairs = token_alignment.align(table(spark, rows), A_PATH, B_PATH, run_links=run_links, fan_in=fan_in)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(map(tuple, found.collect())) == Counter(want)
        assert {(r.b, r.a): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == best[p[0]]) for p, n in counts.items()}


def test_small_tables(spark):
    for rows in ([], [(1, None)], [(1, ""), (None, "")], [(5, "a▁b")]):
        assert Counter(map(tuple, token_alignment.align(table(spark, rows), A_PATH, B_PATH)[0].collect())) == Counter(plain(rows)[0])
    ids = spark.createDataFrame([("x", "one two"), (None, "one two")], "doc_id string, text string")
    assert {r.doc_id for r in token_alignment.align(ids, A_PATH, B_PATH)[0].collect()} == {"x", None}


def test_stretches_cut_where_both_tokenizers_cut():
    a, b = libraries()
    memo = token_alignment.Stretches(A_PATH, B_PATH)
    for text in filter(None, texts()):
        if "▁" not in text:
            numbers = memo.numbers(token_alignment.cut(" " + text))
            ids_a, ids_b = [[x for n in numbers for g in memo.groups[n].split(";") for x in map(int, g.split("|")[side].split(","))] for side in (0, 1)]
            assert ids_a == a.encode(" " + text, add_special_tokens=False).ids
            assert ids_b == b.encode(text)


def test_a_stretch_is_aligned_as_its_ends_say_and_kept_flat():
    memo = token_alignment.Stretches(A_PATH, B_PATH)
    words = [" unbelievably", " étude-naïveté", "\nx²", " ﬁne", " 漢字かな", " \U0001f600!", " a1b2c3", " " + "q" * 90]
    numbers = memo.numbers(words)
    links, at = [], 0
    for w, n in zip(words, numbers):
        a, b = memo.first.encode_ordinary(w), memo.second.encode(w[1:] if w[0] == " " else w)[w[0] != " " :]
        ends = [[sum(map(len, map(of.__getitem__, ids[: k + 1]))) for k in range(len(ids))] for of, ids in ((memo.first_bytes, a), (memo.second_bytes, b))]
        exact = b"".join(map(memo.first_bytes.__getitem__, a)) == w.encode() == b"".join(map(memo.second_bytes.__getitem__, b))
        assert (memo.groups[n] is not None) == exact
        both = sorted(set(ends[0]) & set(ends[1])) if exact else []
        cuts = [([0, *(e.index(x) + 1 for x in both)]) for e in ends]
        if exact:
            assert memo.groups[n] == ";".join("|".join(",".join(map(str, ids[c[k] : c[k + 1]])) for ids, c in zip((a, b), cuts)) for k in range(len(both)))
        links += [b[ends[1].index(x)] << token_alignment.SHIFT | a[ends[0].index(x)] for x in both]
        assert memo.counts[3 * n : 3 * n + 3].tolist() == ([len(a), len(b), len(both)] if exact else [0, 0, 0])
    assert numbers == list(range(len(words))) and memo.links.tolist() == links
    assert memo.numbers(words[::-1]) == numbers[::-1] and len(memo.groups) == len(words)
