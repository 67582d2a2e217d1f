import hashlib
from datetime import date
from decimal import Decimal

import xxhash
from corpuscle.llm import order_minhash as om

SCHEMA = "doc_id long, text string, _range string"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def brute(text):
    """The fingerprint by its definition: one pass over a Python list."""
    words = "".join(f" {c} " if 0x2E80 <= ord(c) <= 0xD7FF or ord(c) >= 0xF900 else c for c in text).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    k = om.K
    kmers = [] if not h else [hash_longs(h)] if len(h) < k else [hash_longs(h[i : i + k]) for i in range(len(h) - k + 1)]
    seen, best = {}, {}
    for pos, x in enumerate(kmers):
        seen[x] = seen.get(x, 0) + 1
        v = xxhash.xxh64_intdigest(seen[x].to_bytes(4, "little"), hash_longs([x]))
        slot = signed(v) % om.SKETCHES, (v >> 40) % om.PER_SKETCH
        if slot not in best or signed(v) < signed(best[slot][0]):
            best[slot] = v, pos
    out = []
    for s in range(om.SKETCHES):
        chosen = sorted((best[s, j][1], best[s, j][0]) for j in range(om.PER_SKETCH) if (s, j) in best)
        out.append(f"{hash_longs([v for _, v in chosen]):016x}" if chosen else "-")
    return "".join(out) if any(x != "-" for x in out) else ""


def test_matches_brute_force_and_orders_rows(spark):
    texts = ["", None, "one two", "a b c d e f g " * 30, "naïve café ünïcode wörter " * 9, "  \n\t ", "x", "a b c d e f g " * 30]
    texts += ["吾輩は猫である。名前はまだ無い。" * 3, "吾輩は猫である、名前はまだ無い。" * 3 + "mixed 𠀀𠀁🙂 words", "\ue000 private x"]
    texts += [" ".join(f"w{(i * j) % 97}" for j in range(i)) for i in range(5, 60, 6)]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in om.fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after = plain[i - 1] if i else plain[-1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute(t) and r.edited_fingerprint == brute(edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[3].fingerprint == got[7].fingerprint
    assert got[0].fingerprint == "" and got[1].near_next == 1.0  # null beside empty


def test_ranges_nulls_and_repeats(spark):
    rows = [(i, f"text number {i} with several words in it", "x") for i in range(0, 50, 2)] + [(4, "text number 4 with several words in it", None), (None, "no id here at all", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = om.beside_next(docs, rows_per_range=3).filter("NOT _guest").collect()
    assert len(got) == len(rows)
    order = {r._id: r._next for r in got}
    assert order[48] == "text number 46 with several words in it" and order[2] == "text number 0 with several words in it"
    assert om.fingerprint_edits(docs).count() == len(rows)
    assert om.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    one = om.fingerprint_edits(spark.createDataFrame([(1, "a b c", "x")], SCHEMA)).first()
    assert one.near_next == 1.0


def test_likeness_follows_edits(spark):
    base = " ".join(f"word{i}" for i in range(400))
    swapped = " ".join([*base.split()[200:], *base.split()[:200]])
    shuffled = " ".join(sorted(base.split(), key=lambda w: hashlib.md5(w.encode()).hexdigest()))
    rows = spark.createDataFrame([(1, base + " tail"), (2, base), (3, swapped), (4, shuffled)], "k int, text string")
    prints = {r.k: r.fingerprint for r in om.sketches(rows.repartition("k"), ["k"]).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(prints[a], prints[b])) / om.SKETCHES
    assert like(1, 2) > 0.8 > like(2, 3) > like(2, 4) == 0


def test_ids_at_both_ends_of_a_long(spark):
    rows = [(-(2**63), "one two three four five six"), (2**63 - 1, "six five four three two one"), (0, "a b c d e f")]
    got = {r.doc_id: r for r in om.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == sorted(i for i, _ in rows)
    text = dict(rows)
    for i, after in ((2**63 - 1, 0), (0, -(2**63)), (-(2**63), 2**63 - 1)):
        third = len(text[i]) // 3
        edited = text[i][: len(text[i]) - third] + text[after][:third]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_texts_without_spaces_keep_their_likeness(spark):
    base = "".join(chr(0x4E00 + (i * i * 7) % 900) for i in range(160))
    other = "".join(chr(0x3041 + (i * i * 5) % 80) for i in range(160))
    rows = spark.createDataFrame([(3, base + "。"), (2, base[:80] + "、" + base[80:]), (1, other)], "doc_id long, text string")
    got = {r.doc_id: r for r in om.fingerprint_edits(rows).collect()}
    assert got[3].near_next > 0.7 and got[3].fingerprint != got[2].fingerprint and got[2].near_next == 0


def test_ids_of_other_types_come_back(spark):
    texts = [f"words of text {i} and some more of them" for i in range(6)]
    for kind, ids in (("string", ["b", "a,\"x'", "", "fourteen digits or more ü", None, "b"]), ("decimal(20,2)", [None, *map(Decimal, ("1.50", "-3.25", "7.00", "99999999999.01", "0.00"))]), ("date", [date(2020, 1, d) for d in range(1, 7)])):
        rows = list(zip(ids, texts))
        got = om.fingerprint_edits(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
        least = (False, ids[1]) if kind != "string" else (False, "")
        order = sorted(rows, key=lambda r: ((r[0] is not None, r[0] if r[0] is not None else least[1]), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
        after = {order[j]: order[(j + 1) % len(order)][1] for j in range(len(order))}
        want = sorted(repr((i, hashlib.sha256((t[: len(t) - len(t) // 3] + after[i, t][: len(t) // 3]).encode()).hexdigest())) for i, t in rows)
        assert sorted(repr((r.doc_id, r.edited_sha256)) for r in got) == want


def test_ranges_follow_clustered_and_repeated_ids(spark):
    """One far id, and one id (or none) on half of the rows: ranges stay even."""
    rows = [(i, f"text {i}") for i in range(2000)] + [(None, f"none {i}") for i in range(2000)] + [(2**62, "far"), (-(2**62), "far below")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = om.beside_next(docs, rows_per_range=100)
    sizes = [r["count"] for r in ranges.filter("NOT _guest").groupBy("_range").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 400
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
    want = {t: order[(j + 1) % len(order)][1] for j, (_, t) in enumerate(order)}
    assert {r._text: r._next for r in ranges.filter("NOT _guest").collect()} == want


def test_very_long_text_is_read_whole(spark):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(2, long_text), (1, long_text + " end")]
    got = {r.doc_id: r for r in om.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].n_chars == len(long_text) and got[2].fingerprint == brute(long_text) and got[1].fingerprint == brute(long_text + " end")
    assert got[2].near_next > 0.9
