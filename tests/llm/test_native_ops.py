"""Exact dedup, mixing, license scans, url filters, token counts and the Jaccard join on small hard cases."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from corpuscle.llm import exact_dedup, jaccard_join, license_scan, mixing, token_count, url_filter
from tokenizers import Tokenizer, models

SCHEMA = "doc_id long, text string, source string, size long, keep_id string, label string, n long"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, "x", None, 7) for i, t, s in rows], SCHEMA)


HARD = [(1, "same", "a"), (2, "same", "a"), (2, "same", "a"), (3, None, None), (4, "", "b"), (None, "same", "b"), (None, "alone", None), (5, "word " * 50_000, "a")]


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark, HARD), salts=3).collect()
    assert len(got) == len(HARD)
    groups = defaultdict(list)
    for i, t, _ in HARD:
        groups[t or ""].append(i)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(groups[text])
        assert r.keep_id == max((i for i in groups[text] if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    kept = exact_dedup.drop_exact_copies(docs(spark, HARD))
    assert kept.columns == docs(spark, HARD).columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter({(2, "same"): 1, (4, ""): 1, (None, "alone"): 1, (5, "word " * 50_000): 1})
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_mixing_meets_targets_and_only_adds(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 5}") for i in range(300)] + HARD[:7]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    per = defaultdict(list)
    for r in got:
        per[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in per.values()) - 1.5 * total) < 1e-6
    for v in per.values():
        assert sum(r.size for r in v) == v[0].source_size
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v) / 2 + 1e-9 or len({r.doc_id for r in v}) < len(v)
    more = mixing.mix_sources(docs(spark, rows), share=1.2).collect()
    small, large = Counter(), Counter()
    for r in more:
        small[r.doc_id, r.source, r.size] += r.taken
    for r in got:
        large[r.doc_id, r.source, r.size] += r.taken
    assert all(small[k] <= large[k] or k[1] not in per for k in small if next(m.target for m in more if m.source == k[1]) <= per[k[1]][0].target)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    twice = mixing.repeat_mixed(docs(spark, [(1, "a b c", "only")]))
    assert twice.columns == docs(spark, []).columns and twice.count() in (1, 2)


def test_license_scan_matches_brute_force(spark):
    import random
    import re

    rng = random.Random(9)
    texts = [None, "", "All  rights\nreserved. all rights reserved", "Licensed under the Apache License, Version 2.0.", "under licensed apache the license 2 version 0", "CC BY-NC 4.0 cc by: ok", "General Public License é all rights", "x " * 20_000 + "cc by", "released under the MIT"]
    for _, template in license_scan.TEMPLATES:
        words = template.split()
        whole = " ".join(words[:9]) + ", filler\n" + " ".join(words[9:])
        texts += [whole.title(), whole, whole, "a lot of " * 60 + whole + " the end" * 90]  # repeated rows, and a notice amid long text
        for share in (0.1, 0.2, 0.3):  # words left out, in another order, with others between them
            kept = [w for w in words if rng.random() > share]
            rng.shuffle(kept)
            texts.append(" ".join(w + rng.choice(["", " filler", " the", " of software"]) for w in kept))
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    matched = set()
    for i, t in enumerate(texts):
        low = (t or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))
        words = [w for w in re.split(license_scan.SEPARATORS, low) if w]
        places = sorted((k, label) for label, p in license_scan.PHRASES for k in range(len(words)) if tuple(words[k : k + len(p)]) == p)
        best, found = 0.0, set()
        for label, template in license_scan.TEMPLATES:
            t_words = set(template.split())
            width = license_scan.SPREAD * len(t_words)
            share = max((len(t_words.intersection(words[k : k + width])) for k in range(max(len(words) - width, 0) + 1)), default=0) / len(t_words)
            if share >= license_scan.THRESHOLD:
                best, found = max(best, share), found | {label}
        matched |= found
        r = got[i]
        base = {label for _, label in places}
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | found)), (i, t)
        assert abs(r.score - (1.0 if places else best)) < 1e-12
    assert matched == {label for label, _ in license_scan.TEMPLATES}
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


def test_license_windows_cross_lines_and_are_bounded(spark):
    wrapped = {
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
        "mit": "word\n" * 50 + "This is released under the\nMIT license.\n" + "more\n" * 50,
        "apache": "x " * 7 + "Licensed under\nthe Apache\nLicense, Version\n2.0",
    }
    filler = " filler" * 40 + " "
    scattered = [filler.join(["all", "rights", "reserved"]), filler.join("released under the mit license".split()), "all rights x x x x reserved", "all x rights x x reserved"]
    texts = [*wrapped.values(), *scattered]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == [*wrapped, "", "", "", "reserved"]


def test_url_filter(spark):
    urls = ["http://WWW.example.com/en/1", "https://example.com/en/2?utm_source=x", "http://m.example.com/de/2.html", "https://a.net/es/?ref=1", "http://a.net/de/9/", "http://www.a.net/de/9?gclid=1&b=2&a=1", "https://a.net/de/9?a=1&b=2#f", "nonsense", None, "", "x://", "http://net/fr/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.campaign_urls(pages)).collect()}
    assert [got[i].rule for i in range(12)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, None, None, None, "net/fr/"]
    assert [got[i].verdict for i in range(12)] == ["allow", "block", "allow", "block", "allow", "block", "block", "allow", "allow", "allow", "allow", "block"]
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)], "_key string")
    rows = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 3)], "x string")
    assert {r.x for r in url_filter.listed_urls(rows, keys, "x").filter("_listed").collect()} == {f"k{i}" for i in range(0, 500, 3)}
    assert url_filter.judge_urls(pages.limit(0), pages.limit(0).select("url")).count() == 0


def test_token_counts_equal_a_unigram_tokenizer(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = [("<unk>", 0.0)] + [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    reference = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    texts = ["Hello world, this is a test", "  two  spaces\nnew line\t tab ", "naïve 日本語 ☃ €5", "aaaaaaaaaaaaa", "▁mark", "ñ" * 50, "x", "the " * 3000, None, ""]
    got = {r.doc_id: r for r in token_count.count_tokens(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), PIECES).collect()}
    for i, t in enumerate(texts):
        want = spare = 0
        for id_, piece in zip(*(lambda e: (e.ids, e.tokens))(reference.encode("▁" + t.replace(" ", "▁")))) if t else []:
            size = len(piece.encode()) if id_ == 0 else 1
            want, spare = want + size, spare + (size if id_ == 0 else 0)
        assert (got[i].n_tokens, got[i].n_fallback) == (want, spare), t
    assert token_count.count_tokens(docs(spark, []), PIECES).count() == 0


def brute_groups(rows, k=5):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return Counter((i, len(s), least.get(find(a))) for a, ((i, _, _), s) in enumerate(zip(rows, sets)))


def test_jaccard_groups_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=80) for _ in range(4)]
    rows = [(1000, None, "a"), (1001, "", "a"), (1002, "one two", "a"), (1003, "ONE  two", "a"), (1004, "one two three", "a"), (None, "one two", "b")]
    for i in range(160):
        w = list(base[i % 4])
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        if i % 5 == 0:
            w += base[(i + 1) % 4][:40]
        rows.append((i, " ".join(w), "s"))
    got = jaccard_join.near_groups(docs(spark, rows).repartition(3)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)
    assert jaccard_join.near_groups(docs(spark, [])).count() == 0


def test_license_sql_matches_windows(spark):
    import duckdb
    from corpuscle.llm import license_scan
    from corpuscle.llm.sql import SQL

    texts = [
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
        "released under the\nMIT license",
        "all " + "word " * 40 + "rights " + "word " * 40 + "reserved released " + "x " * 30 + "under the mit license",
        "All rights\nreserved. CC BY",
        "all rights x y reserved",
        "the license the license mit released under",
        "",
        None,
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cur = con.execute(SQL["op4_license_scan"])
    names = [c[0] for c in cur.description]
    want = {r[0]: r for r in cur.fetchall()}
    assert len(got) == len(want) == len(rows)
    for r in got:
        assert tuple(r[n] for n in names) == want[r.doc_id]
    assert want[0][names.index("labels")] == "bsd" and want[2][names.index("labels")] == ""


def test_dropping_copies_takes_columns_of_map_type(spark):
    rows = [(1, "same text of five words", {"a": "x"}), (2, "same text of five words", {"b": None}), (2, "same text of five words", {"a": "y"}), (3, None, None), (3, "", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,string>")
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, "same text of five words"), (3, "")]
    near = jaccard_join.drop_near_copies(docs)
    assert near.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in near.collect()) == [(1, "same text of five words"), (3, ""), (3, "")]
