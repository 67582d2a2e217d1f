"""Secret scans against a plain loop, and what a second scan reads."""

import hashlib
import random
import re
from collections import Counter

from corpuscle.llm import secret_scan
from corpuscle.llm.secret_scan import RULES, Rule
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, path string, blob string, rules long, spans long, missing string"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    text = text or ""
    base = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base))


def texts():
    draw = random.Random(5)
    bits = ["token", "Secret", "API_KEY", "apikey", "PASSWORD", "passwd", ": ", "=", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "deadbeef", "é", "\n", "abcdefghijkl", "𝒳", "x", "toKen", "ſecret=abcdefghijklmnop", "token: password: abcdefghijklmn"]
    made = ["".join(draw.choice(bits) for _ in range(draw.randrange(25))) for _ in range(400)]
    return [*made, *made[:50], None, "", "word " * 60_000 + "token=abcdefghijklmnop", "f" * 200_000]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "p", "b", 1, 2, "m") for i, t in rows], SCHEMA)


def test_findings_match_a_loop(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts())] + [(3, "secret = abcdefghijklmnop")] * 3
    found, new = secret_scan.scan_secrets(table(spark, rows))
    got = found.collect()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter((i, hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows)
    want = {hashlib.sha256((t or "").encode()).hexdigest().upper(): plain(t) for _, t in rows}
    for r in got:
        base = want[r.blob]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == [s for s in base.split(",") if s]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k + ":") for k in ("assign", "access", "hex"))
    assert new.count() == len(want) == new.select("blob").distinct().count()
    assert secret_scan.scan_secrets(table(spark, []))[0].count() == 0


def test_added_kinds(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    rows = [(1, "a " + key), (2, "ghp_" + "A1" * 18), (3, "xoxb-" + "1234567890" * 3), (4, "postgres://me:s3cret99@db/x"), (5, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"), (6, "see http://a.b/c?d=e, no secret here")]
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(table(spark, rows))[0].collect()}
    assert [got[i].split(":")[0] for i in range(1, 7)] == ["privatekey", "hosttoken", "chattoken", "login", "webtoken", ""]
    assert got[1] == f"privatekey:2:{2 + len(key)}"


def test_a_second_scan_reads_only_what_is_new(spark):
    first = [(i, f"text {i % 30} token=abcdefghijkl{i % 30:02}") for i in range(60)]
    _, ledger = secret_scan.scan_secrets(table(spark, first))
    assert ledger.count() == 30
    later = [*first, (100, "brand new, secret: abcdefghijklmnop"), (101, first[0][1])]
    found, new = secret_scan.scan_secrets(table(spark, later), ledger)
    assert [bytes(r.blob) for r in new.collect()] == [hashlib.sha256(later[-2][1].encode()).digest()]
    assert {r.doc_id for r in found.filter("n_assign = 1").collect()} == {i for i, _ in later}
    # One rule's new version: all blobs are read again, under that rule alone.
    changed = [*[r for r in RULES if r.kind != "access"], Rule("access", 2, "ACCESS[A-Z0-9]+")]
    both = ledger.unionByName(new)
    rows = [*later, (102, "ACCESS12")]
    found, more = secret_scan.scan_secrets(table(spark, rows), both, changed)
    assert more.count() == 32
    assert more.filter(F.size("rules") > 1).count() == 1
    assert {r.doc_id: r.n_access for r in found.collect()}[102] == 1
    # Findings of the version before aren't reported any more.
    again = secret_scan.scan_secrets(table(spark, [(1, "AKIA" + "A" * 20)]), both, changed)[0].first()
    assert again.n_access == 0 and again.n_hex == 0
