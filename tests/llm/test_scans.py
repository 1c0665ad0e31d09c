"""Secret and license scans."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import documents
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skytrace.llm import license_scan, secret_scan
from skytrace.llm.common import table

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def check(rows, out):
    want = sorted((str(d), str(base(t))) for d, t in rows)
    got = []
    for r in out:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        mine = [(int(a), secret_scan.KINDS.index(k), int(b)) for k, a, b in spans if k != "random"]
        assert mine == sorted(mine) and [(int(s[1]), secret_scan.KINDS.index(s[0])) for s in spans] == sorted((int(s[1]), secret_scan.KINDS.index(s[0])) for s in spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in mine) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in mine).encode()).hexdigest()
        got.append((str(r["doc_id"]), str(mine)))
    assert sorted(got) == want


PIECES = ["password", "TOKEN", "api_key", "ApiKey", "secret", ":", "=", " ", '"', "'", "abc", "deadbeef" * 3, "AKIA", "A1B2C3D4E5F6G7H8", "é", "\U0001f600", "\n", "x.y", "token: token=", "passwd = a"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=30, max_size=30))
def test_base_spans(spark, texts):
    rows = list(enumerate(texts))
    check(rows, secret_scan.scan_secrets(documents(spark, rows)).collect())


def test_secret_edges(spark):
    rows = [(1, None), (2, ""), (None, "token=abcdef"), (3, "token=abcde"), (4, "a" * 200_000), (4, "a" * 200_000), (5, "AKIA" * 30), (6, "\U0001f600é " + "0a" * 12), (7, "password: token: abcdefgh")]
    d = documents(spark, rows, {"hex": "mine", "spans": "mine", "runs": "mine"})
    check(rows, secret_scan.scan_secrets(d).collect())
    assert secret_scan.scan_secrets(d.limit(0)).count() == 0


def test_a_text_of_many_secrets(spark):
    rows = [(1, " ".join(f"\U0001f600 password=Ab{i:08d}x {'0a' * 12}" for i in range(20_000)))]
    check(rows, secret_scan.scan_secrets(documents(spark, rows)).collect())


def test_battery_tells_random_from_names(spark):
    rng = random.Random(3)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    keys = ["".join(rng.choice(a) for _ in range(48)) for a in alphabets for _ in range(40)]
    syllables = ["user", "account", "Manager", "service", "Handler", "config", "2024", "Test", "value", "Index", "Report", "08", "_"]
    names = ["".join(rng.choice(syllables) for _ in range(10)) for _ in range(2000)]
    texts = [(i, f"first {w} last") for i, w in enumerate(keys + names)]
    out = {r["doc_id"]: r["n_random"] for r in secret_scan.scan_secrets(documents(spark, texts)).collect()}
    hits = [out[i] for i in range(len(keys))]
    false = sum(out[i] for i in range(len(keys), len(texts)))
    # base32 has few digits, so its runs of classes say least
    assert np.mean(hits[:40]) > 0.9 and np.mean(hits[40:80]) > 0.4 and np.mean(hits[80:]) > 0.95
    assert false <= 0.02 * sum(hits)


@pytest.fixture(scope="module")
def prose(spark, sf_dir):
    return license_scan.background(table(spark, sf_dir, "documents"), license_scan.ScanParams())


def test_licenses_found_and_nothing_else(spark, prose):
    model = license_scan.train(prose)
    rng = random.Random(1)
    rows, want = [], {}
    for i, (family, statement) in enumerate((f, s) for f in license_scan.FAMILIES for s in license_scan.TEMPLATES[f]):
        rows.append((i, "\n".join([rng.choice(prose)[:200], statement, "end"])))
        rows.append((100 + i, f"{rng.choice(prose)[:150]} {statement.upper()} {rng.choice(prose)[:150]}"))
        want[i] = want[100 + i] = family
    plain = ["A driving license is required.", "The apache helicopter landed.", "All rights are reserved for later meetings of the general public.", "MIT is in Cambridge.", "under the terms of the lease", "version 3 of the work"]
    rows += [(200 + i, t) for i, t in enumerate(plain + [x for x in prose if "icense" not in x and "rights" not in x][:100])]
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(spark, rows), model=model).collect()}
    right = sum(out[i]["families"] == f for i, f in want.items())
    assert right >= 0.95 * len(want)
    assert not [r["doc_id"] for d, r in out.items() if d >= 200 and r["n_licenses"]]
    assert out[0]["spans"] == f"1:{want[0]}"


def test_licenses_of_all_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stated = re.compile("|".join(re.escape(s) for f in license_scan.TEMPLATES.values() for s in f))
    want = {r["doc_id"] for r in docs.collect() if stated.search(r["text"] or "")}
    got = {r["doc_id"] for r in license_scan.scan_licenses(docs).collect() if r["n_licenses"]}
    assert want <= got and len(got - want) <= 0.1 * len(want)


def test_wrapped_notices_of_every_family(spark, prose):
    """Statements wrapped at 72, 50 and 40 columns, with comment marks and text around, are found at their first line."""
    import textwrap

    model = license_scan.train(prose)
    rows, want = [], {}
    for i, (family, statement) in enumerate((f, s) for f in license_scan.FAMILIES for s in license_scan.TEMPLATES[f]):
        for width, mark in ((72, ""), (50, "# "), (40, " * ")):
            body = textwrap.wrap(statement, width)
            if len(body) > 1:
                before = ["some code here"] * (i % 7)
                key = 1000 * width + i
                rows.append((key, "\n".join([*before, *(mark + x for x in body), "the end of it"])))
                want[key] = (family, len(before))
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(spark, rows), model=model).collect()}
    assert sum(out[k]["families"] == f for k, (f, _) in want.items()) >= 0.95 * len(want)
    near = [abs(int(out[k]["spans"].split(":")[0]) - at) <= 1 for k, (f, at) in want.items() if out[k]["families"] == f]
    assert np.mean(near) >= 0.9


def test_license_edges(spark):
    s = license_scan.TEMPLATES["mit"][0]
    rows = [(1, None), (2, ""), (None, s), (3, s + "\n" + s), (3, s + "\n" + s), (4, "word " * 100_000 + s)]
    d = documents(spark, rows, {"row": "mine", "grams": "mine", "family": "mine"})
    out = {}
    for r in license_scan.scan_licenses(d, model=license_scan.train(["plain words"])).collect():
        out.setdefault(r["doc_id"], []).append((r["n_licenses"], r["families"], r["spans"], r["confidence"] is None))
    assert out[1] == out[2] == [(0, "", "", True)]
    assert out[3] == [(2, "mit", "0:mit,1:mit", False)] * 2 and out[None] == out[4] == [(1, "mit", "0:mit", False)]
    assert license_scan.scan_licenses(d.limit(0)).count() == 0


def test_licenses_with_template_words_in_the_background(spark, prose):
    """A sample that holds every template word in ordinary sentences, and parts of notices, hides no statement."""
    statements = [(f, s) for f in license_scan.FAMILIES for s in license_scan.TEMPLATES[f]]
    every = sorted({w for _, s in statements for w in license_scan.words(s)})
    ordinary = [f"yesterday someone said {w} while walking home along that river" for w in every]
    parts = [" ".join(s.split()[:len(s.split()) // 2]) for _, s in statements]
    model = license_scan.train(prose + ordinary + parts)
    out = {r["doc_id"]: r["families"] for r in license_scan.scan_licenses(documents(spark, [(i, s) for i, (_, s) in enumerate(statements)] + [(100 + i, t) for i, t in enumerate(ordinary)]), model=model).collect()}
    assert sum(out[i] == f for i, (f, _) in enumerate(statements)) >= 0.95 * len(statements)
    assert not [i for i, f in out.items() if i >= 100 and f]


def test_no_statement_is_covered_without_its_anchors():
    p = license_scan.ScanParams()
    for s in (s for f in license_scan.FAMILIES for s in license_scan.TEMPLATES[f]):
        held = license_scan.anchor_words(s, p.coverage)
        shape = license_scan.grams(license_scan.words(s))
        assert sum(not held & set(g.split()) for g in shape) < p.coverage * len(shape)
