"""Line dedup and SimHash near-duplicates."""

import random

import pytest
from helpers import components, documents, simhash as slow_simhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skytrace.llm import alike, common, line_dedup, simhash
from skytrace.llm.common import table

EDGES = [(1, None), (2, ""), (3, "  \n\t \n"), (4, "a"), (4, "a"), (5, "one two"), (None, "one two"), (6, "x " * 30000), (7, "é ß 日本 \U0001f600"), (8, "one two")]


def test_fingerprint_is_sparks_hash(spark):
    text = "one two three"
    got = spark.sql(f"SELECT xxhash64('{text}')").first()[0]
    assert simhash.fingerprint(text.encode()) == got % 2**64


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abC é\n\t\x1c", max_size=60))
def test_fingerprint_model(text):
    assert simhash.fingerprint(text.encode()) == slow_simhash(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    assert simhash.fingerprint(text) == whole == slow_simhash(text.decode())


def test_near_duplicates_of_all_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prints = {r["doc_id"]: slow_simhash(r["text"]) for r in docs.collect()}
    want = components(prints)
    rows = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in rows} == {d: (prints[d], want[d]) for d in prints}
    assert len(rows) == len(prints)
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("limit", [0, 300_000])
def test_links_of_planted_fingerprints(spark, monkeypatch, limit):
    """Chains and stars of prints one to three bits apart, with and without broadcast lookups."""
    monkeypatch.setattr(common, "LOOKUP_ROWS", limit)
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << b
    hub = rng.getrandbits(64)
    prints += [hub ^ (1 << b) for b in range(40)]
    signed = {p - 2**64 if p >= 2**63 else p for p in prints}
    links = simhash.linked_prints(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in common.components(links).collect()}
    want = components({p: p % 2**64 for p in signed})
    groups = lambda of: sorted(sorted(p for p in signed if of(p) == r) for r in {of(p) for p in signed})
    assert groups(lambda p: roots.get(p, p)) == groups(want.get)


def test_near_duplicate_edges(spark):
    docs = documents(spark, EDGES, {"fp": "mine", "component_id": "mine", "key": "mine"})
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    by = {}
    for d, fp, c in got:
        by.setdefault(d, set()).add((fp, c))
    assert len(got) == len(EDGES)
    assert by[1] == by[2] == by[3] == {(0, 1)}
    assert by[5] == by[8] == by[None] and {c for _, c in by[5]} == {5}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    """An id stands for each of its texts: none is lost with the others, and no copy stays because of its id."""
    own = "one two three four five six seven", "a quite different text of its own kind", "third text that nobody else has here"
    rows = [(3, own[0]), (5, own[1]), (5, own[2]), (5, own[0]), (7, own[1]), (7, own[1]), (9, None), (9, ""), (None, own[2])]
    for keep in (simhash.keep_one, alike.keep_one):
        kept = keep(documents(spark, rows, {"head": 1, "tk": "x", "root": 2, "fp": 3}))
        assert {"head", "tk", "root", "fp"} <= {*kept.columns} and "_tk" not in kept.columns
        assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(3, own[0]), (5, own[1]), (5, own[2]), (9, "")])


def test_components_of_a_long_path(spark):
    links = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    rows = common.components(links).collect()
    assert len(rows) == 401 and len({r["root"] for r in rows}) == 1


def test_line_dedup_rules(spark):
    menu = "Home | About | Contact us today"
    log = lambda user, n: f"session {n} opened for user {user} from the gateway"
    rows = [(i, f"{menu}\nown text number {'abcdefgh'[i]} stays here\n\n{log('u' + 'xyzvwkqp'[i] * 3, 100 + i)}") for i in range(8)]
    rows += [(20, "twice only"), (21, "twice only"), (22, "12\n13\n14"), (23, None), (24, ""), (22, "12\n13\n14")]
    out = {(r["doc_id"], r["text"]): r for r in line_dedup.dedup_lines(documents(spark, rows, {"n_lines": "mine", "gone": "mine"})).collect()}
    texts = {d: t for d, t in out}
    assert texts[0] == rows[0][1]
    for i in range(1, 8):
        kept = texts[i].split("\n")
        assert menu not in kept and "" in kept and not any("session" in x for x in kept)
    assert texts[20] == "twice only" and texts[21] == "" and texts[22] == "12\n13\n14" and texts[23] is None and texts[24] == ""
    assert out[(3, texts[3])]["n_lines"] == 4 and out[(3, texts[3])]["n_dropped"] >= 2
    assert line_dedup.dedup_lines(documents(spark, rows).limit(0)).count() == 0


def test_line_dedup_without_broadcast(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    want = {tuple(r) for r in line_dedup.dedup_lines(docs).collect()}
    monkeypatch.setattr(common, "LOOKUP_ROWS", 0)
    monkeypatch.setattr(line_dedup, "LOOKUP_POSITIONS", 0)
    assert {tuple(r) for r in line_dedup.dedup_lines(docs).collect()} == want
