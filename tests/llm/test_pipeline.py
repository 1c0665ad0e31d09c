"""The pipeline's stages, each against a brute-force model on its own input, with planted cases."""

import duckdb
import numpy as np
import pytest
from test_alike import heads as near_heads
from test_decontam import slow as slow_leaks
from test_packing import one_by_one

import corpus_pipeline
from skytrace.llm import quality
from skytrace.llm.common import table
from skytrace.llm.oracles import OP1
from skytrace.llm.packing import WordTokenizer, default_vocabulary

PLANT = 10_000_000


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output rows of every stage, over the documents and some planted ones."""
    docs = table(spark, sf_dir, "documents")
    good = [r["text"] for r in docs.join(table(spark, sf_dir, "labels"), "doc_id").where("quality = 1 AND length(text) > 1500").orderBy("doc_id").limit(6).collect()]
    item = max((r["text"] for r in table(spark, sf_dir, "benchmark").collect()), key=len)
    passage = " ".join(good[3].split()[:60])
    leak = f"{' '.join(sorted(good[1].split()))} {item} {good[1][:300]}"  # like no other text, but for the item
    planted = [good[0], good[0].replace(good[0].split()[20], "changed", 1), leak]
    planted += [f"{' '.join(reversed(g.split()))}\n{passage}" for g in good]
    rows = [(PLANT + i, t, "en", "plant", len(t)) for i, t in enumerate(planted)] + [(PLANT + 50, None, None, None, None), (PLANT + 51, "", "en", "plant", 0)]
    current = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    path, seen = tmp_path_factory.mktemp("stages"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(path / name))
        stored = spark.read.parquet(str(path / name))
        seen[name] = current.collect(), stored.collect(), str(path / name)
        current = stored
    return seen, planted


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]


def test_quality_keeps_what_it_predicts(spark, sf_dir, stages):
    before, after, _ = stages[0]["quality"]
    df = spark.createDataFrame(before, table(spark, sf_dir, "documents").schema)
    want = {r["doc_id"] for r in quality.quality_scores(df, table(spark, sf_dir, "labels")).collect() if r["predicted"]}
    assert {r["doc_id"] for r in after} == want
    assert {PLANT + i for i in range(9)} <= want and len(want) > 0.6 * len(before)


def test_line_dedup_is_its_twin(stages):
    _, after, _ = stages[0]["line_dedup"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{stages[0]['quality'][2]}/*.parquet'")
    assert {(r["doc_id"], r["text"]) for r in after} == {(d, t) for d, _, _, t in con.execute(OP1).fetchall()}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
    kept = [r["text"] for r in after if r["doc_id"] >= PLANT + 3 and r["text"]]
    assert sum(len(t.split("\n")[-1].split()) == 60 for t in kept) <= 1


def test_near_dedup_keeps_heads(stages):
    before, after, _ = stages[0]["simhash_near_dedup"]
    rows = sorted((r["doc_id"], r["text"] or "") for r in before)
    assert sorted(r["doc_id"] for r in after) == [rows[i][0] for i in near_heads([t for _, t in rows])]
    assert PLANT not in {r["doc_id"] for r in after}


def test_decontamination_is_brute_force(spark, sf_dir, stages):
    before, after, _ = stages[0]["decontamination"]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    dirty = {r[0] for r in slow_leaks([(r["doc_id"], r["text"]) for r in before], items) if r[4]}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - dirty
    assert PLANT + 2 in dirty


def test_packing_holds_every_token_once(stages):
    before, after, _ = stages[0]["packing"]
    coder, lengths, found = WordTokenizer(default_vocabulary()), [], {}
    for r in sorted(after, key=lambda r: r["start"]):
        found[r["doc_id"]] = found.get(r["doc_id"], b"") + r["ids"]
        lengths.append(r["length"])
    assert found == {r["doc_id"]: coder.ids(r["text"] or "") + (1).to_bytes(4, "little") for r in before}
    fills = {}
    for r in after:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert sorted(fills.values()) == sorted(one_by_one(lengths, 2048).elements())
    assert np.sum([r["length"] for r in after]) == sum(fills.values())


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"] and out.count() > 0
