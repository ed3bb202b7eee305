"""Every stage against a brute-force version of it, on what the stage before really kept."""

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from segprofile.functions.staging import stage
from segprofile.llm import mixing, near_texts, sharding, toxicity
from segprofile.llm.tables import read
from test_decontamination import brute
from test_near import roots

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = read(spark, SF, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]

    model = toxicity.fit_from_labels(spark, docs, read(spark, SF, "labels"))
    civil = stage(stages["toxicity"](spark, docs, SF))
    scores = docs.select("doc_id", model.column(spark, F.col("text")).alias("s")).collect()
    assert civil.columns == columns and {r.doc_id for r in civil.collect()} == {r.doc_id for r in scores if r.s < 0.7}

    rows = civil.orderBy("doc_id").collect()
    idf = near_texts.inverse_frequencies(civil.select("text"))
    like = near_texts.all_similarities(pa.array([r.text for r in rows]), idf)
    links = [(j, i) for i in range(len(rows)) for j in range(i) if like[i, j] >= 0.8 or rows[i].text == rows[j].text]
    single = stage(stages["near_duplicates"](spark, civil, SF))
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(rows[i].doc_id for i, x in enumerate(roots(len(rows), links)) if x == i)

    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    verdicts = brute([(r.doc_id, r.text) for r in single.collect()], items)
    clean = stage(stages["decontamination"](spark, single, SF))
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {v[0] for v in verdicts if not v[5]}
    assert any(v[5] for v in verdicts)

    mixed = stage(stages["mixing"](spark, clean, SF))
    plan = {r.doc_id: r for r in mixing.mix_plan(clean).collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and all(plan[d].taken == n * plan[d]["size"] for d, n in copies.items())
    assert all(r.taken == 0 for d, r in plan.items() if d not in copies)

    shards = stages["sharding"](spark, mixed, SF).collect()
    want = mixed.select("doc_id", sharding.shard_of(F.col("doc_id"), sharding.even_tree(16)).alias("s"), "text").collect()
    assert Counter((r.doc_id, r.shard, r.text_crc32) for r in shards) == Counter((r.doc_id, r.s, zlib.crc32(r.text.encode())) for r in want)
    assert len({(r.shard, r.slot) for r in shards}) == len(shards)


def test_stages_take_empty_and_odd_documents(spark, odd, none):
    for docs in (odd, none):
        for name, function in corpus_pipeline.STAGES:
            out = stage(function(spark, docs, SF))
            assert name == "sharding" or out.columns == docs.columns
            docs = out


def test_registered():
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert "pipeline" in entry.queries()
