import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segprofile.llm import language, quality, toxicity
from segprofile.llm.tables import read

SF = "/root/testdata/sf0.01"


def held_out(spark, module, label):
    labels = read(spark, SF, "labels").select("doc_id", F.col(label).alias("y"))
    return module.query(spark, SF).join(labels, "doc_id").filter("held_out AND y IS NOT NULL").collect()


def test_toxicity_on_held_out_documents(spark):
    rows = held_out(spark, toxicity, "toxic")
    assert np.mean([r.predicted == r.y for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_quality_on_held_out_documents(spark):
    rows = held_out(spark, quality, "quality")
    assert np.mean([r.predicted == r.y for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_on_held_out_documents(spark):
    rows = language.query(spark, SF).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95


def biased(n=400):
    """Toxic words, and a group that is mentioned mostly in toxic sentences."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        toxic = i % 2
        group = "muslims" if (rng.random() < (0.9 if toxic else 0.1)) else "christians"
        bad = "horrid " if toxic and rng.random() < 0.8 else ""
        rows.append((i, f"The {group} {bad}came to town{rng.integers(9)}. Weather was w{rng.integers(30)}.", toxic))
    return rows


def test_swapped_identity_terms_change_the_score_less(spark):
    rows = spark.createDataFrame(biased(), "doc_id long, text string, toxic int")
    ask = spark.createDataFrame([("The muslims came to town",), ("The christians came to town",), ("The christians horrid came to town",)], "text string")
    gap = {}
    for strength in (0.0, 50.0):
        model = toxicity.ToxicityModel.fit(rows, counterfactual=strength)
        a, b, bad = (r[0] for r in ask.select(model.column(spark, F.col("text"))).collect())
        gap[strength] = abs(a - b)
        assert bad > b
    assert gap[0.0] > 0.3 and gap[50.0] < gap[0.0] / 3


def test_fitted_weights_satisfy_the_gradient():
    rng = np.random.default_rng(0)
    at = [sorted(set(rng.integers(0, 12, 4).tolist())) for _ in range(300)]
    y = np.array([float(0 in x or rng.random() < 0.2) for x in at])
    pairs = [[-1, 3], [-2, 4]]
    w, b = toxicity.fit_weights(y, pa.array(at), pa.array(pairs), 12, 1.0, ridge=1e-2, steps=3000)
    x = np.array([[i in row for i in range(12)] for row in at], float)
    off = (1 / (1 + np.exp(-(x @ w + b))) - y) * np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    d = np.array([w[2] - w[0], w[3] - w[1]])
    slope = x.T @ off / 300 + 1e-2 * w
    slope[[2, 3]] += d / 2
    slope[[0, 1]] -= d / 2
    assert np.abs(slope).max() < 1e-4 and abs(off.mean()) < 1e-4


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (5, 0), (4, None), (None, 1), (7, 0), (7, 1)]])
def test_toxicity_of_odd_rows(spark, odd, none, labels):
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_from_labels(spark, odd, table)
    scores = [r[0] for r in odd.select(model.column(spark, F.col("text"))).collect()]
    assert len(scores) == 12 and all(0 <= s <= 1 for s in scores)
    if not labels:
        assert set(scores) == {0.5}
    assert toxicity.keep_civil(spark, odd, table).columns == odd.columns
    assert toxicity.keep_civil(spark, none, table).count() == 0


def test_language_of_odd_rows(spark, odd, none):
    model = language.LanguageModel.fit(odd.select("text", "lang"))
    rows = odd.select("doc_id", "text", model.column(spark, F.col("text")).alias("p")).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.p.lang_pred == ("en" if letters else "und") and 0 <= r.p.score <= 1
    nothing = language.LanguageModel.fit(none.select("text", "lang"))
    assert {r[0] for r in odd.select(nothing.column(spark, F.col("text")).lang_pred).collect()} == {"und"}
    assert none.select(model.column(spark, F.col("text"))).count() == 0


def test_language_counts_by_definition(spark):
    rows = [("abab", "x"), ("Ab", "x"), ("cd cd", "y")]
    model = language.LanguageModel.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["x", "y"] and np.allclose(np.exp(model.prior), [2 / 3, 1 / 3])
    assert np.allclose(np.exp(model.table.astype(float)).sum(axis=0), 1, atol=1e-3)
    assert language._predict("ba", model.langs, model.table, model.prior)[0] == "x"
    assert language._predict("dc", model.langs, model.table, model.prior)[0] == "y"


def test_statistics_of_small_texts():
    s = dict(zip(quality.STATISTICS, quality.statistics_of(b"a a b!\nA."), strict=True))
    assert (s["bytes"], s["words"], s["lines"], s["longest_word"]) == (9, 4, 2, 2)
    assert s["repeats_next"] == 0.25 and s["distinct_words"] == 0.75 and s["share_bang"] == pytest.approx(1 / 9)
    assert set(quality.statistics_of(b"")[:4]) == {0.0}


def test_compiled_rules_equal_their_definition(spark):
    rng = np.random.default_rng(2)
    found = spark.createDataFrame([(i, *(float(x) for x in rng.random(len(quality.STATISTICS)))) for i in range(50)], "doc_id long, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    rules = {(("words", True, 0.5),): 1.5, (("lines", False, 0.3), ("bytes", True, 0.7)): -2.0}
    got = found.select("*", quality.RuleEnsemble(0.1, rules).score.alias("s")).collect()
    for r in got:
        z = 0.1 + 1.5 * (r["words"] <= 0.5) - 2.0 * (r["lines"] > 0.3 and r["bytes"] <= 0.7)
        assert r.s == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_of_odd_rows(spark, odd, none):
    found = quality.statistics(odd)
    assert found.count() == 12 and quality.statistics(none).count() == 0
    rows = found.withColumn("label", F.lit(1.0))
    for given, score in ((rows, None), (rows.limit(0), 0.5)):
        model = quality.RuleEnsemble.fit(given)
        assert not model.weights
        value = found.select(model.score).first()[0]
        assert value == 0.5 if score else value > 0.99
