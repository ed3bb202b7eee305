import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segprofile.llm.components import components
from segprofile.llm.text import Tokens, pieces, shingles, words_column, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aBz09 .,-\n\x00éß漢😀"), max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_batch_words_are_the_words(texts):
    tokens = Tokens(pa.array(texts, pa.string()))
    words = [words_of((t or "").encode()) for t in texts]
    assert tokens.counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(tokens.hashes) == len(flat)
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (a == b) == (tokens.hashes[i] == tokens.hashes[j])


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingles_equal_runs_of_words(texts):
    rows, values = shingles(Tokens(pa.array(texts, pa.string())), 3)
    want = []
    for i, t in enumerate(texts):
        w = words_of((t or "").encode())
        want += [(i, tuple(w[k : k + 3])) for k in range(max(1, len(w) - 2))] if w else []
    assert sorted(rows.tolist()) == sorted(i for i, _ in want)
    assert len(set(values.tolist())) == len({w for _, w in want})


def test_slices_of_arrays_and_pieces():
    whole = pa.array(["one two", "three", None, "", "four five six"])
    part = whole.slice(1, 4)
    assert Tokens(part).counts.tolist() == [1, 0, 0, 3]
    found = list(pieces(part, 6))
    assert [x for _, p in found for x in p.to_pylist()] == part.to_pylist() and len(found) == 2


def test_column_words(spark):
    df = spark.createDataFrame([("Ab c-É1",), (None,), ("",), (" x ",)], "text string")
    got = [r[0] for r in df.select(words_column(F.col("text"))).collect()]
    assert got == [["ab", "c", "É1"], [], [], ["x"]]


def test_components_of_chains_stars_and_random_links(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(699, 5)]
    links += [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (220, 2))] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
