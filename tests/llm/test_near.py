from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from segprofile.llm import near_texts as NT
from segprofile.llm import near_vectors as NV
from segprofile.llm.text import words_of


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


# -- vectors ----------------------------------------------------------------------------------


def clusters(rng, n, dim=32):
    centres = rng.standard_normal((n // 12, dim))
    rows = centres[rng.integers(0, len(centres), n)] + 0.3 * rng.standard_normal((n, dim)) * (rng.random((n, 1)) < 0.7)
    rows[: n // 5] = centres[0] + 0.2 * rng.standard_normal((n // 5, dim))  # one large group
    return rows


@pytest.mark.parametrize(("leaf", "block"), [(384, 1024), (20, 16)])
def test_vectors_equal_brute_force(spark, leaf, block):
    rng = np.random.default_rng(8)
    v = clusters(rng, 600)
    labels = rng.integers(0, 3, 600)
    df = spark.createDataFrame([(1000 - i, int(labels[i]), [float(x) for x in v[i]], "x") for i in range(600)], "vec_id long, label int, embedding array<double>, rep string")
    got = {r.vec_id: r for r in NV.near_vectors(df, leaf=leaf, block=block).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    ids = 1000 - np.arange(600)
    order = np.argsort(ids)
    place = roots(600, np.argwhere(near[np.ix_(order, order)]).tolist())
    missed = sum(got[int(ids[i])].n_links != near[i].sum() for i in range(600))
    assert missed <= 2 and near.sum() > 5000
    if not missed:
        assert [got[int(ids[i])].component_id for i in order] == [int(ids[order[p]]) for p in place]


def test_vectors_of_one_id_count_apart(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [1.0, 0.01]), (3, 0, [0.01, 1.0]), (4, 0, [1.0, 1.0]), (4, 1, [1.0, 0.0])]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in NV.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())
    assert got == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (4, 0, 4)])


def test_a_hot_label_is_split_as_deep_as_its_own_size_asks(spark):
    rng = np.random.default_rng(11)
    v = clusters(rng, 900, 64)
    labels = np.where(np.arange(900) < 500, 0, 1 + np.arange(900) // 10)  # one large label, forty small ones
    frame = spark.createDataFrame([(i, int(labels[i]), [float(x) for x in v[i]]) for i in range(900)], "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: r.n_links for r in NV.near_vectors(frame, leaf=20, block=64).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    found, right = sum(got.values()), int(near.sum())
    assert found <= right and found >= 0.995 * right


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 2.0]), (2, 0, [2.0, 4.0]), (3, 0, [1.0, 2.0]), (3, 0, [1.0, 2.0]), (4, 1, [1.0, 2.0]), (5, None, [1.0, 2.0]),
        (6, 0, None), (7, 0, []), (8, 0, [0.0, 0.0]), (9, 0, [1.0, None]), (10, 0, [nan, 1.0]), (11, 0, [inf, 1.0]), (None, 0, [1.0, 2.0]), (12, 0, [1.0, 2.0, 0.0]),
    ]
    schema = "vec_id long, label int, embedding array<double>"
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in NV.near_vectors(spark.createDataFrame(rows, schema)).collect())
    alone = {(i, 0, i): 1 for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, None)}
    assert got == Counter({(1, 3, 1): 1, (2, 3, 1): 1, (3, 3, 1): 2, **alone})
    assert NV.near_vectors(spark.createDataFrame([], schema)).count() == 0


# -- texts ------------------------------------------------------------------------------------


def similarity(a, b, idf):
    sides = []
    for t in (a, b):
        rows, values, tf = NT.weighted(pa.array([t]))
        sides.append({v: n * float(idf[np.array([v], np.uint64)][0]) for v, n in zip(values.tolist(), tf.tolist(), strict=True)})
    x, y = sides
    keys = set(x) | set(y)
    over = sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / over if over else 0.0


def corpus(rng):
    words = np.array([f"w{i}" for i in range(900)])
    passage = " ".join(rng.choice(words, 60))
    texts = []
    for g, copies in enumerate((40, 2, 3, 25, 1, 1, 2)):
        base = rng.choice(words, 150)
        for c in range(copies):
            own = base.copy()
            own[rng.integers(0, 150, rng.integers(0, 9))] = rng.choice(words, 1)  # some below, some above the threshold
            texts.append(" ".join(own) + (f" {passage}" if (g + c) % 3 == 0 else ""))
    texts += [" ".join(rng.choice(words, 80)) + " " + passage for _ in range(30)]
    return texts + texts[:10] + ["short one", "short one", "Short ONE!", "other short", "", "", "...", None, None, "end end end end end end end"]


@pytest.mark.parametrize(("block", "text_block"), [(1024, 192), (8, 6)])
def test_texts_equal_brute_force(spark, documents, block, text_block):
    texts = corpus(np.random.default_rng(6))
    n = len(texts)
    docs = documents([(i, t, "en", "a") for i, t in enumerate(texts)])
    idf = NT.inverse_frequencies(docs.select("text"))
    got = {r.doc_id: r for r in NT.near_text_classes(docs, block=block, text_block=text_block).collect()}
    links = []
    for i in range(n):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j]
            if same or similarity(texts[i] or "", texts[j] or "", idf) >= 0.8:
                links.append((j, i))
    want = roots(n, links)
    assert [got[i].class_id for i in range(n)] == want
    assert [got[i].kept for i in range(n)] == [want[i] == i for i in range(n)]
    together = NT.all_similarities(pa.array(texts), idf)
    for i, j in links[:50] + [(1, 50), (80, 90)]:
        assert together[i, j] == pytest.approx(similarity(texts[i] or "", texts[j] or "", idf)) or texts[i] is None


def test_frequencies_are_exact_whatever_the_number_of_shingles(spark, documents):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"u{x}" for x in rng.integers(0, 10**9, 2000)) + (f" {passage}" * 2 if i % 4 == 0 else "") for i in range(400)]
    found = Counter(v for t in texts for v in NT.weighted(pa.array([t]))[1].tolist())
    values = np.array(list(found), np.uint64)
    want = NT.FLAT + (1 - NT.FLAT) * np.log1p(400 / np.array(list(found.values()))) / np.log1p(400)
    docs = documents([(i, t, "en", "a") for i, t in enumerate(texts)])
    for more in ({}, {"chunk": 1 << 30}):
        idf = NT.inverse_frequencies(docs.select("text"), **more)
        assert len(values) > 700_000 and idf[values] == pytest.approx(want, rel=1e-6)


def test_classes_do_not_change_with_what_other_texts_hold(spark, documents):
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in range(300))
    own = [" ".join(f"o{g}x{i}" for i in range(62)) for g in range(60)]
    texts = [f"{own[g]} {passage} {' '.join(f'e{g}y{c}z{i}' for i in range(5 + g % 12))}" for g in range(60) for c in range(2)]
    many = [" ".join(f"u{x}" for x in rng.integers(0, 10**9, 20_000)) for _ in range(100)]
    docs = documents([(i, t, "en", "a") for i, t in enumerate([*texts, *many])])
    n, found = len(texts) + len(many), Counter(v for t in texts for v in NT.weighted(pa.array([t]))[1].tolist())
    sides = [{v: NT.FLAT + (1 - NT.FLAT) * np.log1p(n / found[v]) / np.log1p(n) for v in NT.weighted(pa.array([t]))[1].tolist()} for t in texts]

    def alike(x, y):
        shared = sum(x[k] for k in x.keys() & y.keys())
        return shared / (sum(x.values()) + sum(y.values()) - shared)

    links = [(j, i) for i in range(len(texts)) for j in range(i) if alike(sides[j], sides[i]) >= 0.8]
    got = {r.doc_id: r.class_id for r in NT.near_text_classes(docs).collect()}
    assert [got[i] for i in range(n)] == roots(n, links)


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(2)
    words = [f"v{i}" for i in range(5000)]
    texts = []
    for _ in range(80):  # pairs that have nothing to do with each other
        base = rng.choice(words, 400)
        own = base.copy()
        own[rng.integers(0, 400, 12)] = "changed"
        texts += [" ".join(base), " ".join(own)]
    idf = NT.Frequencies(np.zeros(0, np.uint64), np.zeros(0, np.float32))  # all weigh 1
    rows, values, tf = NT.weighted(pa.array(texts))
    found = NT.samples(rows, values, tf, len(texts))
    true = NT.all_similarities(pa.array(texts), idf)
    pairs = range(0, 160, 2)
    agree = np.mean([(found[i] == found[i + 1]).mean() for i in pairs])
    assert agree == pytest.approx(np.mean([true[i, i + 1] for i in pairs]), abs=0.04)
    doubled = NT.samples(rows, values, tf, len(texts))
    assert (doubled == found).all()


def test_odd_texts(odd, none):
    rows = NT.near_text_classes(odd).collect()
    assert len(rows) == 12
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.class_id, r.kept))
    assert by[8] == {(1, False)} and by[4] == {(4, True)} and by[2] == {(2, True)} and by[None] == {(None, True)}
    kept = NT.keep_one_of_each(odd)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd.columns and ids == Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1})
    assert NT.near_text_classes(none).count() == 0 and NT.keep_one_of_each(none).count() == 0


def test_words_are_those_of_the_contract():
    assert words_of("Ab-cÉ 1".encode()) == [b"ab", "cÉ".encode(), b"1"]
