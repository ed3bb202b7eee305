import hashlib

import pytest

from segprofile.llm import decontamination as D
from segprofile.llm.text import words_of


def brute(docs, items):
    parts = {}
    for item, text in items:
        w = words_of((text or "").encode())
        n = min(13, len(w))
        parts.setdefault(item, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    out = []
    for doc, text in docs:
        w, hit, found = words_of((text or "").encode()), set(), set()
        for item, windows in parts.items():
            for x in windows:
                for i in range(len(w) - len(x) + 1):
                    if tuple(w[i : i + len(x)]) == x:
                        hit |= set(range(i, i + len(x)))
                        found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEM = "Alpha beta gamma delta Epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
ITEMS = [("q1", ITEM), ("q2", ITEM + " sigma"), ("q3", "four little words here"), ("q4", "one"), ("q5", ""), ("q6", None), ("q7", "a a a a a a a a a a a a a a a"), ("q10", "four little words here"), (None, "nameless item text")]
DOCS = [
    (1, "x " * 300 + ITEM.upper().replace(" ", "--") + " y" * 20),
    (2, "before " + " ".join(ITEM.split()[2:15]) + " after"),
    (3, " ".join(ITEM.split()[:12])),
    (4, "Four, little; words here. four little words four little words here"),
    (5, "a " * 40),
    (6, "ONE two three " + "far " * 100),
    (7, ""), (8, None), (9, "nameless item text"), (9, "another row of nine"), (None, "one"), (None, "one"),
]


@pytest.mark.parametrize("block_rows", [200_000, 5])
def test_equal_to_brute_force(spark, documents, block_rows):
    bench = spark.createDataFrame([(a, b, "x", 1) for a, b in ITEMS], "item_id string, text string, window string, at int")
    got = [tuple(r) for r in D.contamination(documents(DOCS), bench, block_rows).collect()]
    assert sorted(got, key=repr) == brute(DOCS, ITEMS)


def test_odd_rows_and_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([("q", "some words without an id")], "item_id string, text string")
    empty = spark.createDataFrame([], "item_id string, text string")
    assert [r.contaminated for r in D.contamination(odd, bench).collect()].count(True) == 1
    assert {r.n_hit for r in D.contamination(odd, empty).collect()} == {0}
    assert D.contamination(none, bench).count() == 0
    kept = D.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 11
    assert D.clean(odd, empty).count() == 12 and D.clean(none, bench).count() == 0


def test_no_python_and_no_shuffle_of_texts(spark, documents):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    plan = D.contamination(documents(DOCS), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
