"""Conversation repair against the contract by definition, and the audit strings against plain strings."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest

from segprofile.llm import conversation_repair as cr

sys.setrecursionlimit(20_000)  # the plain version goes down one level a row
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_audit(rows):
    """Cheapest edits, worked out from the end with whole strings."""

    @cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        wanted = "a" if state == "u" else "u"
        if inserted < 3:
            cost, rest = best(i, wanted, inserted + 1)
            found.append((cost + 2, "I" + rest))
        if i < len(rows):
            letter, must_go, truncated = rows[i]
            cost, rest = best(i + 1, state, 0)
            found.append((cost + 3, "D" + rest))
            if not must_go:
                cost, rest = best(i + 1, wanted, 0)
                found.append((cost + 2 + truncated, "R" + rest))
                if (state, letter) in STEP:
                    cost, rest = best(i + 1, STEP[state, letter], 0)
                    found.append((cost + truncated, "K" + rest))
        return min(found, default=(1 << 40, "~"))

    return best(0, "", 0)


def plain(table):
    """All columns of the contract for rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in [r for r in table if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        counts, seen, letters = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
            letters.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(letters, letters[1:], strict=False))
        cost, audit = plain_audit(tuple(letters))
        repaired, state, left = [], "", list(rows)
        for edit in audit:
            role, text = ("", "") if edit == "I" else left.pop(0)[1:]
            if edit != "D":
                role = role if edit == "K" else "assistant" if state == "u" else "user"
                state = role[:1]
                repaired.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(spark, tmp_path, rows):
    path = str(tmp_path / "tables")
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, place int")
    frame.write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in cr.query(spark, path).collect()}


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "", " \t", "Why? ", None, "a:b.", "Long text without an end", "u.\nuser:x."]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_contract_by_definition(spark, tmp_path, seed):
    rows = random_rows(seed, 150, 12) + [(None, 0, "user", "Null id."), (None, 1, "assistant", "Right?"), (9999, None, None, None)]
    assert found(spark, tmp_path, rows) == plain(rows)


def test_whole_small_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in cr.query(spark, folder).collect()} == plain(rows)


def test_no_rows_left_and_empty_table(spark, tmp_path):
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, dropped, "user", "Gone.")]
    assert found(spark, tmp_path, rows) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, tmp_path, []) == {}


def test_long_and_repeated_rows(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 else "assistant", "same text." if t % 3 else "x " * 20_000 + str(t)) for t in range(400)]
    assert found(spark, tmp_path, rows) == plain(rows)


def test_repaired_rows_are_conversations(spark):
    rows = random_rows(5, 60, 10)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    judged = cr.judge(frame)
    turns = cr.repair(frame, judged).collect()
    for conv in {r[0] for r in rows}:
        mine = sorted((r.place, r.role[:1], r.edit, r.text) for r in turns if r.conv_id == conv)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[1] for r in mine))
        assert [r[0] for r in mine] == list(range(len(mine)))
        assert all(r[3] == "" for r in mine if r[2] == "Insert")


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 7])  # the small one collides all the time
def test_audits_are_strings(prime):
    rng, audits = random.Random(8), cr.Audits(base=3, prime=prime)
    nodes = {"": 0}
    for _ in range(3000):
        text = rng.choice(list(nodes)[-60:])
        letter = rng.choice("DIKR")
        new = audits.grow(nodes[text], letter)
        assert nodes.setdefault(text + letter, new) == new
    names = list(nodes)
    assert all(audits.text(nodes[t]) == t for t in names)
    for _ in range(5000):
        x, y = rng.choice(names), rng.choice(names)
        assert audits.less(nodes[x], nodes[y]) == (x < y)
        assert audits.text(audits.prefix(nodes[x], len(x) // 2)) == x[: len(x) // 2]


def test_cheapest_with_colliding_hashes():
    rng = random.Random(9)
    for _ in range(400):
        rows = tuple((rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9)))
        assert cr.cheapest(rows, cr.Audits(base=3, prime=5)) == cr.cheapest(rows) == plain_audit(rows)
