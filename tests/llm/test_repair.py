"""Repaired conversations against a search through all edits in plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chronopanel.llm import repair

SPACE = " \t\n\x0b\x0c\r"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    """(conv, turn, role, text) rows by conversation, after damage."""
    out = {}
    for conv, turn, role, text in rows:
        named = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind, own = zlib.crc32(named.encode()) % 20, out.setdefault(conv, [])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """The contract read word by word: best-first search over (row, state) by (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    out = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))]
    # the letters given so far must begin a word of (s?(ua)+)?
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, given, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", given):
            return [*out, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()]
        state = (i, given[-1:] + str(len(given) > 0))
        if state in done:
            continue
        done.add(state)

        def go(price, letter, step, role, text, cost=cost, audit=audit, i=i, given=given, lines=lines):
            longer = given + role[:1]
            if re.fullmatch("s?(ua)*u?", longer) and role[:1]:
                heapq.heappush(heap, (cost + price, audit + letter, i + step, longer, (*lines, f"{role}:{text}")))

        for role in ("user", "assistant"):
            go(3, "I", 0, role, "")
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, given, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                go(more, "K", 1, role, text)
                for new in ("user", "assistant"):
                    go(3 + more, "R", 1, new, text)


def check(frame, rows, **limits):
    got = {r["conv_id"]: [r[c] for c in NAMES] for r in repair.repair(repair.damaged(frame), **limits).collect()}
    assert got == {conv: plain(own) for conv, own in damage(rows).items()}
    return got


def test_query_is_what_plain_python_finds(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    got = check(frame, [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    query = repair.op12_repair(spark, sf)
    assert {r["conv_id"]: [r[c] for c in NAMES] for r in query.collect()} == got
    assert [t for c, t in query.dtypes if c in NAMES] == ["bigint"] * 6 + ["string"] * 2 and any(v[5] for v in got.values())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "s", "", None, "user", "assistant"], ["Hi.", "No!\n", "cut", "", " \t", None, "Ünïcode?", "a", "b.", "c."]
    rows = [(c, rng.choice([None, *range(6)]) if c % 3 else k, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{k}.") for c in range(150) for k in range(rng.randrange(1, 9))]
    # no id, one conversation of dropped rows only, equal rows, a very long text
    return [*rows, (None, None, None, None), (None, 2, "user", "x."), *[(900, 7, "user", "same.")] * 4, (901, 1, "user", "w " * 300_000 + "."), (901, 2, "assistant", "w " * 300_000), *[(c, 0, "user", "x.") for c in range(1000, 1040)]]


COLUMNS = "conv_id long, turn long, role string, text string"


def test_odd_rows(spark, odd):
    got = check(spark.createDataFrame(odd, COLUMNS).withColumns({c: F.lit(1) for c in ("present", "initial", "rows", "_copy", "way", "block")}), odd)
    gone = [v for c, v in got.items() if c and c >= 1000 and v[:7] == [0, 0, 0, 0, 0, 0, ""]]
    assert gone and {v[7] for v in gone} == {hashlib.sha256(b"").hexdigest()}
    assert repair.repair(repair.damaged(spark.createDataFrame([], COLUMNS))).count() == 0


def test_large_conversations_in_blocks(spark, odd, monkeypatch):
    """Blocks of few turns, joined few at a time, give what one row gives."""
    rng = random.Random(6)
    long = [(5000, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["yes.", "no", f"{k}.", f"{k}"])) for k in range(300)]
    monkeypatch.setattr(repair, "BLOCK_TURNS", 7)
    monkeypatch.setattr(repair, "FAN", 3)
    check(spark.createDataFrame(odd + long, COLUMNS), odd + long, most_turns=3)
