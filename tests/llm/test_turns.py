"""Conversation repair against an exhaustive search over edits."""

import collections
import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from incidex.llm import queries, turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    """conversation -> rows after damage, and all conversation ids."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        conversation = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        conversation += [(turn, role, text)] * (2 if k == 3 else 1)
    for conversation in out.values():
        conversation.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found, costs=turns.COSTS):
    """Least (cost, audit, repaired) by trying every edit at every place."""

    @functools.cache
    def best(i, roles, inserted):
        # the pattern only looks at: nothing, s, or the last of u and a
        options = []
        if i == len(rows) and roles in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if follows(roles, role[0]):
                    c, a, r = best(i, role[0], inserted + 1)
                    options.append((c + costs["insert"], "I" + a, ((role, ""), *r)))
        if i < len(rows):
            c, a, r = best(i + 1, roles, 0)
            options.append((c + costs["delete"], "D" + a, r))
            if found[i] in ("", "truncated"):
                extra = costs["cut"] if found[i] else 0
                role, text = rows[i][1:]
                for new, price, letter in ((role, 0, "K"), *((r, costs["rerole"], "R") for r in ("user", "assistant"))):
                    if follows(roles, new[:1]):
                        c, a, r = best(i + 1, new[:1], 0)
                        options.append((c + price + extra, letter + a, ((new, text), *r)))
        return min(options, default=(float("inf"), "", ()))

    return best(0, "", 0)


def follows(last, initial):
    return (last, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def expected(rows, costs=turns.COSTS):
    out = {}
    for conv, left in damage(rows).items():
        found = faults(left)
        cost, audit, repaired = cheapest(left, found, costs)
        timed = sorted({t for t, _, _ in left if t is not None})
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(left, left[1:])]
        out[conv] = (
            timed[-1] - timed[0] + 1 - len(timed) if timed else 0,
            *(found.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        )
    return out


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(3)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            if turn == 0 and rng.random() < 0.3 or rng.random() < 0.05:
                role = "system"
            if rng.random() < 0.05:
                role = rng.choice(["tool", "", "umpire", None])
            text = rng.choice(["Yes.", "No!", "Why?", "and then", f"Say {turn}.", f"Line {conv}\n{turn}. \t", "  ", "", None, "ä€😀.", "\xa0"])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 3]), role, text))
    rows += [(None, t, r, "Hm.") for t, r in enumerate(["user", "assistant", "user"])]
    rows += [(5000, None, "user", "Same."), (5000, None, "user", "Same."), (5000, 2, "user", "Same."), (5001, None, None, None)]
    rows += rows[40:60]
    rows.append((6000, 0, "user", "word " * 60_000 + "."))
    return rows


def as_dict(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = df.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[c] for c in names) for r in got}


def test_query_equals_search_over_all_edits(spark, talk, tmp_path):
    df = spark.createDataFrame(talk, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "kind", "h1", "dealt", "present", "copy", "audit")})
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = expected(talk)
    assert any(w[6] == "" for w in want.values()) and {c for w in want.values() for c in w[6]} == set("KRD")
    assert as_dict(got) == want
    empty = turns.repair(turns.damaged(df.where("1 = 0")), present=F.col("present"))
    assert empty.count() == 0 and empty.columns == got.columns


def test_random_patterns(spark):
    """Short conversations over few texts: many ties of cost."""
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B.", "cut", ""]) + (f"{t}." if rng.random() < 0.5 else "")) for c in range(1500) for t in range(rng.randint(0, 7))]
    df = turns.damaged(spark.createDataFrame(rows, SCHEMA))
    assert as_dict(turns.repair(df, present=F.col("present"))) == expected(rows)
    dear = {"rerole": 2, "delete": 3, "insert": 1, "cut": 2}
    want = expected(rows, dear)
    assert any("I" in w[6] for w in want.values())
    assert as_dict(turns.repair(df, present=F.col("present"), costs=dear)) == want


def test_spilled_conversation_is_the_same(monkeypatch, talk):
    """Rows and back-pointers that go through files give the same edits and turns."""
    rng = random.Random(1)
    rows = [(rng.choice(["user", "assistant", "system"]), rng.choice([f"t{i}.", f"t{i}"])) for i in range(3000)]

    def run():
        conversation = turns.Conversation("=1", turns.Automaton())
        for i, (role, text) in enumerate(rows):
            conversation.row(i, role, text, (i, i))
        audit, cost = conversation.edits()
        return audit, cost, list(conversation.repaired(audit)), conversation._row_file is not None

    held = run()
    monkeypatch.setattr(turns, "SPILL", 10_000)
    spilled = run()
    assert held[:3] == spilled[:3] and not held[3] and spilled[3]
    roles = "".join(r[:1] for r, _ in held[2])
    assert re.fullmatch("(s?(ua)+)?", roles)


def test_repaired_turns(spark, talk):
    df = turns.damaged(spark.createDataFrame(talk, SCHEMA))
    out = collections.defaultdict(list)
    for r in turns.repaired_turns(df, present=F.col("present")).orderBy("conv_id", "place").collect():
        out[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, w in expected(talk).items():
        assert hashlib.sha256("\n".join(out[conv]).encode()).hexdigest() == w[-1]
