"""Conversation repair against a plain restatement that walks the turns once with the cheapest edits of each state."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tarnwick.llm import turn_repair
from tarnwick.llm.queries import ORACLES, QUERIES

WHITE = " \t\n\x0b\x0c\r"
AFTER = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def cheapest(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(WHITE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))

    def keep(best, state, value):
        if state not in best or value[:2] < best[state][:2]:
            best[state] = value

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                keep(best, AFTER[state][0], (cost + 3, audit + "I", (*lines, AFTER[state] + ":")))
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        now = {}
        for state, (cost, audit, lines) in best.items():
            keep(now, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            keep(now, AFTER[state][0], (cost + 3 + more, audit + "R", (*lines, f"{AFTER[state]}:{text}")))
            if role[:1] == AFTER[state][0] or role[:1] == "s" and state == "":
                keep(now, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
        best = inserted(now)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns, first = [t for t, _, _ in rows if t is not None], [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64]))
    return out


def wanted(df):
    rows = df.select("conv_id", "turn", "role", "text").collect()
    return {c: cheapest(v) for c, v in damaged(map(tuple, rows)).items()}


def found(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def test_query_by_sql(spark, sf_dir, duck, same):
    same(QUERIES["op13_turn_matrices"](spark, sf_dir), duck.execute(ORACLES["op13_turn_matrices"]).fetch_df())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, conversations longer than a run, turns that tie, roles of no pattern, clashing columns."""
    pick, rows = random.Random(5), []
    for conv in (None, 1, 2, 3, 4):
        for _ in range(250 if conv in (None, 2) else 7):
            text = pick.choice([None, "", "hi.", "what?", "a b", "x! ", " \n", f"Text {pick.randrange(60)}."])
            rows.append((conv, pick.choice([None, *range(200)]), pick.choice(["user", "assistant", "system", None, "tool", ""]), text, 1, "x"))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, RUN int, dropped string").repartition(3)


def test_query(spark, sf_dir):
    got = found(QUERIES["op13_turn_matrices"](spark, sf_dir))
    assert got == wanted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@pytest.mark.parametrize("run_turns", [4096, 1])
def test_runs_and_levels(odd, run_turns):
    made = turn_repair.repair(turn_repair.damage(odd), dropped_col="dropped", run_turns=run_turns, fan=2)
    assert found(made) == wanted(odd)


def test_repaired_turns(odd):
    want, text = wanted(odd), {}
    made = turn_repair.repair(turn_repair.damage(odd), dropped_col="dropped", with_turns=True, run_turns=5, fan=2)
    for r in sorted(made.collect(), key=lambda r: r["run"]):
        text.setdefault(r["conv_id"], []).extend(f"{x['role']}:{x['text']}" for x in r["turns"])
    assert {c: hashlib.sha256("\n".join(text.get(c, [])).encode()).hexdigest() for c in want} == {c: v["repaired_sha256"] for c, v in want.items()}


def test_all_dropped_and_empty(spark, odd):
    gone = turn_repair.repair(odd.withColumn("gone", F.lit(True)), dropped_col="gone")
    nothing = {k: 0 for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert found(gone) == dict.fromkeys((None, 1, 2, 3, 4), nothing)
    assert turn_repair.repair(odd.limit(0)).collect() == []


def test_very_long_texts(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "word " * 200_000 + f"{k}.") for k in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(turn_repair.repair(turn_repair.damage(df), dropped_col="dropped")) == wanted(df)


def test_products_are_associative():
    kinds = [(r, g, t) for r in ("s", "u", "a", "") for g, t in ((False, False), (False, True), (True, False))]
    pick = random.Random(3)
    for _ in range(200):
        a, b, c = (turn_repair.turn_matrix(*pick.choice(kinds)) for _ in range(3))
        assert turn_repair.product(turn_repair.product(a, b), c) == turn_repair.product(a, turn_repair.product(b, c))
