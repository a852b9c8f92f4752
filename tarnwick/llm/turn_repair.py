"""Conversation structure repair: a min-plus matrix scan over turns.

The roles of a well-formed conversation read `(s?(ua)+)?`. Four states know how far that pattern has come, and each turn is a
4x4 matrix over (cost, audit) elements: the cheapest edits, and their letters, that lead from one state to another. Elements
are added by concatenation and chosen by least cost, then least letters. The closure of insertions is multiplied in before
each turn, and once at the end. Products are associative, so a conversation is reduced as a tree: first in runs of turns
inside a task, then run by run inside a partition, then over groups of partitions. A sweep down the same tree gives each run
the states that it begins and ends with, hence its edits.

Choosing by least letters is safe: two different elements of equal cost for the same turns are never the one a prefix of the
other, because what follows a prefix could only be insertions, which cost.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnwick.llm.common import materialize, pick, release

#: Characters that count as white space, as a trim set.
_BLANK = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
#: Turns and bytes that a task holds of one conversation; what is longer is reduced in runs.
RUN_TURNS, RUN_BYTES = 4096, 4_000_000
#: Runs of several partitions are joined by so many partitions at a time.
FAN = 64

Matrix = dict[tuple[int, int], tuple[int, str]]
ONE: Matrix = {(k, k): (0, "") for k in range(4)}


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, letters) in a.items():
        for j in range(4):
            if (k, j) in b:
                more = b[k, j]
                found = (cost + more[0], letters + more[1])
                if (i, j) not in out or found < out[i, j]:
                    out[i, j] = found
    return out


def added(a: Matrix, b: Matrix) -> Matrix:
    return {p: min(x[p] for x in (a, b) if p in x) for p in a.keys() | b.keys()}


#: Any number of insertions: powers of one insertion, of which more than three never pay.
INSERTS: Matrix = ONE
for _ in range(3):
    INSERTS = added(ONE, product(INSERTS, {(i, j): (INSERT, "I") for i, j in NEXT.items()}))


@lru_cache(64)
def turn_matrix(initial: str, must_go: bool, truncated: bool) -> Matrix:
    """Insertions, then this turn kept, given the other role, or deleted."""
    edits = {(k, k): (DELETE, "D") for k in range(4)}
    if not must_go:
        extra = TRUNCATED if truncated else 0
        edits = added(edits, {(i, j): (REROLE + extra, "R") for i, j in NEXT.items()})
        keep = {"s": {(0, 1)}, "u": {(i, j) for i, j in NEXT.items() if j == 2}, "a": {(2, 3)}}.get(initial, set())
        edits = added(edits, {p: (extra, "K") for p in keep})
    return product(INSERTS, edits)


def reduced(matrices: list[Matrix]) -> Matrix:
    """The product, by halves: letters are copied as often as the tree is deep."""
    while len(matrices) > 1:
        matrices = [product(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0] if matrices else ONE


@lru_cache(50_000)
def _few(kinds: tuple) -> Matrix:
    return reduced([turn_matrix(*k) for k in kinds])


def matrix_of(kinds: list[tuple]) -> Matrix:
    """Product of turns; runs of six turns that occur often are looked up."""
    return reduced([_few(tuple(kinds[k : k + 6])) for k in range(0, len(kinds), 6)])


#: Turns that are inserted at the end, by the state before.
CLOSING = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def finished(matrix: Matrix) -> tuple[int, int, str]:
    """(end state before the last insertions, cost, letters) of the cheapest whole repair."""
    ends = [(cost + INSERTS[k, j][0], letters + INSERTS[k, j][1], k) for (i, k), (cost, letters) in matrix.items() if i == 0 for j in (0, 3) if (k, j) in INSERTS]
    cost, letters, k = min(ends)
    return k, cost, letters


def applied(state: int, letters: str, turns: list[tuple[str, str]]) -> tuple[int, list[tuple[str, str, str]]]:
    """The state after the edits, and (role, text, letter) of what they leave."""
    out, k = [], 0
    for x in letters:
        if x == "I":
            state = NEXT[state]
            out.append((ROLE[state], "", x))
            continue
        role, text = turns[k]
        k += 1
        if x == "R":
            state = NEXT[state]
            out.append((ROLE[state], text, x))
        elif x == "K":
            state = 1 if role[:1] == "s" else NEXT[state]
            out.append((role, text, x))
    return state, out


# -- what a run of turns says about itself, and how two runs add up ------------------------------------------

_SUMS = ("blank", "duplicate", "truncated", "illegal")
_ENDS = ("n", "low", "high", "different", "head", "tail")
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def described(turns: list, roles: list[str], faults: list[str]) -> dict:
    known = [t for t in turns if t is not None]
    first = [r[:1] for r in roles]
    out = {"n": len(roles), "low": known[0] if known else None, "high": known[-1] if known else None, "different": len(set(known)), "head": first[0] if first else None, "tail": first[-1] if first else None}
    return out | {k: faults.count(k) for k in _SUMS[:3]} | {"illegal": sum(p not in _LEGAL for p in zip(first, first[1:], strict=False))}


def joined(a: dict, b: dict) -> dict:
    """Of two runs that follow each other in the order of turns."""
    if not a["n"] or not b["n"]:
        return b if not a["n"] else a
    same = a["high"] is not None and a["high"] == b["low"]
    out = {"n": a["n"] + b["n"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"], "different": a["different"] + b["different"] - same, "head": a["head"], "tail": b["tail"]}
    return out | {k: a[k] + b[k] for k in _SUMS} | {"illegal": a["illegal"] + b["illegal"] + ((a["tail"], b["head"]) not in _LEGAL)}


def gaps(x: dict) -> int:
    return 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["different"]


def _kinds(roles, faults) -> list[tuple]:
    return [(r[:1] if r[:1] in ("s", "u", "a") else "", f in ("blank", "duplicate"), f == "truncated") for r, f in zip(roles, faults, strict=True)]


# -- the contract's damage --------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: each turn changed as crc32 of `conv_id:turn` modulo 20 says (nulls are one space).

    0 marks it dropped, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    t = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = t.withColumn("_d", F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20)
    role = F.when(F.col("_d") == 4, "user").otherwise(shown("role"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    t = t.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_d") == 0).alias("dropped"), "_d")
    return t.withColumn("_copy", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_d", "_copy")


# -- the operator -------------------------------------------------------------------------------------------

_DONE = ["gaps", *_SUMS, "cost"]
_CELLS = "places array<int>, costs array<long>, audits array<string>"
_ABOUT = "n long, low long, high long, different long, head string, tail string, " + ", ".join(f"{k} long" for k in _SUMS)


def _fields(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _cells(m: Matrix) -> tuple[list, list, list]:
    return [4 * i + j for i, j in m], [c for c, _ in m.values()], [a for _, a in m.values()]


def _matrix(places, costs, audits) -> Matrix:
    return {divmod(p, 4): (c, a) for p, c, a in zip(places, costs, audits, strict=True)}


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None, with_turns: bool = False, run_turns: int = RUN_TURNS, fan: int = FAN) -> DataFrame:
    """Per conversation: id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by turn (nulls first); of one turn by role, the text's first 64 characters and its digest. A null role or
    text is one space. Rows whose `dropped_col` is true are not there, but their conversation has a row, of zeros and
    empty texts if nothing of it is left. Rows with a null id are one conversation; an empty table has no rows; repeated
    turns are duplicates; a role that begins with none of s, u, a can't be kept. Other columns are not read, whatever their
    names. A conversation of any length is reduced in runs of `run_turns` turns; only its digest, which is defined
    over the whole text in order, is taken by one task, as a stream.

    with_turns: instead, per run of turns, id_col, run (ascending within a conversation) and turns, an array of the repaired
    conversation's (role, text, edit).
    """
    names = {"_id": id_col, "turn": turn_col, "role": role_col, "text": text_col} | ({"dropped": dropped_col} if dropped_col else {})
    t = pick(conversations, **names)
    t = t if dropped_col else t.withColumn("dropped", F.lit(False))
    kind = t.schema["_id"].dataType.simpleString()
    shown = lambda c: F.coalesce(F.col(c), F.lit(" "))
    t = t.select("_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"))
    core = F.rtrim("text", F.lit(_BLANK))
    own = F.when(core == "", "blank").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    t = t.withColumn("fault", own).withColumn("digest", digest).withColumn("_head", F.left("text", F.lit(64))).withColumn("_n", F.monotonically_increasing_id())
    order = [F.col("_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_head", "digest", "_n"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "turn", "role", "text", "dropped", "fault", "digest")
    columns = ["turn", "role", "text", "dropped", "fault", "digest"]
    lists = "turn array<long>, role array<string>, text array<string>, dropped array<boolean>, fault array<string>, digest array<binary>"
    edited = "turns array<struct<role:string,text:string,edit:string>>"
    schema = f"_id {kind}, run long, part int, {', '.join(f'{k} long' for k in _DONE)}, audit string, repaired_sha256 string, {edited}, {lists}"
    to = _fields(schema)

    def whole(c, run, part, rows):
        """The result of a conversation that a task has all turns of."""
        seen, kept, faults = set(), [], []
        for turn, role, text, dropped, fault, digest in rows:
            if not dropped:
                faults.append("duplicate" if fault != "blank" and digest in seen else fault)
                seen.add(digest)
                kept.append((turn, role, text))
        about = described([x[0] for x in kept], [x[1] for x in kept], faults)
        _, cost, audit = finished(matrix_of(_kinds([x[1] for x in kept], faults)))
        _, left = applied(0, audit, [x[1:] for x in kept])
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x, _ in left).encode()).hexdigest()
        out = {"_id": c, "run": run, "part": part, "gaps": gaps(about), "cost": cost, "audit": audit, "repaired_sha256": sha}
        return out | {k: about[k] for k in _SUMS} | ({"turns": [{"role": r, "text": x, "edit": e} for r, x, e in left]} if with_turns else {})

    def scan(batches):
        """Whole conversations are finished; the first and last of a partition, and very long ones, are passed on in runs."""
        part, n = TaskContext.get().partitionId(), 0
        current, held, size, open_ = None, [], 0, True
        began = False

        def flush(last: bool):
            nonlocal n
            n += 1
            run = (part << 33) + n
            if last and not open_:
                return whole(current, run, part, held)
            return {"_id": current, "run": run, "part": part} | {c: [r[k] for r in held] for k, c in enumerate(columns)}

        for b in batches:
            out = []
            ids = b.column(0).to_pylist()
            for c, row in zip(ids, zip(*(b.column(k).to_pylist() for k in range(1, 7)), strict=True), strict=True):
                if began and c != current:
                    if held:
                        out.append(flush(True))
                    held, size, open_ = [], 0, False
                elif len(held) >= run_turns or size > RUN_BYTES:
                    open_ = True
                    out.append(flush(False))
                    held, size = [], 0
                began, current = True, c
                held.append(row)
                size += len(row[2])
            if out:
                yield pa.RecordBatch.from_pylist(out, to)
        if held:
            yield pa.RecordBatch.from_pylist([flush(False)], to)

    parts = materialize(t.mapInArrow(scan, schema), "turns")
    whole_ones = parts.filter("repaired_sha256 is not null")
    runs = parts.filter("repaired_sha256 is null").select("_id", "run", "part", *columns)
    # first places of what is said: duplicates are all others
    said = runs.select("_id", "run", F.posexplode(F.arrays_zip("digest", "dropped")).alias("at", "x")).filter("not x.dropped")
    firsts = said.groupBy("_id", "x.digest").agg(F.min(F.struct("run", "at")).alias("f")).groupBy("f.run").agg(F.collect_list("f.at").alias("firsts"))
    judged = runs.drop("digest").join(firsts, "run", "left")

    def live(row):
        """(turn, role, text, fault) of a run's turns that are there."""
        first = set(row["firsts"] or ())
        every = zip(row["turn"], row["role"], row["text"], row["dropped"], row["fault"], strict=True)
        return [(n, r, x, "duplicate" if f != "blank" and k not in first else f) for k, (n, r, x, gone, f) in enumerate(every) if not gone]

    def reduce_runs(batches):
        for b in batches:
            out = {k: [] for k in ("_id", "run", "part", "places", "costs", "audits", *_ENDS, *_SUMS)}
            for row in b.to_pylist():
                turns = live(row)
                faults = [x[3] for x in turns]
                m = matrix_of(_kinds([x[1] for x in turns], faults))
                about = described([x[0] for x in turns], [x[1] for x in turns], faults)
                for k, v in ({"_id": row["_id"], "run": row["run"], "part": row["part"]} | dict(zip(("places", "costs", "audits"), _cells(m), strict=True)) | about).items():
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, up)

    level_schema = f"_id {kind}, run long, part int, {_CELLS}, {_ABOUT}"
    up = _fields(level_schema)

    def combine(by: int):
        def apply(group: pa.Table) -> pa.Table:
            """Runs of one conversation that follow each other become one."""
            rows = sorted(group.to_pylist(), key=lambda r: r["run"])
            about = {k: rows[0][k] for k in (*_ENDS, *_SUMS)}
            for r in rows[1:]:
                about = joined(about, r)
            cells = _cells(reduced([_matrix(r["places"], r["costs"], r["audits"]) for r in rows]))
            return pa.Table.from_pylist([{"_id": rows[0]["_id"], "run": rows[0]["run"], "part": rows[0]["part"] // by} | dict(zip(("places", "costs", "audits"), cells, strict=True)) | about], up)

        return apply

    levels = [materialize(judged.mapInArrow(reduce_runs, level_schema), "turns-runs")]
    n_parts = (parts.agg(F.max("part")).first()[0] or 0) + 1
    steps = [1]  # first all runs of a partition, then groups of partitions until one is left
    while n_parts > 1:
        steps.append(fan)
        n_parts = -(-n_parts // fan)
    of = lambda by: F.floor(F.col("part") / by).cast("int")
    for by in steps:
        levels.append(materialize(levels[-1].groupBy("_id", of(by).alias("_of")).applyInArrow(combine(by), level_schema), "turns-level"))

    def ended(batches):
        """The whole conversation: its result and its end state."""
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                k, cost, audit = finished(_matrix(r["places"], r["costs"], r["audits"]))
                out.append({"_id": r["_id"], "run": r["run"], "part": r["part"], "begins": 0, "ends": k, "cost": cost, "audit": audit, "gaps": gaps(r)} | {s: r[s] for s in _SUMS})
            yield pa.RecordBatch.from_pylist(out, top_schema)

    top_text = f"_id {kind}, run long, part int, begins int, ends int, {', '.join(f'{k} long' for k in _DONE)}, audit string"
    top_schema = _fields(top_text)
    top = materialize(levels[-1].mapInArrow(ended, top_text), "turns-top")

    def split(group: pa.Table) -> pa.Table:
        """States of each run inside the run that it is part of."""
        rows = sorted(group.to_pylist(), key=lambda r: r["run"])
        ms = [_matrix(r["places"], r["costs"], r["audits"]) for r in rows]
        reach = [{rows[0]["begins"]: (0, "", None)}]
        for m in ms:
            now: dict = {}
            for k, (cost, letters, _) in reach[-1].items():
                for j in range(4):
                    if (k, j) in m:
                        found = (cost + m[k, j][0], letters + m[k, j][1], k)
                        if j not in now or found[:2] < now[j][:2]:
                            now[j] = found
            reach.append(now)
        state, out = rows[0]["ends"], []
        for r, now in zip(reversed(rows), reversed(reach[1:]), strict=True):
            before = now[state][2]
            out.append({"run": r["run"], "begins": before, "ends": state})
            state = before
        return pa.Table.from_pylist(out, pa.schema([("run", pa.int64()), ("begins", pa.int32()), ("ends", pa.int32())]))

    states = top.select("_id", F.col("part").alias("_p"), "begins", "ends")
    for level, by in zip(reversed(levels[:-1]), reversed(steps), strict=True):
        inside = level.withColumn("_of", of(by)).alias("l").join(states.alias("s"), F.col("l._id").eqNullSafe(F.col("s._id")) & (F.col("l._of") == F.col("s._p"))).select("l.*", "begins", "ends")
        found = inside.groupBy("_id", "_of").applyInArrow(split, "run long, begins int, ends int")
        states = level.select("_id", "run", F.col("part").alias("_p")).join(found, "run")
    edits = F.element_at(F.map_from_arrays("places", "audits"), F.col("begins") * 4 + F.col("ends"))
    chosen = materialize(levels[0].select("run", "places", "audits").join(states.select("run", "begins", "ends"), "run").select("run", "begins", edits.alias("edits")), "turns-edits")

    def rewrite(batches):
        """The repaired text of each run, with a line feed before each turn."""
        for b in batches:
            out = []
            for row in b.to_pylist():
                state, left = applied(row["begins"], row["edits"], [x[1:3] for x in live(row)])
                out.append({"_id": row["_id"], "run": row["run"], "state": state, "data": "".join(f"\n{r}:{x}" for r, x, _ in left).encode(), "turns": [{"role": r, "text": x, "edit": e} for r, x, e in left] if with_turns else None})
            yield pa.RecordBatch.from_pylist(out, text_schema)

    text_text = f"_id {kind}, run long, state int, data binary, {edited}"
    text_schema = _fields(text_text)
    texts = judged.join(chosen, "run").mapInArrow(rewrite, text_text)
    if with_turns:
        closing = F.create_map(*(x for k, after in CLOSING.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(ROLE[j]).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")) for j in after)) if after else F.array().cast("array<struct<role:string,text:string,edit:string>>"))))
        tails = top.select("_id", F.lit(1 << 62).alias("run"), F.element_at(closing, F.col("ends")).alias("turns")).filter(F.size("turns") > 0)
        every = whole_ones.select("_id", "run", "turns").unionByName(texts.select("_id", "run", "turns")).unionByName(tails)
        return every.select(F.col("_id").alias(id_col), "run", "turns")

    def hashed(batches):
        """Digests of conversations whose runs come in order."""
        current, sha, began, fresh, state = None, None, False, True, 0
        ids, found = [], []

        def close():
            end = "".join(f"\n{ROLE[k]}:" for k in CLOSING[state])
            sha.update((end[1:] if fresh else end).encode())
            ids.append(current)
            found.append(sha.hexdigest())

        for b in batches:
            for c, s, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if not began or c != current:
                    if began:
                        close()
                    current, sha, began, fresh = c, hashlib.sha256(), True, True
                state = s
                if data:
                    sha.update(data[1:] if fresh else data)
                    fresh = False
        if began:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(ids, to.field("_id").type), pa.array(found, pa.string())], ["_id", "repaired_sha256"])

    # sha-256 is taken over the text in order: one task a conversation, which streams its runs
    streamed = texts.select("_id", "state", "data", "run").repartition("_id").sortWithinPartitions(F.col("_id").asc_nulls_first(), "run").select("_id", "state", "data")
    digests = streamed.mapInArrow(hashed, f"_id {kind}, repaired_sha256 string")
    long_ones = top.alias("t").join(digests.alias("d"), F.col("t._id").eqNullSafe(F.col("d._id"))).select("t._id", *(f"t.{k}" for k in _DONE), "t.audit", "d.repaired_sha256")
    out = materialize(long_ones, "turns-long")
    release(*levels, top, chosen)
    made = whole_ones.select("_id", *_DONE, "audit", "repaired_sha256").unionByName(out)
    return made.select(F.col("_id").alias(id_col), *_DONE, "audit", "repaired_sha256")
