import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from carelake.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute_repairs(rows, costs):
    """Least (cost, audit) over all sequences of edits with at most two insertions before a row and at the end."""
    best = None
    n = len(rows)
    for edits in product("DKR", repeat=n):
        if any(e != "D" and r.must_go for e, r in zip(edits, rows, strict=True)):
            continue
        for gaps in product(range(3), repeat=n + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""], strict=True))
            cost = sum(gaps) * costs.insert + sum(costs.delete if e == "D" else (e == "R") * costs.rerole + r.unfinished * costs.unfinished for e, r in zip(edits, rows, strict=True))
            if best is not None and (cost, audit) >= best:
                continue
            # I and R may be either role
            line, i = "", 0
            for e in audit:
                if e == "I":
                    line += "?"
                else:
                    line += {"D": "", "K": rows[i].initial or "x", "R": "?"}[e]
                    i += 1
            if any(re.fullmatch(r"(s?(ua)+)?", "".join(f)) for f in product(*(("u", "a") if c == "?" else (c,) for c in line))):
                best = cost, audit
    return best


@pytest.mark.parametrize("costs", [C.Costs(), C.Costs(rerole=3, delete=5, insert=1, unfinished=2), C.Costs(rerole=1, delete=1, insert=1, unfinished=1)])
def test_least_cost_and_audit(costs):
    r = random.Random(5)
    for trial in range(60):
        rows = tuple(C.Row(r.choice("suaua") if r.random() < 0.9 else "", r.random() < 0.2, r.random() < 0.25) for _ in range(trial % 5))
        want = brute_repairs(rows, costs)
        for size in (1, 2, 5):  # however the rows are cut into blocks
            cut = [rows[i : i + size] for i in range(0, len(rows), size)]
            blocks = [(len(b), {s: C.solve(b, s, costs) for s in range(4)}) for b in cut]
            assert C.join_blocks(blocks, costs) == want


def brute_report(rows):
    """Cost, audit and the rest by a plain search over (cost, audit) pairs, on damaged rows in order."""
    kinds, seen = [], set()
    blank = duplicate = truncated = 0
    for _, role, text in rows:
        is_blank = not re.search(r"[^\x20\x09-\x0D]", text)
        is_dup = not is_blank and (role, text) in seen
        is_open = not (is_blank or is_dup) and text.strip(" \t\n\v\f\r")[-1] not in ".!?"
        seen.add((role, text))
        blank, duplicate, truncated = blank + is_blank, duplicate + is_dup, truncated + is_open
        kinds.append((role[:1], is_blank or is_dup, is_open))
    states = {"": (0, "", ())}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, a, done) in list(out.items()):
                new = (c + 5, a + "I", done + ((after[s], None),))
                if after[s] not in out or new[:2] < out[after[s]][:2]:
                    out[after[s]] = new
        return out

    for i, (c0, gone, unfinished) in enumerate(kinds):
        nxt = {}
        for s, (c, a, done) in inserted(states).items():
            options = [(s, (c + 2, a + "D", done))]
            if not gone:
                more = 5 * unfinished
                if c0 == after[s] or (c0 == "s" and s == ""):
                    options.append((c0, (c + more, a + "K", done + ((c0, i),))))
                options.append((after[s], (c + more + 1, a + "R", done + ((after[s], -1 - i),))))
            for t, new in options:
                if t not in nxt or new[:2] < nxt[t][:2]:
                    nxt[t] = new
        states = nxt
    cost, audit, done = min((v for s, v in inserted(states).items() if s in ("", "a")), key=lambda v: v[:2])
    lines = []
    for role, i in done:
        name = {"u": "user", "a": "assistant"}.get(role)
        lines.append(f"{name}:" if i is None else f"{rows[i][1]}:{rows[i][2]}" if i >= 0 else f"{name}:{rows[-1 - i][2]}")
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [k[0] for k in kinds]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(key.encode()) % 20
        mine = out.setdefault(conv, [])
        if fate:
            row = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            mine += [row] * (2 if fate == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: sorted(rows, key=order) for conv, rows in out.items()}


def conversations():
    r = random.Random(11)
    texts = ["Yes.", "No!", "why", "because it is so", "", " \t", None, "Ends here?  \n", "é 漢字.", "a" * 200_000 + "."]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None, "User"]) if r.random() < 0.3 else ("user", "assistant")[t % 2], r.choice(texts)) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t % 700}.") for t in range(1500)]  # longer than a block, with late duplicates
    rows += [(101, None, "user", "a."), (101, 3, "assistant", "b."), (101, None, "user", "a."), (101, 9, "user", "q?"), (101, 9, "assistant", "q?"), (102, None, None, None)]
    rows += [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (None, None, "system", "z.")]
    rows += [(200 + i, 0, "user", "hello.") for i in range(60)]  # some lose their only row
    return rows


@pytest.fixture(scope="module")
def table(spark):
    extra = {c: F.lit(i) for i, c in enumerate(("pos", "block", "fate", "digest", "first", "is_row", "audit", "cost", "gaps"))}
    return spark.createDataFrame(conversations(), SCHEMA).repartition(5).withColumns(extra)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_report_equals_brute_force(table):
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in C.repair_report(C.damaged(table)).collect()}
    want = {conv: brute_report(rows) for conv, rows in damage(conversations()).items()}
    assert got == want
    assert (0, 0, 0, 0, 0, 0, "", EMPTY) in got.values() and len(got[100][6]) > 1000


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "user", "r."), (2, 0, "assistant", "a."), (2, 1, "user", "b"), (3, 5, "user", "only.")]
    df = spark.createDataFrame(rows, SCHEMA)
    plans = C.repair_plans(df)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in plans.collect()} == {1: (1, "KKR"), 2: (4, "DD"), 3: (2, "D")}
    got = [tuple(r) for r in C.repaired_turns(df, plans).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "assistant", "r.")]


def test_insertions_when_they_are_cheap(spark):
    df = spark.createDataFrame([(1, 0, "user", "q?"), (1, 1, "user", "r?")], SCHEMA)
    costs = C.Costs(rerole=9, delete=9, insert=1)
    plans = C.repair_plans(df, costs)
    assert [(r["cost"], r["audit"]) for r in plans.collect()] == [(2, "KIKI")]
    got = [tuple(r)[1:] for r in C.repaired_turns(df, plans).orderBy("place").collect()]
    assert got == [(0, "user", "q?"), (1, "assistant", ""), (2, "user", "r?"), (3, "assistant", "")]
    with pytest.raises(ValueError):
        C.repair_plans(df, C.Costs(insert=0))


def test_no_rows(spark):
    assert C.repair_report(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_undamaged_rows_and_rows_that_are_gone(spark):
    df = spark.createDataFrame([(1, 0, "user", "q?", False), (1, 1, "assistant", "r.", None), (2, 0, "user", "x.", True)], SCHEMA + ", gone boolean")
    got = {r["conv_id"]: (r["cost"], r["audit"], r["repaired_sha256"]) for r in C.repair_report(df).collect()}
    assert got == {1: (0, "KK", hashlib.sha256(b"user:q?\nassistant:r.").hexdigest()), 2: (0, "", EMPTY)}
