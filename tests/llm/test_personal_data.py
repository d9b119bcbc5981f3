import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from llm_edges import edge_docs, no_docs, sentence  # noqa: F401

from carelake.llm import personal_data as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    parts = ["1", "25", "0", "300", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "4111111111111111", "é", "555", "x@y.z", "1.2.3.4", "+1 555 123 4567", "\n", "0001"]
    found = 0
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert P.base_spans(text) == plain_spans(text), text
        found += bool(plain_spans(text))
    assert found > 5000
    assert P.base_spans("") == [] and P.base_spans("1.2.3." + "9" * 6000) == [] and P.base_spans("1.2.3." + "0" * 6000 + "9") != []


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "+1 ", "@", "a@", "+1(", "x@y.z ", "1-", "a1234567 "])
def test_long_texts_take_linear_time(unit):
    text = unit * (400_000 // len(unit))
    start = time.perf_counter()
    P.instances(text, P.base_spans(text))
    assert time.perf_counter() - start < 5


def members():
    """Seeds after two cues; staff numbers share one of them, and lead to a third cue that has no seed at all."""
    r = random.Random(8)
    rows = []
    for i in range(12):
        rows.append(f"{sentence(i, 9)} please contact member: user{i}@mail.example.org today {sentence(i + 50, 5)}")
        rows.append(f"{sentence(i + 100, 7)} please call +1 (212) 555-{1000 + i} {sentence(i, 4)}")
    for i in range(5):
        rows.append(f"{sentence(i + 200, 6)} please contact member: EMP-77{i}4{i} {sentence(i, 3)}")
        rows.append(f"{sentence(i + 300, 6)} badge number emp-77{i}4{i}. {sentence(i, 3)}")
    rows.append("the badge number X9-44321 is new, so is badge number=Z9-55432, not version 20240101 or build 20240102")
    rows += [f"{sentence(i + 400, 4)} build {r.randrange(10**7, 10**8)} {sentence(i, 3)}" for i in range(20)]
    rows += [f"{sentence(i + 500, 30)} of the" for i in range(20)] + [f"of the a{i}@b.example.org" for i in range(4)] + ["of the words of the and of the " * 30] + ["of the S1234567"]
    return rows


def brute_report(rows, rounds=P.ROUNDS):
    word = re.compile("[^" + re.escape(P._DELIMITERS) + "]+")
    edges, times, follow, uses = {}, Counter(), Counter(), []
    for n, text in enumerate(rows):
        text = text or ""
        spans = plain_spans(text)
        words = [(m.start(), m.end(), m[0].translate(P._LOWER)) for m in word.finditer(text)]
        for i in range(1, len(words)):
            follow[words[i - 1][2]] += 1
            if i > 1:
                follow[words[i - 2][2] + " " + words[i - 1][2]] += 1
        items = [(a, b, True) for a, _, b in spans]
        for a, b, _ in words:
            t = text[a:b]
            s = a + len(t) - len(t.lstrip(".!?"))
            t = t.strip(".!?")
            if not any(x < b and a < y for x, _, y in spans) and len(t) >= 6 and ("@" in t or len(re.findall("[0-9]", t)) >= 4):
                items.append((s, s + len(t), False))
        for a, b, seed in items:
            before = [w for x, _, w in words if x <= a][:-1][-2:]
            name = text[a:b].translate(P._LOWER)
            for context in [" ".join(before[k:]) for k in range(len(before))]:
                edges[context, name] = edges.get((context, name), False) or seed
                times[context] += 1
            if not seed:
                uses.append((n, a, b, name))
    fillers = defaultdict(set)
    for context, name in edges:
        fillers[context].add(name)
    telling = {c for c, f in fillers.items() if len(f) >= P.MIN_SUPPORT and times[c] >= P.MIN_SHARE * follow[c]}
    score = {e: float(s) for e, s in edges.items() if e[0] in telling}
    new = {}
    for _ in range(rounds):
        confidence = {}
        for c in telling:
            values = [score[c, name] for name in fillers[c]]
            if sum(v >= P.MIN_SCORE for v in values) >= P.MIN_SUPPORT and sum(values) / (len(values) + 1) >= P.MIN_CONFIDENCE:
                confidence[c] = sum(values) / (len(values) + 1)
        new = {}
        for (c, name), seed in edges.items():
            if c in confidence and not seed:
                new[name] = new.get(name, 1.0) * (1 - confidence[c])
        new = {name: 1 - doubt for name, doubt in new.items()}
        score = {e: 1.0 if edges[e] else new.get(e[1], 0.0) for e in score}
    out = []
    for n, text in enumerate(rows):
        base = plain_spans(text or "")
        spans = sorted(base + [(a, 4, b) for m, a, b, name in uses if m == n and new.get(name, 0) >= P.MIN_SCORE])
        text_of = lambda s: ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in s)
        out.append((*(sum(k == j for _, k, _ in spans) for j in range(5)), hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(spans)))
    return out


COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "n_context", "base_sha256", "spans")


@pytest.mark.parametrize("options", [{}, {"filter_bits": 64}, {"rounds": 1}])
def test_report_equals_brute_force(spark, options):
    rows = members()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in P.personal_data_report(docs, **options).collect()}
    assert [got[i] for i in range(len(rows))] == brute_report(rows, options.get("rounds", P.ROUNDS))


def test_unseen_identifiers_are_found_and_others_are_not(spark):
    rows = members()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: {rows[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == 4} for r in P.find_personal_data(docs).collect()}
    found = set().union(*got.values())
    assert {f"EMP-77{i}4{i}" for i in range(5)} | {f"emp-77{i}4{i}" for i in range(5)} | {"X9-44321", "Z9-55432"} == found


def test_edge_rows(edge_docs, no_docs, spark):
    rows = edge_docs.collect()
    got = sorted((tuple(r) for r in P.personal_data_report(edge_docs).select("doc_id", *COLUMNS).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *x) for r, x in zip(rows, brute_report([r["text"] for r in rows]), strict=True)), key=repr)
    assert P.personal_data_report(no_docs).count() == 0
    same = spark.createDataFrame([(1, "mail a.b@c.example.org"), (1, "mail a.b@c.example.org"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_email"] for r in P.personal_data_report(same).collect()) == [0, 1, 1]
