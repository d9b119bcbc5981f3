import re
from itertools import permutations

import numpy as np
import pytest
from llm_edges import edge_docs, no_docs  # noqa: F401

from carelake.llm import filter_audit as A

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute_audit(docs, labels):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and t in least and d > least[t],
        }
        rows.append((s or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(p, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(p), step] = [
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for p in permutations("ABCDE"):
            for step, f in enumerate(p, 1):
                out[part, "".join(p), step].append(shapley[f])
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (4, 0, 1), (4, 1, None), (19, 1, 1), (None, 1, 1), (11, 1, 1), (12, None, 1), (999, 1, 1), (20, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("shard_bytes", [A.SHARD_BYTES, 400])
def test_audit_equals_brute_force(edge_docs, labels, shard_bytes):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in A.filter_audit(edge_docs, labels, shard_bytes).collect())
    docs = [(r["doc_id"], r["text"], r["source"]) for r in edge_docs.collect()]
    assert got == brute_audit(docs, [tuple(r) for r in labels.collect()])
    assert len(got) == 600 * len({s or "" for *_, s in docs})


def test_marks_capitals_and_shares_at_their_limits(spark):
    texts = ["a|b", "50% of", "x" * 95 + "ABCDE", "x" * 94 + "ABCDEF", " ".join(f"w{i}" for i in range(65)) + " w0" * 35, " ".join(f"w{i}" for i in range(64)) + " w0" * 36, "Ä" * 20, ""]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    got = {r["doc_id"]: r["fails"] for r in A.failed_filters(docs).collect()}
    assert got == {0: "AD", 1: "AD", 2: "A", 3: "AC", 4: "", 5: "B", 6: "A", 7: "A"}


def test_empty_tables(spark, no_docs, edge_docs, labels):
    assert A.filter_audit(no_docs, labels).count() == 0
    unlabelled = A.filter_audit(edge_docs, labels.limit(0))
    assert unlabelled.count() > 0 and unlabelled.where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("bucket_bytes", [A.BUCKET_BYTES, 100])
def test_matrix_holds_every_word_once(spark, edge_docs, bucket_bytes):
    vocabulary, matrix = A.term_matrix(edge_docs, 400, bucket_bytes)
    pairs = [(r["term"], r["word"]) for r in vocabulary.collect()]
    words = dict(pairs)
    texts = [re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in edge_docs.collect()]
    assert len(words) == len(pairs) and sorted(words.values()) == sorted({w for t in texts for w in t})
    rows = []
    for s in matrix.collect():
        indptr, codes, counts = (np.frombuffer(s[c], k) for c, k in (("indptr", np.int64), ("codes", np.int64), ("counts", np.int32)))
        for a, b in zip(indptr, indptr[1:], strict=False):
            assert (np.diff(codes[a:b]) > 0).all()
            rows.append(sorted((words[c], int(n)) for c, n in zip(codes[a:b], counts[a:b], strict=True)))
    assert sorted(rows) == sorted(sorted((w, t.count(w)) for w in set(t)) for t in texts)
