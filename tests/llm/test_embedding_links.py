import numpy as np
import pytest

from carelake.llm import embedding_dedup as E


def brute(rows):
    links = {}
    for i, v in rows:
        links[i] = 0
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            for j, w in rows:
                if j != i and w and len(w) == len(v) and all(c is not None and np.isfinite(c) for c in w) and any(w):
                    links[i] += float(np.dot(E.unit(np.array([v]))[0], E.unit(np.array([w]))[0])) >= 0.9
    return links


@pytest.mark.parametrize("block", [E.BLOCK, 40])
def test_every_length_links_with_its_own(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "CELL", 20)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(0, 1, (60, 4))[r.integers(0, 60, 200)] + r.normal(0, 0.15, (200, 4)))]
    rows += [(1000 + i, [float(x) for x in v]) for i, v in enumerate(r.normal(0, 1, (50, 3)))] + [(2000, [1.0, 0.0]), (2001, [1.0, 0.0]), (2002, [2.0, 0.1]), (2003, [0.0, 1.0])]
    rows += [(3000, None), (3001, []), (3002, [0.0, 0.0]), (3003, [1.0, None]), (3004, [float("nan"), 1.0]), (3005, [5.0]), (3006, [-5.0]), (3007, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {x["vec_id"]: x["n_links"] for x in E.embedding_links(df, recall=0.9999).collect()}
    want = brute(rows)
    assert got[2000] == got[2001] == 2 and got[3005] == 1 and got[3006] == 0
    off = [i for i in want if got[i] != want[i]]
    assert len(off) <= 2 and all(got[i] <= want[i] for i in want)


@pytest.mark.parametrize("dims", [8, 16])
def test_pairs_count_for_both_ends(spark, dims):
    r = np.random.default_rng(dims)
    x = r.normal(0, 1, (1500, dims))[r.integers(0, 1500, 6000)] + r.normal(0, 0.16, (6000, dims))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {row["vec_id"]: (row["n_links"], row["component_id"]) for row in E.embedding_links(df).collect()}
    u = E.unit(x)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found, whole = sum(n for n, _ in got.values()), int(near.sum())
    assert found % 2 == 0 and 0.99 * whole <= found <= whole
    # a vector that shares a component with another has a link, and one that has a link shares its component
    size = {}
    for _, c in got.values():
        size[c] = size.get(c, 0) + 1
    assert all((n > 0) == (size[c] > 1) for n, c in got.values())
