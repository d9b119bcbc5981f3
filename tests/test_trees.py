import numpy as np
import pytest

from carelake.operators import folds as D
from carelake.operators import models
from carelake.operators import trees as T

FEATURES = ["a", "b", "c", "d"]


def rows(n=600, seed=2):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.integers(0, 9, n), r.normal(0, 1, n), r.integers(0, 2, n), r.integers(0, 400, n)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 0.2) | (x[:, 3] > 350)) ^ (r.random(n) < 0.1)
    return x, y.astype(int)


@pytest.fixture(scope="module")
def table(spark):
    x, y = rows()
    data = [(i, *map(float, v), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "patient_id long, a double, b double, c double, d double, label double, fold int").repartition(5)


def naive_split(x, sums, member):
    """Best (gain, column, bin) over all columns and bins, by trying each."""
    best = (-np.inf, -1, 0)
    whole = [s.sum() for s in sums]

    def worth(n, w, a, h):
        if member.rounds:
            return a * a / (h + member.l2 if member.curved_gain else w + member.l2)
        return (a * a + (w - a) ** 2) / w

    for c in range(x.shape[1]):
        for b in np.unique(x[:, c])[:-1]:
            left = [s[x[:, c] <= b].sum() for s in sums]
            right = [a - b_ for a, b_ in zip(whole, left, strict=True)]
            if min(left[0], right[0]) < member.min_leaf or member.min_weight and min(left[3], right[3]) < member.min_weight:
                continue
            gain = worth(*left) + worth(*right) - worth(*whole)
            if gain > best[0] + 1e-9:
                best = (gain, c, int(b))
    return best


MEMBERS = [
    T.Member("t", min_split=5, min_leaf=2), T.Member("t", bootstrap=True), T.Member("b", rounds=1, rate=0.3, l2=1.0, min_weight=1.0), T.Member("b", rounds=1, curved_gain=False),
]


@pytest.mark.parametrize("member", MEMBERS)
@pytest.mark.parametrize("n", [40, 900])
def test_first_cut_equals_trying_every_cut(member, n):
    r = np.random.default_rng(n)
    x = r.integers(0, 30, (n, 3)).astype(np.uint8)
    y = (x[:, 1] > 12) ^ (r.random(n) < 0.2)
    block = T.Rows(np.arange(n), y.astype(np.int32), x, np.full(n, -1))
    if member.rounds:
        seen, sums = np.arange(n), T._gradients(r.normal(0, 1, n), y.astype(float))
    else:
        seen, sums = T._sums(block, member)
    tree, gains = T.grow(x[seen], sums, 1, 0, member)
    gain, column, cut = naive_split(x[seen], sums, member)
    assert (tree["column"][0], tree["bin"][0]) == (column, cut)
    stump, gained = T.grow(x[seen], sums, 1, 0, T.replace(member, max_depth=1))
    assert len(stump) == 3 and gained[column] == pytest.approx(gain)


def test_dense_and_sparse_histograms_agree():
    r = np.random.default_rng(1)
    for n, k in ((3000, 2), (3000, 700)):
        at, bins = r.integers(0, k, n), r.integers(0, 256, n)
        w = r.integers(1, 4, n).astype(float)
        sums = [np.ones(n), w, w * r.integers(0, 2, n), np.zeros(n)]
        gain, cut = T._cuts_of(at, bins, sums, k, T.Member("t"))
        for node in range(0, k, max(1, k // 20)):
            mine = at == node
            want = naive_split(bins[mine][:, None], [s[mine] for s in sums], T.Member("t"))
            assert gain[node] == pytest.approx(want[0]) and (want[1] < 0 or cut[node] == want[2])


def test_unbounded_tree_ends_in_pure_leaves_unless_nodes_are_small():
    x, y = rows(400)
    x = np.column_stack([np.searchsorted(np.unique(c), c) % 256 for c in x.T]).astype(np.uint8)
    sums = [np.ones(400), np.ones(400), y.astype(float), np.zeros(400)]
    tree, _ = T.grow(x, sums, 1, 0, T.Member("t"))
    assert (tree["value"][T.leaves(tree, x)] == y).all()
    small, _ = T.grow(x, sums, 1, 0, T.Member("t", min_split=30, min_leaf=4))
    at = T.leaves(small, x)
    sizes = np.bincount(at, minlength=len(small))
    inner = np.flatnonzero(small["column"] >= 0)
    assert sizes[sizes > 0].min() >= 4 and len(small) < len(tree)
    below = {i: int(sizes[i]) for i in range(len(small))}
    for i in inner[::-1]:
        below[i] = below[small["left"][i]] + below[small["left"][i] + 1]
    assert min(below[i] for i in inner) >= 30


def scores(ensemble, table, model):
    return {r["patient_id"]: (r["prediction"], r["p_high"]) for r in T.score(ensemble, table, model).collect()}


def test_trees_do_not_depend_on_where_they_are_cut(table):
    members = [*T.forest_members("forest", 3, 7, 2, min_split=5), T.Member("tree"), *(T.Member("fold", without=f, seed=f) for f in range(3))]
    members += [T.Member("boost", rounds=4, rate=0.3, max_depth=3, l2=1.0, min_weight=1.0), T.Member("plain", rounds=4, max_depth=2, curved_gain=False, without=1)]
    small = T.train(table, members, FEATURES, "patient_id", task_rows=80)
    whole = T.train(table, members, FEATURES, "patient_id")
    assert small.tops and not whole.tops
    for model in ("forest", "tree", "fold", "boost"):
        a, b = scores(small, table, model), scores(whole, table, model)
        assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}
        assert max(abs(a[k][1] - b[k][1]) for k in a) < 1e-6
        assert np.allclose(small.importance(model), whole.importance(model), atol=1e-6)
    assert abs(whole.importance("forest").sum() - 1) < 1e-9


def test_margins_are_written_between_rounds(table, monkeypatch):
    monkeypatch.setattr(T, "ROUNDS_PER_WRITE", 2)
    members = [T.Member("boost", rounds=5, rate=0.3, max_depth=2, l2=1.0)]
    a, b = (scores(T.train(table, members, FEATURES, "patient_id", task_rows=n), table, "boost") for n in (50, 10**6))
    assert max(abs(a[k][1] - b[k][1]) for k in a) < 1e-6


def test_members_do_not_see_their_fold(spark, table):
    flipped = table.selectExpr("patient_id", *FEATURES, "CASE WHEN fold = 1 THEN 1 - label ELSE label END AS label", "fold")
    members = [T.Member("tree", without=1), T.Member("boost", without=1, rounds=3)]
    inside = table.where("fold = 1")
    for model in ("tree", "boost"):
        assert scores(T.train(table, members, FEATURES, "patient_id"), inside, model) == scores(T.train(flipped, members, FEATURES, "patient_id"), inside, model)


def test_large_forests_are_shipped_in_parts(table, monkeypatch):
    ensemble = T.train(table, T.forest_members("forest", 6, 7, 2), FEATURES, "patient_id")
    want = scores(ensemble, table, "forest")
    monkeypatch.setattr(T, "SHIP_BYTES", 1000)
    got = scores(ensemble, table, "forest")
    assert {k: round(v[1], 9) for k, v in got.items()} == {k: round(v[1], 9) for k, v in want.items()}


def test_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(i, 1.0, None if i % 3 else float(i), float(i % 2)) for i in range(60)], "patient_id long, a double, b double, label double")
    ensemble = T.train(df, [T.Member("tree"), T.Member("boost", rounds=2)], ["a", "b"], "patient_id")
    assert T.score(ensemble, df, "tree").count() == T.score(ensemble, df, "boost").count() == 60


# folds


def plain_moments(x, y, keep):
    return {t: (x[keep & (y == t)].mean(0), x[keep & (y == t)].var(0), (keep & (y == t)).sum()) for t in (0, 1)}


def test_other_folds_together(table):
    x, y = rows()
    fold = np.arange(len(y)) % 3
    found = D.others(D.fold_moments(table, FEATURES))
    for f, m in found.items():
        for t, (mean, var, n) in plain_moments(x, y, fold != f).items():
            assert m.n[t] == n and np.allclose(m.mean[t], mean) and np.allclose(m.m2[t] / n, var)
        scale = D.scale_parameters(m, FEATURES)
        assert np.allclose([scale[c] for c in FEATURES], np.column_stack([x[fold != f].mean(0), x[fold != f].std(0)]))


def test_naive_bayes_equals_densities(table):
    x, y = rows()
    fold = np.arange(len(y)) % 3
    got = {r["patient_id"]: r["p_high"] for r in D.naive_bayes(table, table, FEATURES).collect()}
    for f in range(3):
        stats = plain_moments(x, y, fold != f)
        room = 1e-9 * x[fold != f].var(0).max()
        logs = [np.log(n / (fold != f).sum()) - (0.5 * np.log(2 * np.pi * (v + room)) + (x - m) ** 2 / (2 * (v + room))).sum(1) for m, v, n in (stats[0], stats[1])]
        p = 1 / (1 + np.exp(logs[0] - logs[1]))
        assert all(abs(got[i] - p[i]) < 1e-9 for i in np.flatnonzero(fold == f))


def test_logistic_weights_have_no_gradient(table):
    x, y = rows()
    fold = np.arange(len(y)) % 3
    for c in (1.0, 0.01):
        for f, w in D.logistic_weights(table, FEATURES, c).items():
            a = np.column_stack([np.ones(len(x)), x])[fold != f]
            p = 1 / (1 + np.exp(-a @ w))
            gradient = a.T @ (p - y[fold != f]) + np.append(0.0, w[1:] / c)
            assert np.abs(gradient / np.sqrt((a * a).sum(0))).max() < 1e-5
    whole = D.logistic_weights(table.drop("fold"), FEATURES)
    assert list(whole) == [-1]


# kernel machine


def test_nystroem_machine_equals_the_kernel_machine(spark):
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (500, 2))
    y = (((x**2).sum(1) > 1.3) ^ (r.random(500) < 0.03)).astype(float)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "patient_id long, a double, b double, label double")
    z = np.array([r_["features"].toArray() for r_ in models.nystroem_features(df, ["a", "b"], x, 0.5).orderBy("patient_id").collect()])
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - kernel).max() < 1e-6
    # the dual by pairwise steps on the whole kernel of the scaled rows
    s = (x - x.mean(0)) / x.std(0)
    k = np.exp(-0.5 * ((s[:, None] - s[None]) ** 2).sum(2))
    t = 2 * y - 1
    alpha, g = np.zeros(500), -np.ones(500)
    for _ in range(20_000):
        up = ((t > 0) & (alpha < 1)) | ((t < 0) & (alpha > 0))
        low = ((t > 0) & (alpha > 0)) | ((t < 0) & (alpha < 1))
        v = -t * g
        i, j = np.where(up, v, -np.inf).argmax(), np.where(low, v, np.inf).argmin()
        if v[i] - v[j] < 1e-4:
            break
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-9)
        step = min(step, 1 - alpha[i] if t[i] > 0 else alpha[i], alpha[j] if t[j] > 0 else 1 - alpha[j])
        alpha[i] += t[i] * step
        alpha[j] -= t[j] * step
        g += t * (k[:, i] - k[:, j]) * step
    margin = k @ (alpha * t) + (v[i] + v[j]) / 2
    # rows keep their order in one partition
    one = models._fit_svm(df, df.coalesce(1).sortWithinPartitions("patient_id"), ["a", "b"], landmarks=500).collect()
    same = np.mean([(r_["prediction"] == 1) == (m > 0) for r_, m in zip(one, margin, strict=True)])
    assert same >= 0.98
