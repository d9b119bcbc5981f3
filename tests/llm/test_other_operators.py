import math

import numpy as np
import pytest
from llm_edges import edge_docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
import oracle
from carelake.llm import quality as Q
from carelake.llm import toxicity as X
from carelake.llm.catalog import ORACLES, QUERIES
from carelake.llm.embedding_dedup import MultiIndex, embedding_links, unit
from carelake.llm.html_main_text import extract_main_text, main_text, minimum_cut
from carelake.llm.labelled import auc, held_out
from carelake.llm.warc import read_warc, to_records, warc_report, write_warc

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    assert oracle.compare(QUERIES[name](spark, SMALL), oracle.connect(SMALL), ORACLES[name]) is None


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES if n != "pipeline"}


# embeddings


def brute_links(rows):
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = unit(np.array([v for _, v in good]))
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = list(range(len(good)))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = label[i], label[j]
        label = [min(a, b) if v in (a, b) else v for v in label]
    least = {}
    for (i, _), v in zip(good, label, strict=True):
        least[v] = min(i, least.get(v, i))
    own = {}
    for k, (i, _) in enumerate(good):
        own.setdefault(i, []).append((int(near[k].sum()), least[label[k]]))
    return sorted(((i, *(own[i].pop() if own.get(i) else (0, i))) for i, v in sorted(rows, key=repr)), key=repr)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_embedding_links_equal_brute_force(spark, monkeypatch, small_blocks):
    from carelake.llm import embedding_dedup as E

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.12).tolist()) for i in range(300)]
    rows += [(300 + i, (rng.normal(size=8)).tolist()) for i in range(200)] + [(600 + i, rows[0][1]) for i in range(40)]
    rows += [(700, None), (701, []), (702, [0.0] * 8), (703, [float("nan")] + [1.0] * 7), (704, [None] + [1.0] * 7), (705, [1.0] * 5), (706, [float("inf")] * 8), (None, rows[1][1])]
    if small_blocks:
        monkeypatch.setattr(E, "BLOCK", 10)
        monkeypatch.setattr(E, "CHUNK", 7)
        monkeypatch.setattr(E, "CELL", 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"label": F.lit(1), "cell": F.lit(2)})
    got = embedding_links(df).collect()
    want = brute_links(rows)
    assert len(got) == len(rows)
    found, all_links = sum(r["n_links"] for r in got), sum(r[1] for r in want)
    assert found <= all_links and found >= 0.99 * all_links
    same = sum((r["vec_id"], r["component_id"]) in {(w[0], w[2]) for w in want} for r in got)
    assert same >= len(rows) - 3
    assert embedding_links(spark.createDataFrame([], df.schema)).count() == 0


def test_recall_at_the_threshold():
    """Neighbours just above the threshold are among the visited cells."""
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(3000, 64)))
    aside = rng.normal(size=x.shape)
    aside = unit(aside - (aside * x).sum(1, keepdims=True) * x)
    y = 0.905 * x + math.sqrt(1 - 0.905**2) * aside
    index = MultiIndex(np.concatenate((x, y)), 50_000, 0.9)
    at, (query, cell) = index.cells(y), index.visits(x)
    assert np.mean([at[i] in set(cell[query == i].tolist()) for i in range(300)]) >= 0.98
    assert len(query) < 0.8 * len(x) * len(index.words[0]) ** 2


# scores


def test_classifiers_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas().set_index("doc_id")
    for name, column, least in (("op3_toxicity", "toxic", 0.7), ("op4_quality", "quality", 0.98)):
        rows = [r for r in QUERIES[name](spark, MIDDLE).collect() if r["held_out"] and r["doc_id"] in labels.index]
        s, y = np.array([r["score"] for r in rows]), np.array([labels.loc[r["doc_id"], column] for r in rows])
        assert ((s >= 0) & (s <= 1)).all() and auc(s, y) >= least


def test_misspellings_share_ngrams():
    texts = ["you are an idiot truly", "what a fine day today"] * 40
    y = np.array([1, 0] * 40)
    table, bias = X.train(X.bags(texts), y, np.ones(80))
    score = X.score(["you idiott", "you idioot", "fine day", "", "unrelated"], table, bias)
    assert score[0] > 0.5 and score[1] > 0.5 and score[2] < 0.5


def test_bags_sum_to_one():
    for index, share in X.bags(["a b", "some words here", "ÀÉ 漢字 x"]):
        assert len(index) == len(set(index.tolist())) and share.sum() == pytest.approx(1, abs=1e-5)
    assert [len(b[0]) for b in X.bags(["", " !! "])] == [0, 0]


def test_passage_gradients():
    rng = np.random.default_rng(0)
    model = Q.Model([rng.normal(0, 0.3, s) for s in ((Q.N_FEATURES, 4), (4,), (4, 3), (4, 3), (3,), (4,), (1,))], np.zeros(Q.N_FEATURES), np.ones(Q.N_FEATURES))
    x, n, y, w = rng.normal(size=(6, Q.N_FEATURES)), np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        p = model.forward(x, n)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    for value, grad in zip(model.values, model.gradients(model.forward(x, n), y, w), strict=True):
        at = tuple(0 for _ in value.shape)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert grad[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_scores_of_edge_rows(spark, edge_docs, no_docs, label):
    run = X.toxicity_scores if label == "toxic" else Q.quality_scores
    some = [(i, i % 2, (i + 1) % 2) for i in range(100, 140)] + [(100, None, None), (None, 1, 1), (9999, 1, 0)]
    tables = [spark.createDataFrame(rows, "doc_id long, quality int, toxic int") for rows in (some, [], [(101, 1, 1), (102, 1, 1)])]
    want = sorted(((r["doc_id"], r["held_out"]) for r in edge_docs.drop("held_out").select("doc_id", held_out().alias("held_out")).collect()), key=repr)
    for labels in tables:
        got = run(edge_docs, labels).collect()
        assert sorted(((r["doc_id"], r["held_out"]) for r in got), key=repr) == want
        assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0.5 for r in run(edge_docs, tables[1]).collect())
    assert run(no_docs, tables[0]).count() == 0
    if label == "quality":
        kept = Q.accepted(edge_docs, tables[0], accept=0.0)
        assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


# pages

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="ad-free"><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="ad">Buy now</div><header>Site</header><article><h1>Head &amp; line</h1><p>First  <b>bo</b>ld &#233;.<br>Next<p>Second one.<div class="cookie-notice">We use cookies</div>
<form>Mail <input></form><p>Third.</p><section class="comments"><p>Nice text, thanks a lot for this!</p></section></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line First bold é. Next Second one. Third."
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == ""
    assert main_text("<article><p>Unclosed text") == "Unclosed text"
    prose = " ".join(f"word{i}" for i in range(40))
    assert main_text(f"<body><div class='menu'><a href=x>Home</a></div><div><p>{prose}</p><p>Yes.</p><p>{prose}</p></div></body>") == f"{prose} Yes. {prose}"
    assert len(main_text("<article>" + "<p>a b</p>" * 20_000 + "</article>")) == 20_000 * 4 - 1


WHOLE, OPEN = "First words, then more.", "First words"


@pytest.mark.parametrize(
    ("inner", "first"),
    [
        ("<svg class='icon' width='1'/>", WHOLE), ("<math/>", WHOLE), ("<svg><path d='M0'/><title>icon</title><style/></svg>", WHOLE),
        ("<svg><text>Label</text></svg>", WHOLE), ("<template><div>Inert</div></template>", WHOLE), ("<noscript><p>Turn it on</p></noscript>", WHOLE),
        ("<svg><foreignObject><p>In a picture</p></foreignObject></svg>", WHOLE), ("<object data=x><param name=y>", WHOLE),
        # not closed: ends with the paragraph, not at a later end tag or with the page
        ("<svg><path d='M0'>", OPEN), ("<template><div>Inert</div>", OPEN), ("<noscript><img src=x>Turn it on", OPEN), ("<select><option>One<option>Two", OPEN),
        ("<math><mi>E</mi><mo>=</mo><mi>m</mi></math>", "First wordsE=m, then more."), ("<object data=x>Seen</object>", "First wordsSeen, then more."),
        ("<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math>", "First wordsx, then more."), ("<object data=x>Seen", "First wordsSeen, then more."),
    ],
)
def test_main_text_around_elements(inner, first):
    for last in ("Last one here.", "Last <svg><text>L</text></svg>one here.", "Last one <noscript>N</noscript><template>T</template>here."):
        page = f"<article><p>First words{inner}, then more.</p><p>{last}</p></article><svg><text>x</text></svg><noscript>y</noscript><template></template>"
        assert main_text(page) == first + " Last one here."


def test_svg_ends_at_html():
    assert main_text("<article><p>One.</p><svg><path><p>Two.</p><p>Three.</p></article>") == "One. Two. Three."


def test_minimum_cut_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        odds = rng.normal(size=n).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(keep, odds=odds, edges=edges):
            return sum(max(z, 0) if not k else max(-z, 0) for z, k in zip(odds, keep, strict=True)) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(minimum_cut(odds, edges)) == pytest.approx(best)


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = extract_main_text(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_main_text(df.limit(0)).count() == 0


# archives


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é" + "x" * 200_000
    rows = [(1, "http://a/1", "b" * 150), (2, "http://a/2\r\nX: y", "b" * 150), (3, None, "short"), (4, "http://b", "short"), (5, "http://b", None), (6, "http://c", long), (7, "http://c", long)]
    rows += [(None, "http://n", "b" * 150), (1, "http://a/1", "b" * 150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/warc"
    write_warc(df, path)
    got = sorted((tuple(r) for r in warc_report(spark, path).collect()), key=repr)
    assert len(got) == len(rows)
    kinds = {(r[0], r[3], r[4]) for r in got}
    assert kinds == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "revisit", 6), (None, "revisit", 1)}
    back = {r["page_id"]: r for r in read_warc(spark, path).where("record_type = 'response'").collect()}
    assert bytes(back[6]["payload"]).decode() == long and back[5]["payload_bytes"] == 0
    only = read_warc(spark, path).where("record_type = 'revisit' and target_uri like 'http://c%'")
    assert [r["page_id"] for r in only.collect()] == [7]
    assert "record_type" not in only._jdf.queryExecution().executedPlan().toString().split("Filter")[-1] or only.count() == 1
    assert read_warc(spark, path, payload=False).where("payload is not null").count() == 0
    empty = f"file://{tmp_path}/none"
    write_warc(df.limit(0), empty)
    assert read_warc(spark, empty).count() == 0 and to_records(df.limit(0)).count() == 0


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == counts[4] and last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_components_equal_brute_force(spark):
    from carelake.llm.components import connected_components

    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(999, i) for i in range(700, 760)] + [(5, 5)]
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in label:
        changed = False
        for a, b in pairs:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
        if not changed:
            break
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == label and len(got) == len(label)
