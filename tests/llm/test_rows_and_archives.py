import gzip

import pytest
from llm_edges import DOCS, sentence

from carelake.llm import near_dedup as N
from carelake.llm import warc as W

# near-duplicates by row


def test_repeated_ids_keep_their_different_texts(spark):
    text = sentence(1, 40)
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, ""), (2, ""), (2, None), (3, text), (3, text + " more"), (4, text), (None, text), (None, text), (5, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = sorted(((r["doc_id"], r["text"]) for r in N.drop_near_duplicates(docs).collect()), key=repr)
    assert [k for k in kept if k[0] in (1, 2, 5)] == sorted([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, ""), (2, ""), (2, None)], key=repr)
    assert len([k for k in kept if k[0] in (3, 4)]) == 1 and [k[0] for k in kept if k[0] in (3, 4)] == [3]
    assert kept.count((None, text)) == 2
    assert N.drop_near_duplicates(docs).columns == docs.columns


# archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_append_adds_and_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "warc")
    W.write_warc(pages(spark, [(1, "http://a", "one")]), path)
    W.write_warc(pages(spark, [(2, "http://b", "two"), (3, "http://c", "three")]), path)
    assert sorted(r["page_id"] for r in W.read_warc(spark, path).collect()) == [1, 2, 3]
    W.write_warc(pages(spark, [(9, "http://d", "nine")]), path, "overwrite")
    assert [(r["page_id"], bytes(r["payload"])) for r in W.read_warc(spark, path).collect()] == [(9, b"nine")]
    W.write_warc(pages(spark, [(10, "http://d", "ten")]), path)
    assert sorted(r["page_id"] for r in W.read_warc(spark, path).collect()) == [9, 10]


def record(kind, uri, block, content="application/http; msgtype=response", more=()):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI: <{uri}>", "WARC-Record-ID: <urn:uuid:0>", f"Content-Type: {content}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


RECORDS = [
    record("warcinfo", "file", b"software: x\r\n", "application/warc-fields"),
    record("request", "http://a", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request"),
    record("response", "http://a", b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n<html>\r\n\r\nbody</html>", more=["WARC-Payload-Digest: sha1:ABC", "X-Long: one", "  two"]),
    record("resource", "http://b", b"WARC/1.0 is text" * 100_000, "text/plain"),
    record("response", "http://c", b"", more=["warc-payload-digest: sha1:DEF"]),
]
WANT = [
    ("warcinfo", "file", None, 13, None), ("request", "http://a", None, 0, None), ("response", "http://a", "sha1:ABC", 21, b"<html>\r\n\r\nbody</html>"),
    ("resource", "http://b", None, 1_600_000, b"WARC/1.0 is text" * 100_000), ("response", "http://c", "sha1:DEF", 0, b""),
]


def found(df):
    return [(r["record_type"], r["target_uri"], r["payload_digest"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"])) for r in df.collect()]


@pytest.mark.parametrize("form", ["plain", "members", "whole"])
def test_ordinary_archives(spark, tmp_path, form):
    name = tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")
    name.write_bytes(b"".join(RECORDS) if form == "plain" else gzip.compress(b"".join(RECORDS)) if form == "whole" else b"".join(map(gzip.compress, RECORDS)))
    for path in (name, tmp_path):
        df = W.read_warc(spark, str(path))
        assert found(df) == WANT
        assert found(df.where("record_type = 'response' and target_uri = 'http://a'")) == [WANT[2]]
    assert [x[:4] for x in found(W.read_warc(spark, str(name), payload=False))] == [w[:4] for w in WANT]
    assert all(x[4] is None for x in found(W.read_warc(spark, str(name), payload=False)))


def test_broken_archives_are_named(spark, tmp_path):
    (tmp_path / "cut.warc").write_bytes(RECORDS[2][:-30])
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.warc").write_bytes(b"no record\r\n")
    for path in ("cut.warc", "other"):
        with pytest.raises(Exception, match="warc"):
            W.read_warc(spark, str(tmp_path / path)).collect()
    (tmp_path / "none").mkdir()
    assert W.read_warc(spark, str(tmp_path / "none")).count() == 0


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def templated(n, copies=0):
    """Texts of one template that differ in about a quarter of their words at one place, and near copies of some of them."""
    template = [f"same{i}" for i in range(160)]
    rows = [(i, " ".join(template + [f"own{i}x{k}" for k in range(60)])) for i in range(n)]
    return rows + [(n + j, rows[3 * j][1] + f" more{j}") for j in range(copies)]


def test_texts_of_one_template_are_not_linked_but_their_copies_are(spark, monkeypatch):
    rows = templated(60, 15)
    for name, value in (("TEXT_BLOCK", 8), ("FAN", 3), ("BUCKET_BLOCK", 16), ("PICKED", 2)):
        monkeypatch.setattr(N, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs).collect()}
    assert got == brute_groups(rows)


def test_texts_that_cannot_link_leave_large_clusters(spark):
    rows = [(i, t) for i, t in templated(40, 5)]
    many = spark.createDataFrame([(7, i % 4, 4, i, t) for i, t in rows], "cluster long, block long, blocks long, id long, text string")
    left = {r["id"] for r in N._linkable(many).collect()}
    assert left == {40 + j for j in range(5)} | {3 * j for j in range(5)}
    assert N._linkable(many).columns == many.columns
