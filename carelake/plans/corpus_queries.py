"""Queries on documents, chunks and similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions import text as tx
from carelake.functions.columns import WHITESPACE, WS_CLASS
from carelake.operators import corpus, graph_index, long_texts, metrics, neighbours, retrieve, risk, split
from carelake.plans import clinical as cfg
from carelake.plans.fixtures import patients, with_views
from carelake.plans.metric_queries import SCALED_VIEW
from carelake.plans.record_queries import _FACTOR_ROWS, _summary_sql
from carelake.plans.registry import query
from carelake.session import materialize, run_dir, spread
from carelake.sources.tables import table, write_index
from carelake.sources.versions import VersionedIndex

# The given documents mention no table, so the reference test runs with a pattern they do contain.
REFERENCE = ["licence", "license"]
FLOOR = 0.2

# ---- oracle pieces ------------------------------------------------------------------------

_WS_CHARS = " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)


def _trim(x):
    return f"trim({x}, {_WS_CHARS})"


_CAP = "A-ZŠĐČĆŽ"


def _reference(x, terms=REFERENCE):
    return f"regexp_matches({x}, '(?i)({'|'.join(terms)})')"


def _starts(x):
    return f"regexp_matches({x}, '^{WS_CLASS}*[{_CAP}\\p{{Nd}}\\-•–]')"


def _ends(x):
    return f"(right({_trim(x)}, 1) IN ('.', '!', '?', ':'))"


def _repaired(source, key, text, out, terms=REFERENCE):
    """CTEs r1..r3 that repair ``text`` of ``source``; ``out`` is the name of the last."""
    return f"""{out}1 AS (SELECT {key}, {_trim(text)} AS t FROM {source}),
{out}2 AS (SELECT {key}, CASE WHEN regexp_matches(t, '^\\p{{Ll}}')
    THEN {_trim(f"regexp_extract(t, '(?s)[.!?]{WS_CLASS}({WS_CLASS}*[{_CAP}].*)$', 1)")} ELSE t END AS t FROM {out}1),
{out}3 AS (SELECT {key}, {_trim(f"array_to_string(list_filter(string_split(regexp_replace(t, '([.!?]){WS_CLASS}+', chr(92) || '1' || chr(1), 'g'), chr(1)), lambda s: NOT {_reference('s', terms)}), ' ')")} AS t FROM {out}2),
{out} AS (SELECT {key}, CASE WHEN t = '' OR right(t, 1) IN ('.', '!', '?', ':') THEN t
    ELSE CASE WHEN length(regexp_extract(t, '(?s)^(.*[.!?])', 1)) - 1 > length(t) * 0.5::DOUBLE THEN regexp_extract(t, '(?s)^(.*[.!?])', 1) ELSE '' END END AS t FROM {out}3)"""


_SEPS = "['. ', '? ', '! ', chr(10) || chr(10), chr(10), '; ']"


def _windows(tail: bool) -> str:
    """Recursive windows over every document; ``rfind`` is the position of the reversed separator in the reversed window."""
    stop = "w.e < w.n" if not tail else "greatest(w.s + 1, w.e - 100) < w.n"
    end = """CASE WHEN {s} + 600 >= n THEN n ELSE {s} + COALESCE(list_extract(list_filter(list_transform({seps},
      lambda p: CASE WHEN instr(reverse(substr(text, {s} + 1, 600)), reverse(p)) > 0
        AND 600 - instr(reverse(substr(text, {s} + 1, 600)), reverse(p)) - length(p) + 1 > 300
        THEN 601 - instr(reverse(substr(text, {s} + 1, 600)), reverse(p)) END), lambda x: x IS NOT NULL), 1), 600) END"""
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, 0 AS i, 0 AS s, length(text) AS n, CAST({end.format(s=0, seps=_SEPS)} AS BIGINT) AS e
  FROM (SELECT doc_id, text, length(text) AS n FROM documents) d WHERE n >= 600
  UNION ALL
  SELECT doc_id, i, s, n, CAST({end.format(s='s', seps=_SEPS)} AS BIGINT) FROM (
    SELECT w.doc_id, w.i + 1 AS i, greatest(w.s + 1, w.e - 100) AS s, w.n, d.text FROM w JOIN documents d USING (doc_id) WHERE {stop}) x),
win AS (SELECT doc_id, i, s, e FROM w UNION ALL SELECT doc_id, 0, 0, length(text) FROM documents WHERE length(text) BETWEEN 1 AND 599)"""


_CUT = """, raw AS (SELECT win.doc_id, i, s, e, length(d.text) < 600 AS short, substr(d.text, s + 1, e - s) AS full_text,
  {strip} AS text, source FROM win JOIN documents d USING (doc_id)),
{repair},
valid AS (SELECT raw.doc_id, raw.i, raw.s, raw.e, raw.source, CASE WHEN short THEN full_text WHEN length(text) < 40 THEN ''
  WHEN {ref} OR NOT {starts} OR NOT {ends} THEN CASE WHEN length(r.t) < 40 THEN '' ELSE r.t END ELSE {trimmed} END AS text
  FROM raw JOIN r USING (doc_id, i)),
chunks AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_id FROM valid WHERE text <> '')"""
_CUT = _CUT.format(
    strip=_trim("substr(d.text, s + 1, e - s)"), repair=_repaired("raw", "doc_id, i", "text", "r"),
    ref=_reference("text"), starts=_starts("text"), ends=_ends("text"), trimmed=_trim("text"),
)

# ---- chunks -------------------------------------------------------------------------------


@query("chunk_windows", _windows(tail=True) + ' SELECT doc_id, CAST(i AS INTEGER) AS window_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM win')
def chunk_windows(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return corpus.chunk_windows(docs, ["doc_id"], tail=True).select("doc_id", "window_id", "start", "end")


@query("chunk_windows_segments", _windows(tail=True) + ' SELECT doc_id, CAST(i AS INTEGER) AS window_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM win')
def chunk_windows_segments(spark, sf_dir):
    """The same windows with every text of four windows or more cut by segments of its own."""
    docs = spread(table(spark, sf_dir, "documents"))
    return long_texts.all_windows(docs, ["doc_id"], tail=True, long_chars=2400, segment_chars=1200).select("doc_id", "window_id", "start", "end")


@query("chunk_windows_no_tail", _windows(tail=False) + ' SELECT doc_id, CAST(i AS INTEGER) AS window_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM win')
def chunk_windows_no_tail(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return corpus.chunk_windows(docs, ["doc_id"]).select("doc_id", "window_id", "start", "end")


@query("table_ref_filter", f"SELECT doc_id, {_reference('text')} AS has_reference, {_reference('text', cfg.TABLE_TERMS)} AS has_table_reference FROM documents")
def table_ref_filter(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", tx.has_reference(F.col("text"), REFERENCE).alias("has_reference"),
        tx.has_reference(F.col("text")).alias("has_table_reference"),
    )


@query("chunk_start_ok", f"SELECT doc_id, {_starts('text')} AS ok FROM documents")
def chunk_start_ok(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", tx.starts_complete(F.col("text")).alias("ok"))


@query("chunk_end_ok", f"SELECT doc_id, {_ends('text')} AS ok FROM documents")
def chunk_end_ok(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", tx.ends_complete(F.col("text")).alias("ok"))


@query("chunk_repair", _windows(tail=True) + _CUT + " SELECT doc_id, CAST(i AS INTEGER) AS window_id, t AS text FROM r")
def chunk_repair(spark, sf_dir):
    raw = corpus.chunk_windows(spread(table(spark, sf_dir, "documents")), ["doc_id"], tail=True)
    return raw.select("doc_id", "window_id", tx.repair(F.col("text"), REFERENCE).alias("text"))


@query("chunk_validate", _windows(tail=True) + _CUT + ' SELECT doc_id, chunk_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", text FROM chunks')
def chunk_validate(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    chunks = corpus.chunk_documents(docs, ["doc_id"], tail=True, terms=REFERENCE)
    return chunks.select("doc_id", "chunk_id", "start", "end", "text")


@query("chunk_ids", _windows(tail=False) + _CUT + """ SELECT doc_id, source, chunk_id,
  substr(md5(concat(doc_id, '_', coalesce(source, ''), '_', substr(text, 1, 100), '_', chunk_id)), 1, 16) AS chunk_uid FROM chunks""")
def chunk_ids(spark, sf_dir):
    path = run_dir(spark, "chunk-index")
    chunks = corpus.chunk_documents(spread(table(spark, sf_dir, "documents")), ["doc_id", "source"], terms=REFERENCE)
    write_index(chunks, path)
    write_index(chunks, path)
    return spark.read.parquet(path).select("doc_id", "source", "chunk_id", "chunk_uid")


@query("index_versions", _windows(tail=False) + _CUT + """, v AS (SELECT doc_id, chunk_id, text, substr(md5(concat(doc_id, '_', coalesce(source, ''), '_', substr(text, 1, 100), '_', chunk_id)), 1, 16) AS chunk_uid FROM chunks)
  SELECT doc_id, chunk_id, chunk_uid, CASE WHEN doc_id % 11 = 0 THEN 'later' WHEN doc_id % 3 = 0 THEN concat('new ', text) ELSE text END AS text FROM v WHERE doc_id % 7 <> 0 OR doc_id % 11 = 0
  UNION ALL SELECT doc_id, chunk_id, concat('n', chunk_uid), text FROM v WHERE doc_id % 5 = 0""")
def index_versions(spark, sf_dir):
    """Rows added to an index, replaced, removed, compacted and replaced again, as its last version has them."""
    chunks = corpus.chunk_documents(spread(table(spark, sf_dir, "documents")), ["doc_id", "source"], terms=REFERENCE)
    chunks = materialize(chunks.select("doc_id", "chunk_id", "chunk_uid", "text"), "chunks")
    index = VersionedIndex(spark, run_dir(spark, "versions"), "chunk_uid")
    index.rebuild(chunks)
    changed = chunks.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    index.upsert(changed.unionByName(chunks.where("doc_id % 5 = 0").withColumn("chunk_uid", F.concat(F.lit("n"), "chunk_uid"))))
    index.remove(chunks.where("doc_id % 7 = 0"))
    index.compact()
    index.upsert(chunks.where("doc_id % 11 = 0").withColumn("text", F.lit("later")))
    return index.read().select("doc_id", "chunk_id", "chunk_uid", "text")


@query("corpus_report", _windows(tail=False) + _CUT + """ SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS windows,
  count(*) FILTER (text <> '') AS kept, count(*) FILTER (text = '') AS dropped, CAST(sum(length(text)) AS BIGINT) AS kept_chars FROM valid GROUP BY source""")
def corpus_report(spark, sf_dir):
    return corpus.corpus_report(spread(table(spark, sf_dir, "documents")), "source", terms=REFERENCE)


@query("embed_corpus")
def embed_corpus(spark, sf_dir):
    chunks = materialize(corpus.chunk_documents(spread(table(spark, sf_dir, "documents")), ["doc_id"]), "chunks")
    coded = corpus.HashedTextEncoder().fit(chunks).encode(chunks)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return coded.select("doc_id", "chunk_id", "chunk_uid", F.size("embedding").alias("dims"), F.round(norm, 4).alias("norm"))


# ---- search -------------------------------------------------------------------------------

_TOPK = """sims AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) AS rel
  FROM embeddings q, embeddings c),
hits AS (SELECT query_id, vec_id, rel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, vec_id) AS INTEGER) AS rank FROM sims
  QUALIFY rank <= {k})"""


def _search(spark, sf_dir, k):
    vectors = spread(table(spark, sf_dir, "embeddings"))
    return retrieve.top_k(vectors, vectors.withColumnRenamed("vec_id", "query_id"), k, "vec_id", "query_id")


def _rounded_hits(hits, *more):
    return hits.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"), F.round("relevance", 6).alias("relevance"), *more)


@query("vector_topk", "WITH " + _TOPK.format(k=10) + " SELECT query_id, rank, vec_id, round(1 - rel, 6) AS distance, round(rel, 6) AS relevance FROM hits")
def vector_topk(spark, sf_dir):
    return _rounded_hits(_search(spark, sf_dir, cfg.HITS_PER_SEARCH))


@query("vector_topk_tiled", "WITH " + _TOPK.format(k=10) + " SELECT query_id, rank, vec_id, round(1 - rel, 6) AS distance, round(rel, 6) AS relevance FROM hits")
def vector_topk_tiled(spark, sf_dir):
    vectors = spread(table(spark, sf_dir, "embeddings"))
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    return _rounded_hits(retrieve.top_k(vectors, queries, cfg.HITS_PER_SEARCH, "vec_id", "query_id", broadcast_bytes=0))


@query("vector_topk_threshold", "WITH " + _TOPK.format(k=10) + " SELECT query_id, rank, vec_id, round(1 - rel, 6) AS distance, round(rel, 6) AS relevance FROM hits WHERE rel >= 0.2")
def vector_topk_threshold(spark, sf_dir):
    return _rounded_hits(retrieve.relevant(_search(spark, sf_dir, cfg.HITS_PER_SEARCH), FLOOR))


@query("vector_topk_probed")
def vector_topk_probed(spark, sf_dir):
    vectors = spread(table(spark, sf_dir, "embeddings"))
    found = retrieve.top_k_probed(vectors, vectors.withColumnRenamed("vec_id", "query_id"), cfg.HITS_PER_SEARCH, "vec_id", "query_id")
    return _rounded_hits(found)


@query("vector_topk_every_cell", "WITH " + _TOPK.format(k=10) + " SELECT query_id, rank, vec_id, round(1 - rel, 6) AS distance, round(rel, 6) AS relevance FROM hits")
def vector_topk_every_cell(spark, sf_dir):
    vectors = spread(table(spark, sf_dir, "embeddings"))
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    return _rounded_hits(
        retrieve.top_k_probed(vectors, queries, cfg.HITS_PER_SEARCH, "vec_id", "query_id", cells=8, probes=8)
    )


@query("search_recall")
def search_recall(spark, sf_dir):
    vectors = spread(table(spark, sf_dir, "embeddings"))
    found = retrieve.top_k_probed(vectors, vectors.withColumnRenamed("vec_id", "query_id"), cfg.HITS_PER_SEARCH, "vec_id", "query_id")
    return retrieve.recall(found, _search(spark, sf_dir, cfg.HITS_PER_SEARCH), ["query_id", "vec_id"])


@query("graph_recall", "SELECT count(*) AS queries, TRUE AS recalled, TRUE AS no_more_distances FROM embeddings")
def graph_recall(spark, sf_dir):
    """Every vector searched by the stored graphs: whether they find 95 % of the exact hits, with no more distances than an exact search.

    Shards of at most 512 rows are compared whole; the share of all distances falls with the size of larger ones.
    """
    vectors = spread(table(spark, sf_dir, "embeddings"))
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    path = run_dir(spark, "graph")
    graph_index.write_graph_index(vectors, path, "vec_id")
    found = graph_index.graph_search(spark, path, queries, cfg.HITS_PER_SEARCH, "vec_id", "query_id")
    reached = retrieve.recall(found.hits, _search(spark, sf_dir, cfg.HITS_PER_SEARCH), ["query_id", "vec_id"])
    asked = F.lit(queries.count()).cast("bigint").alias("queries")
    return reached.select(asked, (F.col("recall") >= 0.95).alias("recalled"), F.lit(found.computed <= found.possible).alias("no_more_distances"))


_TEXTS = _repaired("documents", "doc_id", "text", "r", cfg.TABLE_TERMS) + f""",
texts AS (SELECT doc_id AS vec_id, CASE WHEN length(d.text) < 40 THEN ''
  WHEN {_reference('d.text', cfg.TABLE_TERMS)} OR NOT {_starts('d.text')} OR NOT {_ends('d.text')} THEN CASE WHEN length(r.t) < 40 THEN '' ELSE r.t END
  ELSE {_trim('d.text')} END AS text FROM documents d JOIN r USING (doc_id)),
valid AS (SELECT hits.*, text FROM hits JOIN texts USING (vec_id) WHERE rel >= 0.2 AND text <> '')"""


def _valid_hits(spark, sf_dir, k):
    docs = spread(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "vec_id")
    return retrieve.with_valid_text(retrieve.relevant(_search(spark, sf_dir, k), FLOOR), docs, "vec_id")


@query("retrieve_validated", "WITH " + _TOPK.format(k=10) + ", " + _TEXTS + " SELECT query_id, rank, vec_id, round(1 - rel, 6) AS distance, round(rel, 6) AS relevance, text FROM valid")
def retrieve_validated(spark, sf_dir):
    return _rounded_hits(_valid_hits(spark, sf_dir, cfg.HITS_PER_SEARCH), "text")


_FUSED = "WITH " + _TOPK.format(k=6) + ", " + _TEXTS + """,
req AS (SELECT CAST(query_id // 5 AS BIGINT) AS request_id, CAST(query_id % 5 AS INTEGER) AS query_ord, CAST(5 - query_id % 5 AS INTEGER) AS weight, vec_id, rank, rel, text FROM valid),
firsts AS (SELECT * FROM req QUALIFY row_number() OVER (PARTITION BY request_id, substr(text, 1, 80) ORDER BY query_ord, rank) = 1),
fused AS (SELECT *, rel * (1 + weight * 0.1::DOUBLE) AS weighted,
  CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(rel * (1 + weight * 0.1::DOUBLE), 12) DESC, query_ord, rank) AS INTEGER) AS fused_rank FROM firsts)"""


def _fused(spark, sf_dir):
    """Five vectors make up one request: four by falling weight and a general one."""
    q = F.col("query_id")
    hits = _valid_hits(spark, sf_dir, cfg.HITS_PER_QUERY).withColumns(
        {
            "request_id": F.floor(q / 5),
            "query_ord": (q % 5).cast("int"),
            "weight": (5 - q % 5).cast("int"),
        }
    )
    return retrieve.fuse(hits, "request_id")


@query("multi_query_fusion", _FUSED + " SELECT request_id, fused_rank, vec_id, query_ord, weight, round(rel, 6) AS relevance, round(weighted, 6) AS weighted_score, text FROM fused")
def multi_query_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select(
        "request_id", "fused_rank", "vec_id", "query_ord", "weight", F.round("relevance", 6).alias("relevance"),
        F.round("weighted_score", 6).alias("weighted_score"), "text",
    )


_WORST = """, ranked AS (SELECT *, greatest(
  CASE WHEN sistolicki_krvni_tlak >= 180 THEN 5 WHEN sistolicki_krvni_tlak >= 160 THEN 4 WHEN sistolicki_krvni_tlak >= 140 THEN 3
       WHEN sistolicki_krvni_tlak >= 130 THEN 2 WHEN sistolicki_krvni_tlak >= 120 THEN 1 ELSE 0 END,
  CASE WHEN dijastolicki_krvni_tlak >= 110 THEN 5 WHEN dijastolicki_krvni_tlak >= 100 THEN 4 WHEN dijastolicki_krvni_tlak >= 90 THEN 3
       WHEN dijastolicki_krvni_tlak >= 85 THEN 2 WHEN dijastolicki_krvni_tlak >= 80 THEN 1 ELSE 0 END) AS worst FROM weighted)"""


FACTOR_NAMES = list(cfg.QUERY_PHRASES)

# Every patient's searches: one for each factor, whose vector is the one with the factor's number, and the general one, number 0.
_ASKED = f"""plan AS (SELECT patient_id, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY weight DESC, ord) - 1 AS INTEGER) AS query_ord, weight,
  list_position([{", ".join(f"'{n}'" for n in FACTOR_NAMES)}], factor) AS query_id FROM named
  UNION ALL SELECT patient_id, CAST((SELECT count(*) FROM named n WHERE n.patient_id = w.patient_id) AS INTEGER), 1, 0 FROM weighted w),
req AS (SELECT patient_id AS request_id, query_ord, weight, vec_id, rank, rel, text FROM plan JOIN valid USING (query_id)),
firsts AS (SELECT * FROM req QUALIFY row_number() OVER (PARTITION BY request_id, substr(text, 1, 80) ORDER BY query_ord, rank) = 1),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(rel * (1 + weight * 0.1::DOUBLE), 12) DESC, query_ord, rank) AS INTEGER) AS fused_rank FROM firsts)"""


def _with_request(people):
    """People with the factors they ask about and the places of these in the report, which name their request."""
    factors = F.transform(risk.factors_column(risk.factor_slots()), lambda f: F.struct(f["ord"].alias("ord"), f["factor"].alias("factor"), f["weight"].alias("weight")))
    asked = people.withColumn("factors", factors)
    return asked.withColumn("request", F.array_join(F.transform("factors", lambda f: f["ord"].cast("string")), ","))


def _plan(people):
    """The searches of every different request."""
    requests = people.select("request", "factors").distinct()
    plan = risk.multi_query_plan(requests, "request", F.col("factors"), F.lit(None).cast("string"))
    number = F.array_position(F.lit([n.replace("_", " ") for n in FACTOR_NAMES]), F.col("query_text"))
    return plan.select("request", "query_ord", "weight", number.alias("query_id"))


def _asked(spark, sf_dir, people):
    """The fused hits of every request, without texts, and the texts; the hits are few for each factor, so they go to the requests."""
    hits = materialize(_valid_hits(spark, sf_dir, cfg.HITS_PER_QUERY).where(F.col("query_id") <= len(FACTOR_NAMES)), "factor-hits")
    asked = _plan(people).join(F.broadcast(retrieve.without_text(hits)), "query_id")
    return retrieve.fuse(asked, "request"), hits.select("vec_id", "text")


@query("advice_report", with_views("weighted", _FACTOR_ROWS + _WORST + ", " + _TOPK.format(k=6) + ", " + _TEXTS + ", " + _ASKED + f""",
shown AS (SELECT request_id, text, rel, row_number() OVER (PARTITION BY request_id ORDER BY fused_rank) AS no FROM fused WHERE fused_rank <= 8 AND length(text) >= 40 QUALIFY no <= 4),
lists AS (SELECT request_id, count(*) AS n, string_agg(concat('**Preporuka ', no, '** (relevantnost: ', CAST(round_even(rel * 100, 0) AS INTEGER), '%):', chr(10), text, chr(10)), chr(10) ORDER BY no) AS body
  FROM shown GROUP BY request_id)
SELECT patient_id, CAST(COALESCE(n, 0) AS INTEGER) AS n_items, CASE WHEN n IS NULL AND patient_id NOT IN (SELECT request_id FROM fused) THEN '{cfg.ADVICE_NONE}'
  ELSE concat(CASE WHEN nivo_rizika = 'High' THEN '{cfg.BANNER_HIGH}' ELSE '{cfg.BANNER_STANDARD}' END, chr(10), {_summary_sql()}, chr(10), COALESCE(body, '{cfg.ADVICE_EMPTY}')) END AS advice
FROM ranked LEFT JOIN lists ON patient_id = request_id"""))
def advice_report(spark, sf_dir):
    classed = _with_request(risk.with_classes(patients(spark, sf_dir)))
    people = classed.select("patient_id", "request", cfg.TARGET, risk.summary_column(risk.factor_slots()).alias("summary"))
    fused, texts = _asked(spark, sf_dir, classed)
    return retrieve.advice(people, fused, "request", F.col(cfg.TARGET), F.col("summary"), key="patient_id", texts=texts, corpus_id="vec_id")


@query("advice_by_factor", with_views("weighted", _FACTOR_ROWS + ", " + _TOPK.format(k=6) + ", " + _TEXTS + ", " + _ASKED + """,
best AS (SELECT request_id, vec_id FROM fused WHERE fused_rank = 1),
led AS (SELECT patient_id, query_id FROM plan WHERE query_ord = 0)
SELECT CAST(query_id AS BIGINT) AS query_id, count(*) AS patients, count(DISTINCT vec_id) AS first_items FROM led LEFT JOIN best ON request_id = patient_id GROUP BY query_id"""))
def advice_by_factor(spark, sf_dir):
    """For each heaviest factor (0 for none) its patients and how many different items come first for them."""
    classed = _with_request(risk.with_classes(patients(spark, sf_dir)))
    asking = classed.groupBy("request").agg(F.count("*").alias("n"))
    led = _plan(classed).where("query_ord = 0").select("request", "query_id").join(asking, "request")
    best = _asked(spark, sf_dir, classed)[0].where("fused_rank = 1").select("request", "vec_id")
    return led.join(best, "request", "left").groupBy("query_id").agg(F.sum("n").alias("patients"), F.count_distinct("vec_id").alias("first_items"))


# ---- nearest neighbours -------------------------------------------------------------------


def _scaled_parts(spark, sf_dir):
    df = split.stratified_split(patients(spark, sf_dir), cfg.TARGET, "patient_id")
    scaled = metrics.standard_scale(df, metrics.scale_parameters(df.where("NOT is_test"), cfg.FEATURES))
    ready = scaled.select("patient_id", "is_test", (F.col(cfg.TARGET) == "High").cast("int").alias("label"),
                          F.array(*cfg.FEATURES).alias("embedding"))
    return ready.where("NOT is_test"), ready.where("is_test")


@query("knn_classify", with_views("patients", SCALED_VIEW + """, d AS (SELECT t.patient_id, r.patient_id AS near, r.nivo_rizika, round("""
       + " + ".join(f"(t.{c} - r.{c}) * (t.{c} - r.{c})" for c in cfg.FEATURES) + """, 9) AS d2
  FROM (SELECT * FROM z WHERE is_test) t, (SELECT * FROM z WHERE NOT is_test) r),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY d2, near) <= 5)
SELECT patient_id, round(avg(CASE WHEN nivo_rizika = 'High' THEN 1 ELSE 0 END), 6) AS p_high,
  CASE WHEN avg(CASE WHEN nivo_rizika = 'High' THEN 1 ELSE 0 END) > 0.5 THEN 1 ELSE 0 END AS prediction FROM n GROUP BY patient_id"""))
def knn_classify(spark, sf_dir):
    train, test = _scaled_parts(spark, sf_dir)
    found = neighbours.knn_classify(train, test, "patient_id", "label", k=5)
    return found.select("patient_id", F.round("p_high", 6).alias("p_high"), "prediction")


@query("knn_pruning", with_views("patients", SCALED_VIEW + " SELECT count(*) * 5 AS hits, TRUE AS under_a_fifth FROM z WHERE is_test"))
def knn_pruning(spark, sf_dir):
    """Neighbours found, and whether less than a fifth of all pairs were compared for them, where there are ten million or more."""
    train, test = _scaled_parts(spark, sf_dir)
    join = neighbours.knn_join(train.withColumnRenamed("patient_id", "near"), test, 5, "near", "patient_id")
    return join.hits.agg(F.count("*").alias("hits"), F.lit(5 * join.compared < join.possible or join.possible < 10**7).alias("under_a_fifth"))
