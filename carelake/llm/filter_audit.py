"""How quality filters interact: what every filter removes in every order, from a sparse document-term matrix.

Texts are cut into shards of whole rows. A shard keeps its rows as a sparse matrix over its own words, ordered by hash. All
shards' words are then numbered once: a range of hashes is a bucket, a bucket's task numbers its words in a dictionary by their
bytes, and bucket and number together are the global term. Shards are recoded to terms. Row sums of the matrix are word counts,
its stored entries per row are distinct words; these decide filters A and B. C, D and E are attached, documents are counted by
part and set of failed filters, and all 120 orders are evaluated on those counts.

Only a shard's vocabulary goes to the buckets, never its text, and a word occurs there once however often it stands in the
shard. Buckets grow in number with the vocabularies, so a task holds about ``BUCKET_BYTES`` of words; occurrences stream through.
Copies meet by the SHA-256 of the text: their smallest id is aggregated first, and the written result is joined back, so that
a large group of copies can be split. A part becomes at most 32 rows before orders are considered.

Defined results: a null text is empty, a null source is the empty part; an empty text fails A, and E if a smaller id is empty
too. Rows that repeat an id count each, and are no copies of each other (E asks for a smaller id); a row without an id fails
no E and has no label. An id with several label rows is good or toxic if any of them says so. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.textbytes import SPACED, Words, shards, text_bytes, words_of
from carelake.session import materialize

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Bytes of words in a bucket of the dictionary.
BUCKET_BYTES = 4 << 20
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_FOLLOWS = np.array([b & 0xC0 == 0x80 for b in range(256)])
_MARK = np.array([chr(b) in "#$%&*|" for b in range(256)])


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags of every row."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _listed(values: pa.Array) -> pa.Array:
    """One list that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(values: np.ndarray, kind: type) -> pa.Array:
    return pa.array([values.astype(kind).tobytes()], pa.binary())


def _local_matrix(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row: the documents of a shard, their matrix over the shard's own words, and those words in order of their hashes."""
    texts = batch.column("text")
    buf, offsets = text_bytes(texts)
    words = words_of(texts, SPACED, lower=False)
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    letters = np.ascontiguousarray(buf[SPACED[buf]]) if len(buf) else buf
    coded = pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
    size = max(1, len(coded.dictionary))
    spelled, at = text_bytes(coded.dictionary)
    order = np.argsort(Words(spelled, at[:-1], at[1:], np.zeros(len(at) - 1, np.int64), 1).hashes(), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    local = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    cells, counts = np.unique(words.doc * size + local, return_counts=True)
    indptr = np.concatenate([[0], np.cumsum(np.bincount(cells // size, minlength=len(texts)))])
    points = (offsets[1:] - offsets[:-1]) - _per_row(_FOLLOWS[buf], offsets)
    columns = {
        "doc_ids": _listed(batch.column("doc_id")),
        "parts": _listed(batch.column("part")),
        "digests": _listed(batch.column("digest")),
        "fails_c": _listed(pa.array(100 * _per_row(_CAPITAL[buf], offsets) > MAX_CAPITALS * points)),
        "fails_d": _listed(pa.array(_per_row(_MARK[buf], offsets) > 0)),
        "indptr": _packed(indptr, np.int64),
        "codes": _packed(cells % size, np.int32),
        "counts": _packed(counts, np.int32),
        "words": pc.binary_join(_listed(coded.dictionary.take(pa.array(order)).cast(pa.binary())), b"\n"),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _cells(bits: int):
    """(bucket, shard, words) for every bucket that a shard has words of; the first ``bits`` bits of a hash are its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column("shard"), batch.column("words"), strict=True):
                words = words_of(pa.array([blob.as_buffer().to_pybytes().decode()]), SPACED, lower=False)
                if len(words.starts):
                    bucket = (words.hashes() >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words.starts), np.int64)
                    first = np.flatnonzero(np.diff(bucket, prepend=-1))
                    last = np.append(first[1:], len(bucket)) - 1
                    parts = [words.buf[words.starts[i] : words.ends[j]].tobytes() for i, j in zip(first, last, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[first]), pa.array([shard.as_py()] * len(first), pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "shard", "words"]
                    )

    return run


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes], dict[bytes, int]]]:
    """(bucket, shard, words, numbers of the bucket's words so far) in the order of bucket and shard."""
    at, known = None, {}
    for batch in batches:
        for bucket, shard, blob in zip(*(batch.column(c) for c in ("bucket", "shard", "words")), strict=True):
            if bucket.as_py() != at:
                at, known = bucket.as_py(), {}
            yield at, shard.as_py(), blob.as_py().split(b"\n"), known


def _terms(bits: int):
    """The terms of a cell's words. A term is the word's number in its bucket, then the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, shard, words, known in _bucket_rows(batches):
            number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
            row = [pa.array([shard], pa.int64()), pa.array([bucket], pa.int64()), _packed((number << bits) + bucket, np.int64)]
            yield pa.RecordBatch.from_arrays(row, names=["shard", "bucket", "terms"])

    return run


def _vocabulary(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, words, known in _bucket_rows(batches):
            new = [w.decode() for w in words if w not in known]
            terms = [(len(known) + i << bits) + bucket for i in range(len(new))]
            known.update((w.encode(), len(known)) for w in new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), pa.array(terms, pa.int64())], names=["word", "term"])

    return run


_SHARD = ("doc_ids", "parts", "digests", "fails_c", "fails_d", "indptr", "codes", "counts")


def _recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards over global terms, ascending in every row. A shard's own row comes first, then its terms by bucket."""
    shard, terms = None, []

    def recoded() -> pa.RecordBatch:
        codes, counts = (np.frombuffer(shard.column(c)[0].as_py(), np.int32) for c in ("codes", "counts"))
        indptr = np.frombuffer(shard.column("indptr")[0].as_py(), np.int64)
        known = np.concatenate([np.frombuffer(t, np.int64) for t in terms]) if terms else np.zeros(0, np.int64)
        new = known[codes]
        order = np.lexsort((new, np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))))
        changed = {"codes": _packed(new[order], np.int64), "counts": _packed(counts[order], np.int32)}
        return pa.RecordBatch.from_arrays([changed.get(n, shard.column(n)) for n in _SHARD], names=list(_SHARD))

    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            if one.column("bucket")[0].as_py() < 0:
                if shard is not None:
                    yield recoded()
                shard, terms = one, []
            else:
                terms.append(one.column("terms")[0].as_py())
    if shard is not None:
        yield recoded()


def _row_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document with its row sum and its number of stored entries."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = {n: batch.column(n).slice(row, 1).flatten() for n in _SHARD[:5]}
            indptr = np.frombuffer(batch.column("indptr")[row].as_py(), np.int64)
            counts = np.frombuffer(batch.column("counts")[row].as_py(), np.int32)
            total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            columns = [*one.values(), pa.array(total[indptr[1:]] - total[indptr[:-1]]), pa.array(np.diff(indptr))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "fails_c", "fails_d", "n_words", "n_distinct"])


def _shard_fields(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"doc_ids array<{kind}>, parts array<string>, digests array<binary>, fails_c array<boolean>, fails_d array<boolean>, indptr binary, codes binary, counts binary"


def _coded(docs: DataFrame, shard_bytes: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Cells of the vocabulary by bucket, every shard's own row with its terms behind it, and the bits of a bucket."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in shards(batch, "text", shard_bytes):
                yield _local_matrix(shard)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    local = rows.mapInArrow(build, f"{_shard_fields(docs)}, words binary").withColumn("shard", F.monotonically_increasing_id())
    local = materialize(local, "shards")
    total = local.agg(F.sum(F.length("words"))).first()[0] or 0
    bits = max(0, (total // bucket_bytes).bit_length())
    cells = local.select("shard", "words").mapInArrow(_cells(bits), "bucket long, shard long, words binary")
    cells = cells.repartition("bucket").sortWithinPartitions("bucket", "shard")
    terms = cells.mapInArrow(_terms(bits), "shard long, bucket long, terms binary")
    own = local.drop("words").withColumn("bucket", F.lit(-1).cast("long"))
    both = own.unionByName(terms, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "bucket")
    return cells, both, bits


def term_matrix(docs: DataFrame, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (word, term) and the matrix in shards, one row each.

    A shard has doc_ids, parts, digests, fails_c, fails_d for its documents, and as packed numbers indptr (64 bits), codes
    (terms, 64 bits) and counts (32 bits). No two words share a term; terms have gaps.
    """
    cells, both, bits = _coded(docs, shard_bytes, bucket_bytes)
    return cells.mapInArrow(_vocabulary(bits), "word string, term long"), both.mapInArrow(_recode, _shard_fields(docs))


def failed_filters(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, part and ``fails``, the letters of the filters that the document fails, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    _, both, _ = _coded(docs, shard_bytes, BUCKET_BYTES)
    # the recoded shards are summed in the same Python worker
    rows = both.mapInArrow(lambda batches: _row_totals(_recode(batches)), f"doc_id {kind}, part string, digest binary, fails_c boolean, fails_d boolean, n_words bigint, n_distinct bigint")
    rows = materialize(rows, "matrix-rows")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    copies = materialize(copies.where("least < most").select("digest", "least"), "copies")
    fails = {
        "A": F.col("n_words") < MIN_WORDS, "B": 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"),
        "C": F.col("fails_c"), "D": F.col("fails_d"), "E": F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)),
    }
    letters = F.concat(*(F.when(test, F.lit(f)).otherwise(F.lit("")) for f, test in fails.items()))
    return rows.join(copies, "digest", "left").select("doc_id", "part", letters.alias("fails"))


def _orders(spark) -> DataFrame:
    """Every order, step and set of failed filters: 120 x 5 x 32 rows, whatever the input."""
    sets = ["".join(f for i, f in enumerate(FILTERS) if k >> i & 1) for k in range(1 << len(FILTERS))]
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = spark.range(1).select(F.explode(F.lit(orders)).alias("filter_order"))
    rows = rows.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = rows.select("*", F.explode(F.lit(sets)).alias("fails"))
    rows = rows.selectExpr("*", "substring(filter_order, step, 1) AS letter", "substring(filter_order, 1, step - 1) AS earlier")
    return rows.selectExpr("filter_order", "step", "fails", "letter", "instr(fails, letter) > 0 AS fails_here", "translate(earlier, fails, '') = earlier AS reached")


def filter_audit(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    rows = failed_filters(docs, shard_bytes).join(marks, "doc_id", "left")
    counts = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    steps = counts.join(F.broadcast(_orders(docs.sparkSession)), "fails")
    removed = F.col("fails_here") & F.col("reached")

    def total(when, value: str = "n"):
        return F.sum(F.when(when, F.coalesce(value, F.lit(0))).otherwise(0)).cast("long")

    audit = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~F.col("fails_here") & F.col("reached")).alias("kept"),
        total(removed).alias("removed"),
        total(F.col("fails_here") & ~F.col("reached")).alias("redundant"),
        total(F.col("fails") == F.col("letter")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return audit.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)
