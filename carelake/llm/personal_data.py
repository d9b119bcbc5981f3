"""Personal data in text: fixed patterns as seeds, and identifiers found by bootstrapping over their contexts.

The seeds are e-mail addresses, IP addresses, card numbers that pass the Luhn test and telephone numbers. The word before a seed, and
the two words before it, are lexical patterns. Every word that looks like an identifier (six or more characters with four or more
digits, or with an @) and every seed is an instance of the patterns it stands in. Spark scores the graph of patterns and instances
in rounds: a pattern's confidence is the sum of its instances' scores over their number plus one, and it is accepted with
``MIN_SUPPORT`` instances that are believed and a confidence of at least ``MIN_CONFIDENCE``; an unseen instance's score is one
minus the product of the doubts (one minus confidence) of its accepted patterns, so it supports further patterns in the next
round. Only telling contexts take part: of all words after a context, in the whole corpus, at least ``MIN_SHARE`` must be
identifiers. Every occurrence of an instance that is believed in the end becomes a ``context`` span.

Words end at white space and at ``_DELIMITERS``, so a glued label ("id:X1234") is a context as well. Spans are (kind, start, end) in
code points, end exclusive.

The texts are read twice and never shuffled: once for spans, instances and contexts, and once to count how often the possible
patterns' contexts occur. For that a Bloom filter of the patterns, of a fixed size, goes to the scan, and what passes it is counted
by its words, so a false hit only costs a row. Edges are counted before they are joined; joined tables are written
first, so a pattern or instance that a third of all rows share is split.

Defined results: a null text is empty and has no spans; repeated rows each get their own result and add nothing to the graph, but
to the counts of their contexts; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.textbytes import SPACED, Words, mix64, shards, words_of
from carelake.session import materialize

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE, MIN_SHARE = 3, 3, 0.5, 0.5, 0.25
MIN_LETTERS, MIN_DIGITS = 6, 4
#: Bits of the filter of possible patterns.
FILTER_BITS = 1 << 26

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match starts at the first digit of a run and takes whole runs, so nothing is tried twice
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DELIMITERS = "\x20\t\n\v\f\r" + ":=<>\"'()[]{},;|"
_WORD = re.compile(f"[^{re.escape(_DELIMITERS)}]+")
_INSIDE = np.array([chr(b) not in _DELIMITERS for b in range(256)])
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part of a match is all that may stand before its @, back to the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of all seeds, ascending."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) < 4 or len(p.lstrip("0")) < 4 for p in m.groups()) and all(int(p[-9:]) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def instances(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, list[str], bool]]:
    """(start, end, lower-cased text, contexts, is a seed) of seeds and of words that look like identifiers outside them."""
    if not spans and "@" not in text and len(_DIGIT.findall(text)) < MIN_DIGITS:
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    taken = [(a, b, True) for a, _, b in spans]
    covered = 0  # end of the seeds that start before a word
    at = 0
    for a, b in words:
        while at < len(spans) and spans[at][0] < b:
            covered = max(covered, spans[at][2])
            at += 1
        if covered <= a and b - a >= MIN_LETTERS:
            word = text[a:b].strip(".!?")
            if len(word) >= MIN_LETTERS and ("@" in word or len(_DIGIT.findall(word)) >= MIN_DIGITS):
                first = text.index(word, a)
                taken.append((first, first + len(word), False))
    out = []
    for a, b, seed in taken:
        i = bisect_right(starts, a) - 1  # the word that the instance starts in
        before = [text[x:y].translate(_LOWER) for x, y in words[max(0, i - 2) : max(0, i)]]
        out.append((a, b, text[a:b].translate(_LOWER), [" ".join(before[k:]) for k in range(len(before))], seed))
    return out


_FOUND = "base array<struct<start: int, kind: int, end: int>>, found array<struct<start: int, end: int, instance: string, contexts: array<string>, seed: boolean>>"
_BASE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("contexts", pa.list_(pa.string())), ("seed", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, found = [], []
        for t in batch.column("text"):
            text = t.as_py() or ""
            spans = base_spans(text)
            base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
            found.append([dict(zip(("start", "end", "instance", "contexts", "seed"), x, strict=True)) for x in instances(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _BASE_TYPE), pa.array(found, _FOUND_TYPE)], names=["doc_id", "base", "found"])


def _context_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the contexts that end at each word: of the word, and of it and the word before."""
    h = words.hashes()
    two = np.zeros(len(h), np.uint64)
    two[1:] = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return mix64(h ^ np.uint64(0x5851F42D4C957F2D)), two


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each hash in the filter; ``bits`` is a power of two."""
    return [((hashes >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 19, 38)]


def _places(bits: int):
    """(word of the filter, its bits) for patterns of one or two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column("pattern"), SPACED, lower=False)
            one, two = _context_hashes(words)
            last = np.cumsum(words.counts) - 1
            hashes = np.where(words.counts == 2, two[last], one[last])
            at = np.unique(np.concatenate(_probes(hashes, bits)))
            cells, first = np.unique(at >> 6, return_index=True)
            if len(cells):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(value.view(np.int64))], names=["cell", "bits"])

    return run


def _pattern_filter(patterns: DataFrame, bits: int) -> np.ndarray:
    """The filter of the patterns. The driver gets ``bits / 64`` numbers at most, whatever the number of patterns."""
    cells = patterns.mapInArrow(_places(bits), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out


def _count_contexts(batches: Iterator[pa.RecordBatch], held, bits: int) -> Iterator[pa.RecordBatch]:
    """How often a word follows each context that passes the filter, per shard."""
    known = held.value
    for batch in batches:
        for shard in shards(batch, "text"):
            words = words_of(shard.column("text"), _INSIDE)
            follows = np.zeros(len(words.doc), bool)
            follows[:-1] = words.doc[1:] == words.doc[:-1]
            joined = np.zeros(len(words.doc), bool)
            joined[1:] = follows[:-1]
            counts: Counter[bytes] = Counter()
            for hashes, may, size in zip(_context_hashes(words), (follows, follows & joined), (1, 2), strict=True):
                at = np.flatnonzero(may)
                for place in _probes(hashes, bits):
                    p = place[at]
                    at = at[(known[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1]
                text = words.buf.tobytes() if len(at) else b""
                for i in at.tolist():
                    counts[b" ".join(text[words.starts[k] : words.ends[k]] for k in range(i - size + 1, i + 1))] += 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([c.decode() for c in counts]), pa.array(counts.values(), pa.int64())], names=["pattern", "n"])


def _telling(docs: DataFrame, edges: DataFrame, bits: int) -> DataFrame:
    """Patterns with enough instances whose contexts are mostly followed by them."""
    spark = docs.sparkSession
    possible = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("times").alias("times")).where(F.col("instances") >= MIN_SUPPORT)
    possible = materialize(possible, "pii-possible")
    held = spark.sparkContext.broadcast(_pattern_filter(possible.select("pattern"), bits))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    seen = rows.mapInArrow(lambda batches: _count_contexts(batches, held, bits), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return materialize(possible.join(seen, "pattern").where(F.col("times") >= MIN_SHARE * F.col("n")).select("pattern", "instances"), "pii-telling")


def score_graph(edges: DataFrame, patterns: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (pattern, confidence) and instances (instance, score) after some rounds.

    ``edges`` are distinct (pattern, instance, seed); ``patterns`` those that may take part, with their number of instances.
    """
    edges = materialize(edges.select("pattern", "instance", "seed").join(patterns, "pattern"), "pii-edges")
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        held = F.when(F.col("score") >= MIN_SCORE, F.col("score"))
        accepted = scored.groupBy("pattern").agg((F.sum("score") / (F.max("instances") + 1)).alias("confidence"), F.count(held).alias("support"))
        accepted = accepted.where((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE)).select("pattern", "confidence")
        accepted = materialize(accepted, "pii-patterns")
        doubt = F.sum(F.log1p(-F.col("confidence")))
        scores = edges.where("not seed").join(accepted, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("score"))
        scores = materialize(scores, "pii-scores")
        scored = edges.join(scores, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
    return accepted, scores


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Every row's doc_id and ``spans``, an array of (start, kind as place in KINDS, end) in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {_FOUND}").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "pii-found")
    found = rows.select("row", F.explode("found").alias("x")).select("row", "x.*")
    edges = found.select("instance", "seed", F.explode("contexts").alias("pattern"))
    edges = materialize(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("times")), "pii-graph")
    _, scores = score_graph(edges, _telling(docs, edges, filter_bits), rounds)
    known = materialize(scores.where(F.col("score") >= MIN_SCORE).select("instance"), "pii-known")
    span = F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")
    added = found.where("not seed").join(known, "instance").groupBy("row").agg(F.collect_list(span).alias("added"))
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start: int, kind: int, end: int>>"))))
    return rows.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", spans.alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_report(docs: DataFrame, rounds: int = ROUNDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans."""
    found = find_personal_data(docs, rounds, filter_bits)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
