"""Token files in a static range asymmetric numeral system (rANS).

A folder holds ``table`` (symbol frequencies, shared by all blocks) and ``blocks`` (Parquet rows, one independent block
each). A block holds whole documents, its ids dealt over interleaved lanes, coded last to first into one stream of
32-bit words. Every ``CHECK`` steps a checkpoint keeps all lane states and the place in the stream, so segments decode
in parallel, and a checksum of the segment's words; the decoder also ends every block in the known start state.

Payload, little-endian: 8 x uint32 (magic, lanes, steps per checkpoint, steps, documents, checkpoints, words, 0), then per
document int64 id, uint8 known, uint64 number of ids, then per checkpoint lanes x uint64 states, uint64 word offset,
uint32 crc32 of its words, then the words as uint32.

Texts are encoded word by word: the tokenizer drops white space and never joins across it, so equal words between white
space have equal ids and each distinct one of a shard is encoded once, by the tokenizers library.
Where the tokenizer's own pattern always cuts between ASCII letters or digits and punctuation, words are cut there too, so a word
is not encoded again for each comma that follows it.

Defined results: a null text is empty and gives the end id alone; documents follow ascending ids, null first; rows that
repeat an id follow each other, equal texts together; an empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.textbytes import SPACED, Words, shards, words_of
from carelake.session import run_dir

END = 1
LANES, CHECK = 32, 512
BLOCK_IDS, GROUP_IDS = 1 << 16, 1 << 21
#: Words whose ids a worker remembers; when there are more it starts again.
CACHE_WORDS = 1_000_000
#: Bytes of text that are encoded together, and words that the tokenizer gets as one text.
ENCODE_BYTES, TOGETHER = 1 << 20, 128
#: The pattern of tokenizers that part letters, digits and the rest; an apostrophe may go with what follows.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: 1 for ASCII letters and digits, 2 for ASCII punctuation but the apostrophe: such a pattern cuts between the two.
PARTED = np.array([1 if chr(b).isalnum() else 2 if 32 < b < 127 and b != 39 else 0 for b in range(128)] + [0] * 128, np.uint8)
MAGIC = 0x31534E52
_LOW = np.uint64(1 << 31)
_ENCODED = "part long, block long, base long, n_ids long, kind string, docs array<long>, sizes array<long>, ids binary"
_BLOCKS = "part long, block long, base long, n_ids long, payload binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of many texts, each distinct word encoded once while a worker remembers it.

    A word is looked up by its hash and then compared with the remembered one byte by byte; one that differs is encoded for itself.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parted = PARTED if self._parts_words() else None
        self.forget()

    def _parts_words(self) -> bool:
        """Whether the tokenizer is known to cut wherever ``PARTED`` does: by its pattern, after steps that neither move nor join ASCII."""

        def steps(part, inner: str) -> list[dict]:
            state = json.loads(part.__getstate__()) if part else {}
            return state.get(inner, [state])

        cuts = steps(self.tokenizer.pre_tokenizer, "pretokenizers")
        cut = [s for s in cuts if s.get("type") == "Split" and s["pattern"] == {"Regex": _PATTERN} and s["invert"] and s["behavior"] == "Removed"]
        plain = [s for s in cuts if s.get("type") == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"]]
        space = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        kept = all(s.get("type") in (None, "NFC", "Lowercase") or s == space for s in steps(self.tokenizer.normalizer, "normalizers"))
        return cuts[:1] == cut and len(cut) + len(plain) == len(cuts) and kept

    def forget(self, slots: int = 0) -> None:
        # open addressing by word hash: key and number of the word; 0 is no hash
        slots = max(slots, 2 * CACHE_WORDS)
        self.keys, self.values = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        # the remembered words: ids, number of bytes, blocks of eight bytes, and where each word's ids and blocks begin
        self.start, self.ids = np.zeros(1, np.uint32), np.zeros(0, np.uint32)
        self.size, self.blocks, self.first = np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(1, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for an unknown one."""
        out, left, n = np.full(len(h), -1, np.int64), np.arange(len(h)), np.uint64(len(self.keys))
        slot = (h % n).astype(np.int64)
        while len(left):
            k = self.keys[slot[left]]
            hit = k == h[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (k != 0)]
            slot[left] = (slot[left] + 1) % len(self.keys)
        return out

    def _same(self, words: Words, blocks: np.ndarray, first: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each word is the remembered one in its place."""
        same = (words.ends - words.starts) == self.size[place]
        same &= blocks[first[:-1]] == self.blocks[self.first[place]]
        long = np.flatnonzero(same & (np.diff(first) > 1))  # the first block is compared, now the others
        count = np.diff(first)[long] - 1
        each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        differ = blocks[np.repeat(first[:-1][long], count) + each] != self.blocks[np.repeat(self.first[place[long]], count) + each]
        if differ.any():
            same[np.unique(np.repeat(long, count)[differ])] = False
        return same

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has; words of a text are told apart by the places of their ids in it."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), 64 * TOGETHER):
            some = [words[i : i + TOGETHER] for i in range(k, min(k + 64 * TOGETHER, len(words)), TOGETHER)]
            for own, e in zip(some, self.tokenizer.encode_batch([" ".join(x) for x in some], add_special_tokens=False), strict=True):
                span = np.fromiter(chain.from_iterable(e.offsets), np.int64).reshape(-1, 2)
                ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
                first, last = np.searchsorted(ends, span[:, 0], "right"), np.searchsorted(ends, span[:, 1] - 1, "right")
                if (first == last).all() and (first[1:] >= first[:-1]).all():
                    ids.append(np.array(e.ids, np.uint32))
                    sizes.append(np.bincount(first, minlength=len(own)))
                else:  # ids that are not within a word
                    each = [x.ids for x in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                    ids.append(np.fromiter(chain.from_iterable(each), np.uint32))
                    sizes.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(sizes)

    def _add(self, h: np.ndarray, words: Words, at: np.ndarray, blocks: np.ndarray, first: np.ndarray) -> None:
        raw = words.buf.tobytes()
        ids, sizes = self._encoded([raw[a:b].decode() for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)])
        counts = np.diff(first)[at]
        self.size = np.append(self.size, (words.ends - words.starts)[at].astype(np.uint32))
        self.blocks = np.append(self.blocks, blocks[np.repeat(first[at], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)])
        self.first = np.append(self.first, (int(self.first[-1]) + np.cumsum(counts)).astype(np.uint32))
        known = len(self.start) - 1
        self.start = np.append(self.start, (len(self.ids) + np.cumsum(sizes)).astype(np.uint32))
        self.ids = np.append(self.ids, ids)
        left, slot = np.arange(len(h)), (h % np.uint64(len(self.keys))).astype(np.int64)
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.values[slot[won]] = h[won], known + won
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) % len(self.keys)

    def _holds_added(self, raw: bytes) -> bool:
        return any(a in raw for a in self.added)

    def encode(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; number of ids of each text)."""
        words = words_of(texts, SPACED, lower=False, parted=self.parted)
        if self.parted is not None and self._holds_added(words.buf.tobytes()):
            words = words_of(texts, SPACED, lower=False)  # an added token is found before the pattern is
        h = words.hashes()
        blocks, first = words.blocks
        if len(self.size) > CACHE_WORDS:
            self.forget()
        place = self._find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            each, at = np.unique(h[new], return_index=True)
            if 4 * (len(each) + len(self.size)) > 3 * len(self.keys):  # a giant text: a table for it alone
                each, at = np.unique(h, return_index=True)
                new = np.arange(len(h))
                self.forget(2 * len(each))
            self._add(each, words, new[at], blocks, first)
            place[new] = self._find(h[new])
        other = np.flatnonzero(~self._same(words, blocks, first, place))
        if len(other):  # other words with the hash of a remembered one
            raw = words.buf.tobytes()
            more, sizes = self._encoded([raw[words.starts[i] : words.ends[i]].decode() for i in other.tolist()])
            place[other] = len(self.size) + np.arange(len(other))
            start = np.append(self.start, (len(self.ids) + np.cumsum(sizes)).astype(np.uint32))
            return self._filled(words, place, start, np.append(self.ids, more), end)
        return self._filled(words, place, self.start, self.ids, end)

    @staticmethod
    def _filled(words: Words, place: np.ndarray, start: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text's words from their places among the encoded ones; a word's ids end where the next one's start."""
        begin = start[place].astype(np.int64)
        n = start[place + 1] - begin
        sizes = np.bincount(words.doc, weights=n, minlength=words.n_docs).astype(np.int64) + 1
        out = np.empty(sizes.sum(), np.uint32)
        ends = np.cumsum(sizes) - 1
        body = np.ones(len(out), bool)
        body[ends] = False
        out[ends] = end
        at = np.repeat(begin - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        out[body] = ids[at]
        return out, sizes


@lru_cache(maxsize=1)
def _encoder(tokenizer: str) -> WordEncoder:
    """Kept by a worker from task to task."""
    return WordEncoder(tokenizer)


class Coder:
    """The shared table and the two directions of the code, over many blocks at once."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = bits
        self.freq = np.append(freq, 1 << bits).astype(np.uint64)  # the last symbol pads: coding it changes nothing
        self.cum = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """For each block (states at checkpoints, word offsets, words, steps)."""
        steps = [max(1, -(-len(b) // LANES)) for b in blocks]
        most, pad, bits = max(steps), len(self.freq) - 1, np.uint64(self.bits)
        sym = np.full((len(blocks), most * LANES), pad, np.uint32)
        for i, b in enumerate(blocks):
            sym[i, : len(b)] = b
        sym = np.ascontiguousarray(sym.reshape(len(blocks), most, LANES).transpose(1, 0, 2)).reshape(most, -1)
        x = np.full(sym.shape[1], _LOW, np.uint64)
        words, emitted = np.empty(sym.shape, np.uint32), np.empty(sym.shape, bool)
        states = np.empty((-(-most // CHECK), sym.shape[1]), np.uint64)
        shift = np.uint64(63 - self.bits)
        for t in range(most - 1, -1, -1):
            f = self.freq[sym[t]]
            over = x >= f << shift
            emitted[t], words[t] = over, x.astype(np.uint32)
            x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            x = (q << bits) + (x - q * f) + self.cum[sym[t]]
            if t % CHECK == 0:
                states[t // CHECK] = x
        out = []
        for i, n in enumerate(steps):
            cols, marks = slice(i * LANES, (i + 1) * LANES), range(0, n, CHECK)
            e = emitted[:n, cols]
            before = np.concatenate(([0], np.cumsum(e.sum(axis=1))))
            out.append((states[: len(marks), cols], before[list(marks)], words[:n, cols][e], n))
        return out

    def decode(self, parts: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of segments (lane states, words from the checkpoint on, number of ids); all are decoded together."""
        if not parts:
            return []
        counts = np.array([n for *_, n in parts], np.int64)
        x = np.stack([s for s, *_ in parts]).astype(np.uint64)
        stream = np.concatenate([w for _, w, _ in parts] + [np.zeros(1, np.uint32)]).astype(np.uint64)
        at = np.concatenate(([0], np.cumsum([len(w) for _, w, _ in parts])))[:-1]
        most, mask, bits = int(-(-counts.max() // LANES)), np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        out, lane = np.zeros((most, *x.shape), np.uint32), np.arange(LANES)
        for t in range(most):
            live = t * LANES + lane[None, :] < counts[:, None]
            slot = x & mask
            s = self.symbol[slot]
            y = self.freq[s] * (x >> bits) + slot - self.cum[s]
            need = live & (y < _LOW)
            rank = np.cumsum(need, axis=1)
            word = stream[np.minimum(at[:, None] + rank - 1, len(stream) - 1)]
            y = np.where(need, (y << np.uint64(32)) | word, y)
            x = np.where(live, y, x)
            at = at + rank[:, -1]
            out[t] = s
        self.last = x
        return [out[:, i].reshape(-1)[:n] for i, n in enumerate(counts)]


def frequencies(counts: dict[int, int], size: int, bits: int) -> np.ndarray:
    """Counts scaled to a sum of 2**bits, at least 1 for each symbol that occurs."""
    c = np.zeros(size, np.int64)
    for k, v in counts.items():
        c[k] = v
    if not c.sum():
        c[0] = 1
    if (c > 0).sum() > 1 << bits:
        raise ValueError("more symbols occur than the table has room for")
    f = np.where(c > 0, np.maximum(1, (c.astype(float) * ((1 << bits) / c.sum())).astype(np.int64)), 0)
    order = np.argsort(-f, kind="stable")
    rest = (1 << bits) - int(f.sum())
    while rest:  # rounding is put right on the most frequent symbols
        for i in order:
            step = max(rest, 1 - f[i]) if rest < 0 else rest
            f[i] += step
            rest -= step
            if not rest:
                break
    return f


def pack_block(ids: list[int | None], sizes: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> bytes:
    states, offsets, words, steps = coded
    head = struct.pack("<8I", MAGIC, LANES, CHECK, steps, len(ids), len(states), len(words), 0)
    ends = [*offsets[1:].tolist(), len(words)]
    crc = [zlib.crc32(words[a:b].tobytes()) for a, b in zip(offsets.tolist(), ends, strict=True)]
    return b"".join((
        head, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes(), sizes.astype("<u8").tobytes(),
        states.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), np.array(crc, "<u4").tobytes(), words.astype("<u4").tobytes(),
    ))


def unpack_block(raw: bytes) -> tuple[list[int | None], np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
    """(document ids, their numbers of ids, segments to decode); a wrong checksum is an error."""
    magic, lanes, check, _, n_docs, n_marks, n_words, _ = struct.unpack_from("<8I", raw)
    if magic != MAGIC or lanes != LANES:
        raise ValueError("not a block of a token file")
    at = 32

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    ids, known, sizes = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs).astype(np.int64)
    states = take("<u8", n_marks * lanes).reshape(n_marks, lanes)
    offsets, crc, words = take("<u8", n_marks).astype(np.int64), take("<u4", n_marks), take("<u4", n_words)
    ends, left, segments = [*offsets[1:].tolist(), n_words], int(sizes.sum()), []
    for k in range(n_marks):
        own = words[offsets[k] : ends[k]]
        if zlib.crc32(own.tobytes()) != crc[k]:
            raise ValueError(f"checksum of segment {k} is wrong")
        segments.append((states[k], own, min(left, lanes * check)))
        left -= segments[-1][2]
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], sizes, segments


def _block(tokenizer) -> Callable:
    """Encodes sorted documents to blocks of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(tokenizer.value), TaskContext.get().partitionId()
        block, base = 0, 0
        for batch in batches:
            for part in shards(batch, "text", ENCODE_BYTES):
                ids = part.column("doc_id").to_pylist()
                tokens, sizes = encoder.encode(part.column("text"))
                cut, a, rows = np.concatenate(([0], np.cumsum(sizes))), 0, []
                while a < len(ids):
                    b = max(a + 1, int(np.searchsorted(cut, cut[a] + BLOCK_IDS, "right")) - 1)
                    own = tokens[cut[a] : cut[b]]
                    kind = "<u2" if own.max() < 1 << 16 else "<u4"
                    rows.append((number, block, base, len(own), kind, ids[a:b], sizes[a:b], own.astype(kind).tobytes()))
                    block, base, a = block + 1, base + len(own), b
                kinds = (*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "block", "base", "n_ids", "kind", "docs", "sizes", "ids"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw, kind in zip(batch.column("ids"), batch.column("kind"), strict=True):
            n = np.bincount(np.frombuffer(raw.as_buffer(), kind.as_py()))
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])


def _code(table) -> Callable:
    """Codes blocks, those of about GROUP_IDS ids together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*table.value)
        for batch in batches:
            n_ids, a = batch.column("n_ids").to_pylist(), 0
            while a < batch.num_rows:
                b, longest = a + 1, n_ids[a]
                while b < batch.num_rows and (b + 1 - a) * max(longest, n_ids[b]) <= GROUP_IDS:
                    longest, b = max(longest, n_ids[b]), b + 1
                some, a = batch.slice(a, b - a), b
                blocks = [np.frombuffer(x.as_buffer(), k.as_py()).astype(np.uint32) for x, k in zip(some.column("ids"), some.column("kind"), strict=True)]
                packed = [pack_block(i, np.array(s), c) for i, s, c in zip(some.column("docs").to_pylist(), some.column("sizes").to_pylist(), coder.encode(blocks), strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("part", "block", "base", "n_ids")), pa.array(packed, pa.binary())], names=["part", "block", "base", "n_ids", "payload"])

    return run


def _read(table) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*table.value)
        for batch in batches:
            n_ids = batch.column("n_ids").to_pylist()
            a = 0
            while a < batch.num_rows:
                b, total = a + 1, n_ids[a]
                while b < batch.num_rows and total + n_ids[b] <= GROUP_IDS:
                    total, b = total + n_ids[b], b + 1
                some = batch.slice(a, b - a)
                a = b
                blocks = [unpack_block(x) for x in some.column("payload").to_pylist()]
                decoded = coder.decode([s for *_, segments in blocks for s in segments])
                rows, k = [], 0
                for (ids, sizes, segments), first in zip(blocks, some.column("first").to_pylist(), strict=True):
                    k += len(segments)
                    if (coder.last[k - 1] != _LOW).any():
                        raise ValueError("a block does not end in the start state")
                    tokens = np.concatenate(decoded[k - len(segments) : k]).astype("<u4")
                    cut = np.concatenate(([0], np.cumsum(sizes)))
                    for i, x, y in zip(ids, cut.tolist(), cut[1:].tolist(), strict=False):
                        rows.append((i, first + x, y - x, tokens[x:y].tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), pa.array([zlib.crc32(x) for x in cols[3]], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode all documents in ascending id order and write the folder.

    Ids are written once as they are, counted for the shared table, and then coded block by block.
    """
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        text = f.read()
    shared = spark.sparkContext.broadcast(text)  # a vocabulary file, a few MB
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").select("doc_id", "text")
    encoded = run_dir(spark, "token-ids")
    ordered.mapInArrow(_block(shared), _ENCODED).write.option("compression", "zstd").parquet(encoded)
    blocks = spark.read.schema(_ENCODED).parquet(encoded)
    counts = {r["id"]: r["n"] for r in blocks.select("kind", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    size = max([END, *counts]) + 1  # at most the vocabulary
    bits = max(16, (size - 1).bit_length() + 2)
    freq = frequencies(counts, size, bits)
    rows = [(i, int(n)) for i, n in enumerate(freq) if n]
    spark.createDataFrame(rows, "id long, freq long").withColumns({"size": F.lit(size), "bits": F.lit(bits)}).coalesce(1).write.parquet(f"{path}/table")
    blocks.mapInArrow(_code(spark.sparkContext.broadcast((freq, bits))), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32."""
    rows = spark.read.parquet(f"{path}/table").collect()  # at most the vocabulary
    freq = np.zeros(rows[0]["size"], np.int64)
    freq[[r["id"] for r in rows]] = [r["freq"] for r in rows]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    totals, before, offsets = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}, 0, []
    for part in sorted(totals):  # one entry for each written partition
        offsets.append((part, before))
        before += totals[part]
    first = spark.createDataFrame(offsets, "part long, before long")
    placed = blocks.join(first, "part").select("n_ids", "payload", (F.col("before") + F.col("base")).alias("first"))
    table = spark.sparkContext.broadcast((freq, rows[0]["bits"]))
    return placed.mapInArrow(_read(table), "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def token_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents to a token folder in the shared folder and read doc_id, start, n_tokens, ids_crc32 back."""
    path = run_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")
