"""Windows of very long texts, cut by many tasks.

Where a window begins depends on where the one before ended, so a text is a chain of starts. A segment of the text does not know
at which start the chain enters it, but there are few possibilities: fewer than a window is long. Each segment's task walks from
all of them (chains that meet are walked on once) and keeps, for each entry, where the chain leaves and how many windows it
made. These maps of a text are composed in order, which gives every segment its true entry and first window number, and the
segments then emit their windows side by side.

A text is read by one task, as it is one value, but only sliced there. Segments carry one window of the text behind them. Texts
shorter than ``long_chars`` take the serial way, which has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.operators.corpus import chunk_windows
from carelake.plans import clinical as cfg
from carelake.session import materialize

LONG_CHARS, SEGMENT_CHARS = 4 << 20, 1 << 20


def _step(text: str, at: int, end_of_text: int, size: int, overlap: int, separators: Sequence[str]) -> tuple[int, int] | None:
    """End of the window that starts at ``at`` and the next start; None for the last window of the text."""
    end = at + size
    if end >= end_of_text:
        return None
    found = ((text.rfind(sep, at, end), len(sep)) for sep in separators)
    end = next((where + width for where, width in found if where > at + size // 2), end)
    return end, max(at + 1, end - overlap)


def segment_map(text: str, length: int, end_of_text: int, entries: int, size: int, overlap: int, separators: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a segment: the start behind it, counted from its end (-1 if the text ends first), and its windows.

    ``text`` is the segment of ``length`` and a window more; the text ends at ``end_of_text``, counted from the segment's start.
    """
    known: dict[int, tuple[int, int]] = {}
    for entry in range(entries):
        path, at = [], entry
        while at < length and at not in known:
            path.append(at)
            step = _step(text, at, end_of_text, size, overlap, separators)
            if step is None:
                known[at] = (-1, 1 if at < end_of_text else 0)
                path.pop()
                break
            at = step[1]
        leaves, count = known[at] if at < length else (at - length, 0)
        for i, start in enumerate(reversed(path), 1):
            known[start] = (leaves, count + i)
    found = [known[e] if e < length else (e - length, 0) for e in range(entries)]
    return np.array([f for f, _ in found], np.int32), np.array([c for _, c in found], np.int32)


def _segments(text: str, segment: int, size: int, end: int) -> Iterator[tuple[int, str]]:
    for i in range(0, max(end, 1), segment):
        yield i // segment, text[i : i + segment + size]


def long_windows(
    docs: DataFrame, keep: Sequence[str], text: str = "text", size: int = cfg.CHUNK_SIZE, overlap: int = cfg.CHUNK_OVERLAP,
    tail: bool = False, segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """``chunk_windows`` of texts of at least one window, by segments. ``segment_chars`` is at least a window."""
    if segment_chars < size or not 0 <= overlap < size:
        raise ValueError("a segment holds at least a window, and windows overlap by less than their size")
    separators = list(cfg.CHUNK_SEPARATORS)
    entries = size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            kept = [i for i, c in enumerate(batch.schema.names) if c != text]
            for row, value in enumerate(batch.column(place)):
                t = value.as_py() or ""
                if len(t) < size:
                    continue
                for i, part in _segments(t, segment_chars, size, len(t)):
                    columns = [batch.column(c).slice(row, 1) for c in kept]
                    more = [pa.array([i], pa.int32()), pa.array([len(t)], pa.int64()), pa.array([part])]
                    yield pa.RecordBatch.from_arrays([*columns, *more], names=[*(batch.schema.names[c] for c in kept), "_segment", "_chars", "_part"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    numbered = docs.select(*keep, text).withColumn("_row", F.monotonically_increasing_id())
    parts = materialize(numbered.mapInArrow(cut, f"{own}, _row long, _segment int, _chars long, _part string").repartition("_row", "_segment"), "segments")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, i, n, part in zip(*(batch.column(c).to_pylist() for c in ("_row", "_segment", "_chars", "_part")), strict=True):
                left = n - i * segment_chars
                to, count = segment_map(part, min(segment_chars, left), left, entries if i else 1, size, overlap, separators)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row]), pa.array([i], pa.int32()), pa.array([to.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], names=["_row", "_segment", "to", "windows"]
                )

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for row, own in groupby(rows, key=lambda r: r[0]):
            entry, first, out = 0, 0, []
            for _, i, to, windows in own:
                out.append((row, i, entry, first))
                if entry >= 0:
                    first += int(np.frombuffer(windows, np.int32)[entry])
                    entry = int(np.frombuffer(to, np.int32)[entry])
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_segment", "_entry", "_first"])

    found = parts.select("_row", "_segment", "_chars", "_part").mapInArrow(maps, "_row long, _segment int, to binary, windows binary")
    found = found.repartition("_row").sortWithinPartitions("_row", "_segment")
    entered = materialize(found.mapInArrow(compose, "_row long, _segment int, _entry int, _first int").where("_entry >= 0"), "entries")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select([c for c in keep])
            for row, (i, n, part, at, window) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_segment", "_chars", "_part", "_entry", "_first")), strict=True)):
                base, spans = i * segment_chars, []
                left, length = n - base, min(segment_chars, n - base)
                while at < length:
                    step = _step(part, at, left, size, overlap, separators)
                    if step is None:
                        spans.append((at, left))
                        if tail:
                            spans += [(s, left) for s in range(max(at + 1, left - overlap), left)]
                        break
                    spans.append((at, step[0]))
                    at = step[1]
                if spans:
                    columns = [kept.column(c).take(pa.array([row] * len(spans))) for c in range(kept.num_columns)]
                    columns += [pa.array(range(window, window + len(spans)), pa.int32()), pa.array([base + a for a, _ in spans], pa.int32()), pa.array([base + b for _, b in spans], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([part[a:b] for a, b in spans])], names=[*keep, "window_id", "start", "end", "text"])

    return parts.join(entered, ["_row", "_segment"]).mapInArrow(emit, f"{own}, window_id int, start int, end int, text string")


def all_windows(
    docs: DataFrame, keep: Sequence[str], text: str = "text", size: int = cfg.CHUNK_SIZE, overlap: int = cfg.CHUNK_OVERLAP,
    tail: bool = False, long_chars: int = LONG_CHARS, segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """``chunk_windows`` of all texts, the long ones by segments."""
    long = F.length(text) >= max(long_chars, size)
    short = chunk_windows(docs.where(~F.coalesce(long, F.lit(False))), keep, text, size, overlap, tail)
    return short.unionByName(long_windows(docs.where(long), keep, text, size, overlap, tail, segment_chars))
