"""Mixing sources to target weights with pivotal dependent rounding, in DataFrame operations only.

A document's copies are its source's target divided by the source's size. The whole part is certain. The fractions are
rounded pairwise: words move between two documents, up or down at random with fair odds, until one of the two is integral.
So every expected share stays as it was and a source's words stay what they were, but for one last document.

Pairs are formed along small blocks of a source, largest documents first. Each block leaves one residual document, and the
residuals meet in blocks again, a tree that is as deep as the logarithm of the largest source. Random numbers are hashes
of the seed, the level and the two documents, so that reruns agree.

Defined results: a null text has size 0 and is taken 0 times over; sources are ordered by code point, null last; rows that
repeat an id, source and size are rounded together and get equal copies; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.session import materialize

MOST = 3
BLOCK = 48
_WORD = r"[^\x20\x09-\x0D]+"


def with_size(docs: DataFrame, name: str) -> DataFrame:
    """The number of words between white space."""
    return docs.withColumn(name, F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"))


def cycling_weights(sizes: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating over the sources by code point, null last.

    Sources are dealt out by range and numbered within their range, so their number may be large.
    """
    order = F.col("source").asc_nulls_last()
    ranged = materialize(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}  # one row for each partition
    before, base = 0, {}
    for part in sorted(counts):
        base[part], before = before, before + counts[part]
    offset = F.coalesce(*[F.when(F.col("part") == p, F.lit(n)) for p, n in base.items()], F.lit(0))
    number = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + offset
    return ranged.withColumn("weight", (number % 3 + 1).cast("double")).drop("part")


def capped_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``target``: shares of all words by weight, none above ``most`` times its source, excess shared out again.

    Every round is one sum over the sources; rounds end when no further source reaches its cap.
    """
    cap = F.col("source_size") * float(most)
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * level
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, cap).otherwise(0.0)).alias("kept"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w"), F.sum(full.cast("int")).alias("n"),
        ).first()
        if not row["all"] or not row["w"] or row["n"] == capped:
            break
        level, capped = (row["all"] - row["kept"]) / row["w"], row["n"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level or 0.0))))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _pairs(level: int, seed: int):
    """Merges the next document of a block into (open document, decided documents)."""

    def merge(acc: Column, x: Column) -> Column:
        c = acc.getField("open")
        rise, fall = (1 - c["p"]) * c["w"], c["p"] * c["w"]
        rise_x, fall_x = (1 - x["p"]) * x["w"], x["p"] * x["w"]
        up, down = F.least(rise, fall_x), F.least(fall, rise_x)
        u = _uniform(F.lit(seed), F.lit(level), c["doc_id"], x["doc_id"], c["size"], x["size"])
        to_open = u * (up + down) < down
        open_done = F.when(to_open, rise <= fall_x).otherwise(fall <= rise_x)
        moved = F.when(to_open, up).otherwise(down)
        raised = to_open == open_done  # the decided document gets its extra copy
        return F.struct(
            F.when(open_done, _moved(x, moved, raised)).otherwise(_moved(c, moved, raised)).alias("open"),
            F.concat(acc.getField("done"), F.array(F.when(open_done, _decided(c, raised)).otherwise(_decided(x, raised)))).alias("done"),
        )

    return merge


def _moved(d: Column, words: Column, down: Column) -> Column:
    p = d["p"] + F.when(down, -words).otherwise(words) / d["w"]
    return F.struct(d["w"].alias("w"), d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["n"].alias("n"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))


def _decided(d: Column, raised: Column) -> Column:
    return F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["n"].alias("n"), raised.cast("long").alias("extra"))


def _level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """(source, blocks, open, done) for each block of the rows (source, blocks, w, doc_id, size, n, p)."""
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), F.col("blocks"))
    grouped = rows.groupBy("source", "blocks", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("w", "doc_id", "size", "n", "p")), asc=False).alias("a"))
    kind = f"array<struct<doc_id:{rows.schema['doc_id'].dataType.simpleString()},size:bigint,n:bigint,extra:bigint>>"
    start = F.struct(F.element_at("a", 1).alias("open"), F.array().cast(kind).alias("done"))
    done = F.aggregate(F.expr("slice(a, 2, size(a))"), start, _pairs(level, seed))
    return grouped.select("source", "blocks", done.alias("r")).select("source", "blocks", "r.open", "r.done")


def mix_units(docs: DataFrame, weights=cycling_weights, most: int = MOST, seed: int = 7) -> DataFrame:
    """(source, doc_id, size, n, source_size, target, copies), one row for all rows that repeat these.

    ``weights`` turns (source, source_size) into the same with a weight.
    """
    units = with_size(docs.select("doc_id", "source", "text"), "size").groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    units = materialize(units, "mix-units")
    words = F.col("size") * F.col("n")
    sizes = units.groupBy("source").agg(F.sum(words).alias("source_size"), F.count("*").alias("units"))
    sources = materialize(capped_targets(weights(sizes), most), "mix-targets")
    s = sources.select(F.col("source").alias("of"), "source_size", "target", "units")
    rows = units.join(s, units["source"].eqNullSafe(s["of"])).drop("of")
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = rows.withColumns({"whole": F.floor(share).cast("long"), "p": share - F.floor(share)})
    rows = materialize(rows, "mix-shares")
    to_round = (F.col("size") > 0) & (F.col("p") > 0)
    blocks = F.ceil(F.col("units") / BLOCK).cast("long")
    level, open_ = 0, rows.where(to_round).select("source", blocks.alias("blocks"), words.cast("double").alias("w"), "doc_id", "size", "n", "p")
    largest = sources.agg(F.max(blocks)).first()[0] or 1
    decided = []
    while True:
        out = materialize(_level(open_, level, seed), "mix-level")
        decided.append(out.select("source", F.explode("done").alias("d")).select("source", "d.doc_id", "d.size", "d.extra"))
        open_ = out.select("source", F.ceil(F.col("blocks") / BLOCK).cast("long").alias("blocks"), "open.*").select("source", "blocks", "w", "doc_id", "size", "n", "p")
        if largest == 1:
            break
        largest, level = -(-largest // BLOCK), level + 1
    last = (_uniform(F.lit(seed), F.lit(-1), "doc_id", "size") < F.col("p")).cast("long")
    extra = open_.select("source", "doc_id", "size", last.alias("extra"))
    for d in decided:
        extra = extra.unionAll(d)
    e = extra.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), "extra")
    # the key is (id, size): sources may hold a third of all rows, ids do not
    on = rows["doc_id"].eqNullSafe(e["d"]) & (rows["size"] == e["z"]) & rows["source"].eqNullSafe(e["s"])
    return rows.join(e, on, "left").select(
        rows["source"], "doc_id", "size", "n", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies")
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source."""
    units = mix_units(docs, **options).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return units.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken; documents without words stay once."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    u = mix_units(docs, **options).select(F.col("source").alias("__mix_s"), F.col("doc_id").alias("__mix_d"), F.col("size").alias("__mix_z"), F.col("copies").alias("__mix_c"))
    sized = with_size(docs, "__mix_size")
    on = sized["doc_id"].eqNullSafe(u["__mix_d"]) & (sized["__mix_size"] == u["__mix_z"]) & sized["source"].eqNullSafe(u["__mix_s"])
    times = F.when(F.col("__mix_size") == 0, F.lit(1).cast("long")).otherwise(F.col("__mix_c"))
    return sized.join(u, on).where(times > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*own)
