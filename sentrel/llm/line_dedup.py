"""Removal of repeated line runs, by equality ranks from distributed prefix doubling (no suffix order, no LCP array).

A line's id is a hash of its text; a document is the sequence of its lines' ids. Suffixes are ranked by prefix doubling: the rank of
2^(k+1) lines from a position is named by the ranks of its two halves, which a join on the position brings together. Ranks
need only tell equal from different, and a position whose rank is unique has no repeated run of that length, so it leaves; the table
shrinks from step to step. Positions that agree in a run of ``MIN_WORDS`` words or more form a longest-common-prefix
interval of at least that depth: for each position the shortest such run that begins (and that ends) there is looked up, as
two overlapping ranks; of the positions with equal runs the first in document order stays, later copies are deleted. The union of these
runs is the union of the maximal repeated runs of ``MIN_WORDS`` words or more.

Defined cases: a null text has no lines and stays null; documents are ordered by id (null first), then a hash of the text; rows equal
in id and text are one document and get one result; a run may repeat within a document; runs of fewer words stay,
however often they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.llm.common import Scratch, batches, free

#: Words that a run must have to be removed.
MIN_WORDS = 50

_LINES = "doc_id long, h long, pos array<int>, id array<long>, ahead array<int>, back array<int>"


def line_ids(text: str) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(x) for x in text.encode().split(b"\n")], np.uint64).view(np.int64)


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line: how many lines from it on, and how many up to it, have ``least`` words (0: there are not so many)."""
    sums, n = np.concatenate([[0], np.cumsum(words)]), len(words)
    stop = np.searchsorted(sums, sums[:-1] + least)
    ahead = np.where(stop <= n, stop - np.arange(n), 0)
    start = np.searchsorted(sums, sums[1:] - least, "right") - 1
    back = np.where(start >= 0, np.arange(1, n + 1) - start, 0)
    return ahead.astype(np.int32), back.astype(np.int32)


def _read(least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            cols: list[list] = [[], [], [], []]
            for t in b.column(2):
                text = t.as_py()
                ids = line_ids(text)
                ahead, back = shortest_runs(np.array([len(x.split()) for x in text.encode().split(b"\n")], np.int64), least)
                for c, v in zip(cols, (np.arange(len(ids), dtype=np.int32), ids, ahead, back), strict=True):
                    c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32())
            made = [pa.array(c, pa.list_(k)) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "h", "pos", "id", "ahead", "back"])

    return run


def copied_runs(docs: DataFrame, least: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, h, runs): the runs of lines (array of start, size) to delete from the document with this id and text hash."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    named = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    read = named.mapInArrow(_read(least), _LINES)
    lines = read.select("doc_id", "h", F.explode(F.arrays_zip("pos", "id", "ahead", "back")).alias("x")).select("doc_id", "h", "x.*")
    lines = scratch.save(lines, "lines")
    # Rank 0: lines that occur more than once (in different places).
    key = ["doc_id", "h", "pos"]
    once = lines.groupBy(*key).agg(F.min("id").alias("c"), F.min("ahead").alias("ahead"), F.min("back").alias("back"))

    def repeated(ranked: DataFrame) -> DataFrame:
        """Without the positions whose rank is unique."""
        many = ranked.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
        return ranked.join(many, "c", "left_semi")

    base = scratch.save(repeated(once), "base")
    # The runs to look up; all their lines must be repeated, which the ranks say.
    runs = base.where("ahead > 0").select("doc_id", "h", "pos", F.col("ahead").alias("size")).union(base.where("back > 0").select("doc_id", "h", (F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("size"))).distinct()
    runs = scratch.save(runs, "runs")
    longest = runs.agg(F.max("size")).first()[0] or 0
    rank, step, found = base.select(*key, "c"), 0, []
    while 2**step <= longest:
        mine = runs.where(f"size >= {2**step} AND size < {2 ** (step + 1)}").withColumn("end", F.expr(f"pos + size - {2**step}"))
        placed = mine.alias("a").join(rank.alias("b"), _at("pos")).select("a.*", "b.c")
        found.append(placed.alias("a").join(rank.alias("b"), _at("end")).select("a.doc_id", "a.h", "a.pos", "a.size", F.xxhash64("a.size", "a.c", "b.c").alias("name")))
        if 2 ** (step + 1) > longest:
            break
        shifted = rank.withColumn("end", F.col("pos") + 2**step)
        doubled = shifted.alias("a").join(rank.alias("b"), _at("end")).select("a.doc_id", "a.h", "a.pos", F.xxhash64("a.c", "b.c").alias("c"))
        rank, step = scratch.save(repeated(doubled), f"rank-{step + 1}"), step + 1
    if not found:
        return lines.limit(0).select("doc_id", "h", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"))).alias("runs"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = scratch.save(every, "named")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h", "pos")
    first = every.groupBy("name").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "first")
    later = every.join(first, "name").where(place != F.col("first"))
    return later.groupBy("doc_id", "h").agg(F.collect_list(F.struct(F.col("pos").alias("start"), "size")).alias("runs"))


def _at(place: str):
    return F.expr(f"a.doc_id <=> b.doc_id AND a.h = b.h AND a.{place} = b.pos")


def remove_repeats(docs: DataFrame, least: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the later copies of repeated runs, and n_lines, n_removed; columns of ``docs`` with those names are replaced."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    names, own = docs.columns, free(docs, "_runs")
    runs = copied_runs(docs, least, doc_id, text).select("doc_id", "h", F.col("runs").alias(own))
    joined = docs.join(runs, docs[doc_id].eqNullSafe(runs["doc_id"]) & (F.xxhash64(docs[text]) == runs["h"]), "left")
    joined = joined.select(*[docs[f"`{c}`"] for c in names], own, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            k, texts, lines, removed = names.index(text), [], [], []
            for t, r in zip(b.column(k).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if t is None:
                    n = gone = 0
                elif not r:
                    n, gone = t.count("\n") + 1, 0
                else:
                    parts = t.split("\n")
                    n, keep = len(parts), np.ones(len(parts), bool)
                    for x in r:
                        keep[x["start"] : x["start"] + x["size"]] = False
                    t, gone = "\n".join([p for p, ok in zip(parts, keep, strict=True) if ok]), int(n - keep.sum())
                texts.append(t)
                lines.append(n)
                removed.append(gone)
            cols = [*b.columns[: len(names)], pa.array(lines, pa.int64()), pa.array(removed, pa.int64())]
            cols[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_lines", "n_removed"])

    return joined.mapInArrow(cut, joined.drop(own).schema)
