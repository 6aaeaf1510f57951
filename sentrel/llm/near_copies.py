"""Near copies by SimHash (operator 9), verified by the exact Jaccard similarity of word shingles; min-hash bands for what SimHash can't reach.

Texts are sets of runs of ``WIDTH`` words. Two different sets are linked if their similarity is at least ``LIKE``. Equal sets are one item
from the start. Candidates come from operator 9's steps first: a fingerprint of the runs, links between fingerprints of at most two differing bits
by deletion variants. Two sets of similarity 0.8 differ by about ten of 64 bits, often by more, and no index by
deletion variants reaches so far (nine segments of seven bits with one wildcard would pair each text with one in 64 of all). So further candidates
share a band, ``DEPTH`` min-hashes out of ``BANDS`` times as many: a pair of similarity 0.8 shares none with a
probability of (1 - 0.8^4)^24 = 3e-6, a more similar pair with a smaller one.

Every candidate is verified, or its texts are already connected through others: first the SimHash links and each member of a band with the band's
first one, so that a large group gives no square of pairs. In bands that then hold several components, a similar pair is found by its rarest
runs: of n runs at least LIKE * n are in a similar set, so among the n - LIKE * n + 1 that are in the fewest sets there is one that both have there. Pairs
that share one of these, have sizes and places that allow the similarity and are not connected yet, are verified; no similar pair is lost, and
members of a crowd whose own runs are a fifth of all pair with nobody. Components are found over all links.

Defined cases: as in ``simhash``; a text with fewer words is one shingle, and texts without words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sentrel.llm import simhash
from sentrel.llm.common import Scratch, batches, free
from sentrel.llm.simhash import components, first_of_each, shingle_hashes

WIDTH, LIKE = 5, 0.8
BANDS, DEPTH = 24, 4
#: Shingles that are min-hashed at once.
CHUNK = 2048
_drawn = np.random.default_rng(42)
_FACTOR = _drawn.integers(0, 1 << 63, BANDS * DEPTH, np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFT = _drawn.integers(0, 1 << 63, BANDS * DEPTH, np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of the text's shingle hashes."""
    return np.unique(shingle_hashes(text, width).astype(np.uint64))


def _digest(x: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(x.tobytes(), 7)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        with np.errstate(over="ignore"):
            x = hashes[i : i + CHUNK, None] * _FACTOR + _SHIFT
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(0))
    keys = [_digest(np.append(least[k * DEPTH : (k + 1) * DEPTH], np.uint64(k))) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def marked(docs: DataFrame, keep: list[str], keys: bool, width: int = WIDTH, name: str = "fp") -> DataFrame:
    """The columns ``keep`` of each row, ``name`` (a digest of its shingles) and, if wanted, ``bands`` and ``sim`` (its SimHash fingerprint)."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(free(docs, "_text")))
    more = [StructField(name, LongType()), *([StructField("bands", ArrayType(LongType())), StructField("sim", LongType())] if keys else [])]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            digests, made, sims = [], [], []
            for t in b.column(len(keep)):
                hashes = shingles(t.as_py(), width)
                digests.append(_digest(hashes))
                if keys:
                    made.append(bands(hashes))
                    sims.append(simhash.fingerprint(hashes.astype(">u8")))
            fp = pa.array(np.array(digests, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], fp, *([pa.array(made, pa.list_(pa.int64())), pa.array(sims, pa.int64())] if keys else [])], [*keep, *[f.name for f in more]])

    return source.mapInArrow(run, StructType([*docs.select(*keep).schema.fields, *more]))


def _alike(width: int, like: float):
    """Of rows (a, b, text of a, text of b), those pairs that are similar."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, np.zeros(0, np.uint64)
        for batch in batches(it):
            kept = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if a != last:
                    last, one = a, shingles(batch.column(2)[i].as_py(), width)
                two = shingles(batch.column(3)[i].as_py(), width)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both and both >= like * (len(one) + len(two) - both):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """The pairs (a, b) that are similar; ``texts`` has one text for each fp."""
    side = lambda c: texts.select(F.col("fp").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(_alike(width, like), "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(fp, text): for each of the wanted (fp, first) the text of a row with that id and digest."""
    near = docs.select("doc_id", "text").join(wanted.select("first").distinct(), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    found = marked(near, ["doc_id", "text"], False, width).join(wanted.withColumnRenamed("fp", "_fp"), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("fp") == F.col("_fp")), "left_semi")
    return found.select("fp", "text").dropDuplicates(["fp"])


def simhash_pairs(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidates (a, b) by operator 9: digests whose fingerprints ``sim`` differ by at most two bits; of equal ones the first stands for all."""
    first = scratch.save(distinct.groupBy("sim").agg(F.min("fp").alias("head")), "fingerprints")
    same = distinct.join(first, "sim").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    near = simhash.links(first.select(F.col("sim").alias("fp")), scratch)
    side = lambda c: first.select(F.col("sim").alias(c), F.col("head").alias(f"h{c}"))
    near = near.join(side("a"), "a").join(side("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    both = same.unionByName(near).where("a <> b")
    return scratch.save(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash")


def _rarest(crowd: DataFrame, texts: DataFrame, width: int, like: float) -> DataFrame:
    """(x, fp, n, at, root, small) of ``crowd`` (fp, root, small): of each set's n shingles those that a similar set can't all miss, rarest first; without those that no other set has."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for fp, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = shingles(t.as_py(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), fp, np.int64)), pa.array(np.full(len(x), len(x), np.int64)), pa.array(x)], ["fp", "n", "x"])

    cut = texts.join(crowd.select("fp"), "fp", "left_semi").select("fp", "text").mapInArrow(run, "fp long, n long, x long")
    known = cut.groupBy("x").agg(F.count(F.lit(1)).alias("sets"))
    order = Window.partitionBy("fp").orderBy("sets", "x")
    placed = cut.join(known, "x").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * like - 1e-9) + 1)
    return placed.where("sets > 1").select("x", "fp", "n", "at").join(crowd, "fp")


def links(docs: DataFrame, distinct: DataFrame, scratch: Scratch, width: int = WIDTH, like: float = LIKE, candidates: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect all similar pairs among the sets in (fp, first, bands): digest, an id that has it, min-hash keys; and those of the ``candidates``."""
    keyed = distinct.select(F.explode("bands").alias("key"), "fp")
    order = F.struct(F.xxhash64("fp").alias("h"), F.col("fp").alias("fp"))
    first = keyed.groupBy("key").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("x.fp").alias("head"))
    member = scratch.save(keyed.join(first, "key").select("key", "fp", "head"), "members")
    stars = member.where("fp <> head").select(F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b"))
    named = member.select("fp")
    if candidates is not None:
        stars = stars.unionByName(candidates)
        named = named.union(candidates.select("a")).union(candidates.select("b"))
    stars = scratch.save(stars.distinct(), "stars")
    wanted = distinct.select("fp", "first").join(named.distinct(), "fp", "left_semi")
    texts = scratch.save(_texts(docs, wanted, width), "texts")
    near = scratch.save(verified(stars, texts, width, like), "near")
    roots = components(near, scratch)
    rooted = member.join(roots, member.fp == roots.node, "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    size = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    most = size.groupBy("key").agg(F.max(F.struct("n", "root")).alias("x"), F.count(F.lit(1)).alias("r")).where("r > 1").select("key", F.col("x.root").alias("most"))
    crowd = scratch.save(rooted.join(most, "key").groupBy("fp", "root").agg(F.max(F.col("root") != F.col("most")).alias("small")), "crowd")
    rare = scratch.save(_rarest(crowd, texts, width, like), "rarest")
    one = rare.where("small").select("x", F.col("fp").alias("s"), F.col("n").alias("m"), F.col("at").alias("by"), F.col("root").alias("own"))
    # Two sets of m and n shingles have like / (1 + like) of m + n in common, and what is common begins with the first shared one.
    fits = 1 + F.least(F.col("n") - F.col("at"), F.col("m") - F.col("by")) >= (F.col("m") + F.col("n")) * (like / (1 + like)) - 1e-9
    pairs = one.join(rare, "x").where((F.col("own") != F.col("root")) & fits).select(F.least("s", "fp").alias("a"), F.greatest("s", "fp").alias("b")).distinct()
    more = scratch.save(verified(pairs.join(stars, ["a", "b"], "left_anti"), texts, width, like), "more")
    return near.unionByName(more)


def one_of_each(docs: DataFrame, width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id (null last; of equal ones that with the smallest digest, then text hash)."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    known = scratch.save(marked(docs, ["doc_id"], True, width), "marked")
    # Bands and fingerprint follow from the digest, so any row's will do.
    distinct = scratch.save(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.any_value("bands").alias("bands"), F.any_value("sim").alias("sim")), "distinct")
    roots = components(links(docs, distinct, scratch, width, like, simhash_pairs(distinct, scratch)), scratch)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), "fp")
    stay = named.groupBy("root").agg(F.min(least).alias("x")).select("x.id", "x.fp")
    name = free(docs, "fp")
    return first_of_each(marked(docs, docs.columns, False, width, name), name, stay).select(*docs.columns)
