"""SimHash fingerprints and near-duplicate components by deletion-variant signatures.

A fingerprint has one bit for each bit of the shingles' hashes: 1 if it is set in over half of them. A fingerprint of 64
bits is cut into two segments, so that of two fingerprints with at most two differing bits one segment differs by at most one.
Each segment is indexed under its 32 variants with one bit wildcarded; the variants are joined by equality (one
exchange; the rows of a variant stand together after a sort) and the pairs are verified. Equal fingerprints are one item
from the start, so copies never form pairs. A variant with more than ``CROWD`` fingerprints is not paired: its members go on to
a finer index, under all variants with two of the 64 bits wildcarded, which no more than four different fingerprints can
share. So no link is lost and no list grows with the square of a group. Components are then found over
fingerprints by large-star and small-star steps.

Defined cases: a null text has no words; a text without words has fingerprint zero, linked like any other; null ids are
never a component's name unless it has no other; repeated rows keep one row each; other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sentrel.llm.common import Scratch, batches, free

#: Variants with more fingerprints than this are resolved by the finer index.
CROWD = 512
SEED = 42
DISTANCE = 2


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words of the text, A-Z lower-cased; of all words if there are fewer; none if there are none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, ">u8")
    if len(words) < width:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.array([xxh64_intdigest(s, SEED) for s in runs], ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit the strict majority of the hashes, as a signed 64-bit integer; zero if there are none."""
    if not len(hashes):
        return 0
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, keep: list[str] | None = None, text: str = "text", name: str = "fp") -> DataFrame:
    """The columns ``keep`` of each row (all of them, if None) and its fingerprint ``name``, a signed 64-bit integer."""
    keep = docs.columns if keep is None else keep
    kept = docs.select(*keep)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(free(docs, "_text")))
    schema = StructType([*kept.schema.fields, StructField(name, LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            made = pa.array([fingerprint(shingle_hashes(t.as_py(), width)) for t in b.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], made], [*keep, name])

    return source.mapInArrow(run, schema)


_PAIR = "key long, fp long"
_LINK = "a long, b long"


def _variants(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its 64 variants: one of two segments, one of its 32 bits wildcarded."""
    for batch in it:
        for b in batches([batch], 1 << 17):
            fp = b.column(0).to_numpy().astype(np.int64)
            for seg in (0, 1):
                part = ((fp.view(np.uint64) >> np.uint64(32 * seg)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                bit = np.arange(32, dtype=np.int64)
                key = (part[:, None] & ~(1 << bit)[None, :]) | (bit << 32)[None, :] | (seg << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fp, 32))], ["key", "fp"])


def _fine_variants(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its 2016 variants with two of the 64 bits wildcarded; ``pair`` says which two."""
    first, second = np.triu_indices(64, 1)
    masks = (np.uint64(1) << first.astype(np.uint64)) | (np.uint64(1) << second.astype(np.uint64))
    for batch in it:
        for b in batches([batch], 1 << 12):
            fp = b.column(0).to_numpy().astype(np.int64)
            key = fp.view(np.uint64)[:, None] & ~masks[None, :]
            pair = np.broadcast_to(np.arange(len(masks), dtype=np.int16), key.shape)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(pair.ravel()), pa.array(np.repeat(fp, len(masks)))], ["key", "pair", "fp"])


def _linked(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows with one key, among sorted keys, whose fingerprints differ by at most ``distance`` bits."""
    left, right, lag = [], [], 1
    alive = np.arange(len(key))
    while True:
        alive = alive[alive + lag < len(key)]
        alive = alive[key[alive] == key[alive + lag]]
        if not len(alive):
            break
        near = alive[np.bitwise_count(fp[alive].view(np.uint64) ^ fp[alive + lag].view(np.uint64)) <= distance]
        left.append(fp[near])
        right.append(fp[near + lag])
        lag += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def _pairs_of(crowd: int, distance: int):
    """Reads rows sorted by key. Emits the verified links (a < b), and (fp, fp) for the members of crowded variants."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            both = np.unique(np.stack([a, b], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key):
                _, start, size = np.unique(key, return_index=True, return_counts=True)
                many = np.repeat(size > crowd, size)
                if many.any():
                    yield out(fp[many], fp[many])
                a, b = _linked(key[~many], fp[~many], distance)
                if len(a):
                    yield out(a, b)

        for batch in it:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if hot is not None:
                same = k == hot
                if same.any():
                    yield out(f[same], f[same])
                k, f = k[~same], f[~same]
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            yield from settle(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
            if len(key) > crowd:  # the last variant may go on for many batches
                hot = key[-1]
                yield out(fp, fp)
                key, fp = key[:0], fp[:0]
        yield from settle(key, fp)

    return run


def links(distinct: DataFrame, scratch: Scratch, crowd: int = CROWD, distance: int = DISTANCE) -> DataFrame:
    """All pairs a < b of the distinct fingerprints in column ``fp`` that differ by at most ``distance`` (2 at most) bits."""
    if distance > 2:
        raise ValueError("two segments with one wildcard find pairs of at most two differing bits")
    keyed = distinct.select("fp").mapInArrow(_variants, _PAIR).repartition("key").sortWithinPartitions("key")
    found = scratch.save(keyed.mapInArrow(_pairs_of(crowd, distance), _LINK), "found")
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    fine = crowded.mapInArrow(_fine_variants, "key long, pair short, fp long")
    group = fine.groupBy("key", "pair").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # four at most
    near = group.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a < b")
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return found.where("a < b").unionByName(near.where(within)).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the links (a, b); root is the smallest node that it is connected with.

    Large-star and small-star steps alternate until nothing changes; each result is a written table.
    """
    edge = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges-0")
    state, step = None, 0
    while True:
        seen = edge.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state, step = seen, step + 1
        both = edge.union(edge.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct()
        edge = scratch.save(small, f"edges-{step}")
        scratch.drop(f"large-{step}")
        scratch.drop(f"edges-{step - 1}")
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edge.select("v", "v").distinct())


def _grouped(docs: DataFrame, scratch: Scratch, width: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, written; and (fp, first, root): the least id of each fingerprint, its component's name."""
    marked = scratch.save(fingerprints(docs, width, ["doc_id"]), "marked")
    distinct = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, scratch, distance=distance), scratch)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return marked, scratch.save(named, "named")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", width: int = 3, distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed 64 bits), component_id (the smallest doc_id that can be reached by links)."""
    marked, named = _grouped(docs.select(F.col(doc_id).alias("doc_id"), "text"), Scratch(docs.sparkSession, "simhash"), width, distance)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id (null last; of equal ones that with the smallest fingerprint, then text hash)."""
    _, named = _grouped(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "simhash"), width, distance)
    first = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), "fp")
    stay = named.groupBy("root").agg(F.min(first).alias("x")).select("x.id", "x.fp")
    name = free(docs, "fp")
    return first_of_each(fingerprints(docs, width, name=name), name, stay).select(*docs.columns)


def first_of_each(marked: DataFrame, name: str, stay: DataFrame) -> DataFrame:
    """The rows of ``marked`` whose doc_id and digest (column ``name``) are among the (id, fp) of ``stay``; of equal ones that with the least text hash."""
    found = marked.join(stay, marked["doc_id"].eqNullSafe(stay["id"]) & (marked[name] == stay["fp"]), "left_semi")
    own = Window.partitionBy(name, "doc_id").orderBy(F.xxhash64("text"))
    k = free(found, "_k")
    return found.withColumn(k, F.row_number().over(own)).where(f"`{k}` = 1")


def hex_fingerprint(column: str = "fp"):
    """16 lowercase hex digits of the unsigned fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
