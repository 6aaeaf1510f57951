"""A hierarchical Pitman-Yor bigram model, trained and applied over the whole corpus.

Tokens are words (A-Z lower-cased, cut at ASCII white space), then one end per text. Every previous token has a restaurant of its own
(a text's first token follows the end): customers are the tokens that follow, dishes are words, and each table is a
customer of the parent that all restaurants share. The parent's own base measure is diffuse, so a known word has one table there and the
mass of further tables is that of an unknown word.

The ``HOT`` most frequent tokens have numbers; the others are known by their hash. After a hot token all words are dishes. After a rare
token the dishes are the hot words and one dish for "a rare word"; which rare word it is, is then said by one restaurant that
rare tokens share, whose parent is the parent's distribution over rare words. So probabilities sum to one, no context is left
out, and no cell needs the totals of a rare token and of a rare word at once.

Seating is sampled by Gibbs: in each sweep the tables of each cell (context, word) are drawn given all other cells' tables,
p(t) ~ A^t S_d(c, t). Up to ``EXACT`` customers the draw is exact, by generalised Stirling numbers; from there on ``PATHS`` seatings go on
forward (in blocks of a sixteenth of those seated, each a binomial draw) and one is chosen by its importance weight, which makes
up for drawing forward (mean within 3 % of the exact law in a test). Totals of hot tokens are those of the sweep before, so tasks are independent
within a sweep; totals of rare ones are local. Draws are seeded by (shard, sweep), so a task that runs again draws the same, and
later passes draw earlier sweeps again instead of storing tables. Predictive probabilities are averaged over the sweeps after ``BURN``.

Cells are dealt over shards by their key: two hot tokens by the pair, else by the rare word, else by the rare context. A batch of
documents sends each shard one packed list of its occurrences; the shards are written once, and every pass reads them where they are. Hot
totals are summed by blocks of places. Scores go back to the batches in the same way.

Defined cases: a null text is empty (one end token); a null id's remainder is that of the empty string; rows equal in id and text get the
same result; without training rows all words are unknown; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from sentrel.llm.common import Scratch, batches

HOT = 65536
SWEEPS, BURN, EXACT, PATHS = 4, 1, 32, 4
STRENGTH = 1.0
#: Words that a task counts before it passes the counts on; tokens to a shard; places to a block of totals; bytes of text to a batch.
COUNTED, SHARD_TOKENS, BLOCK, BATCH = 200_000, 600_000, 1024, 1 << 22


def tokens(text: str | None) -> list[bytes]:
    """The words, then the end, which is the empty string as no word is."""
    return [*(text or "").encode().lower().split(), b""]


# Packed lists of integers


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length, the first unsigned 64-bit integers (as differences), byte plane by byte plane, compressed."""
    if not len(arrays[0]):
        return b""
    first = np.diff(arrays[0], prepend=arrays[0][:1] * 0)
    raw = b"".join(a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in (first, *arrays[1:]))
    return len(first).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """What was packed; ``kinds`` are the types of all arrays but the first."""
    types = [np.dtype("u8"), *(np.dtype(k) for k in kinds)]
    if not data:
        return [np.zeros(0, k) for k in types]
    n, out, at = int.from_bytes(data[:8], "little"), [], 0
    raw = np.frombuffer(pa.decompress(data[8:], n * sum(k.itemsize for k in types), "zstd"), np.uint8)
    for k in types:
        out.append(np.ascontiguousarray(raw[at : at + n * k.itemsize].reshape(k.itemsize, n).T).view(k).ravel())
        at += n * k.itemsize
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def spread(x: np.ndarray, parts: int) -> np.ndarray:
    """A shard for each key."""
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(parts)).astype(np.int32)


def starts(*columns: np.ndarray) -> np.ndarray:
    """For sorted rows: the number of the group of equal rows that each is in."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


# Seating


def stirling(discount: float, most: int) -> list[np.ndarray]:
    """Logarithms of the generalised Stirling numbers S_d(c, 1..c) for c up to ``most``."""
    rows, row = [np.zeros(0), np.zeros(1)], np.zeros(1)
    for c in range(1, most):
        stay = np.append(np.log(c - discount * np.arange(1, c + 1)) + row, -np.inf)
        row = np.logaddexp(stay, np.append(-np.inf, row))
        rows.append(row)
    return rows


def _chosen(log_p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each row, a column drawn with a probability in proportion to exp(log_p)."""
    p = np.cumsum(np.exp(log_p - log_p.max(1, keepdims=True)), axis=1)
    return (p < (rng.random(len(p)) * p[:, -1])[:, None]).sum(1)


def draw(count: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator, numbers: list[np.ndarray]) -> np.ndarray:
    """Tables of each cell of ``count`` customers, where a new table has ``weight``: p(t) ~ weight^t S_d(count, t)."""
    out = np.minimum(count, 1).astype(np.float64)
    for c in range(2, EXACT + 1):
        cells = np.flatnonzero(count == c)
        if len(cells):
            out[cells] = 1 + _chosen(np.log(weight[cells])[:, None] * np.arange(1, c + 1) + numbers[c], rng)
    cells = np.flatnonzero(count > EXACT)
    if len(cells):
        out[cells] = _seated(count[cells], weight[cells], discount, rng, numbers[EXACT])
    return out


def _ahead(at: np.ndarray, left: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """By how much one more table, among those of ``at`` customers less discounts, makes the steps of the ``left`` further customers smaller."""
    opens = weight * np.ones_like(at)
    for _ in range(3):
        out = ((opens + at) / (opens + at + left)) ** discount
        opens = weight * out
    return out


def _seated(count: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator, numbers: np.ndarray) -> np.ndarray:
    """Many customers: ``PATHS`` seatings of the first ``EXACT`` go on forward, each step foreseeing later ones, and one is chosen by its weight:
    what the target has over what it was drawn with."""
    t, far = np.arange(1, EXACT + 1), (count - EXACT)[:, None]
    at = EXACT - discount * t[None, :] * np.ones((len(count), 1))
    foreseen = np.cumsum(np.log(_ahead(at, far, weight[:, None], discount)), axis=1)
    first = np.log(weight)[:, None] * t + numbers + foreseen
    tables = np.stack([1.0 + _chosen(first, rng) for _ in range(PATHS)])
    log_w = -np.take_along_axis(foreseen.T, tables.astype(np.int64) - 1, axis=0)
    seated, live = EXACT, np.arange(len(count))
    while len(live):
        step = max(1, seated // 16)
        size = np.minimum(count[live] - seated, step)
        at = seated + (size - 1) / 2 - discount * tables[:, live]
        ahead = _ahead(at, count[live] - seated, weight[live], discount)
        opens = weight[live] * ahead
        new = rng.binomial(size.astype(np.int64)[None, :], opens / (opens + at))
        tables[:, live] += new
        log_w[:, live] += size * np.log(opens + at) - new * np.log(ahead)
        seated += step
        live = live[count[live] > seated]
    return tables[_chosen(log_w.T, rng), np.arange(len(count))]


@dataclass
class Totals:
    """What a sweep leaves: tables of each hot context (the last place: of the shared restaurant) and of each hot word (the last place: of
    "a rare word"), and of the rare words: how many there are, their tables, and how many have one and two."""

    context: np.ndarray
    word: np.ndarray
    rare: np.ndarray

    def __post_init__(self) -> None:
        once, twice = self.rare[2] + (self.word[:-1] == 1).sum(), self.rare[3] + (self.word[:-1] == 2).sum()
        self.discount = _discount(once, twice)
        self.known = self.rare[0] + (self.word[:-1] > 0).sum()
        self.all = STRENGTH + float(self.word.sum() + self.rare[1])
        self.unseen = STRENGTH + self.discount * self.known
        self.of_rare = max(self.rare[1] - self.discount * self.rare[0], 0.0) + self.unseen
        #: The parent's probability of each hot word and, in the last place, of "a rare word" (known or not).
        self.parent = np.append(np.maximum(self.word[:-1] - self.discount, 0.0), self.of_rare + self.word[-1]) / self.all

    def which(self, tables: np.ndarray) -> np.ndarray:
        """The probability of rare words with so many tables, given that it is a rare word; without tables, of an unknown one."""
        return np.where(tables > 0, tables - self.discount, self.unseen) / self.of_rare


@dataclass
class Model:
    tokens: int
    words: int
    customers: np.ndarray  # of each hot context, then of the shared restaurant
    discount: float = 0.5  # of the context restaurants
    sweeps: list[Totals] = field(default_factory=list)  # the first: one table to each cell


@dataclass
class Cells:
    """A shard's cells: of pairs (key), of rare words (key, context) and of rare contexts (key, word); training customers of each."""

    pair: tuple[np.ndarray, np.ndarray, np.ndarray]  # context, word, customers
    word: tuple[np.ndarray, np.ndarray, np.ndarray]  # number of the rare word, context, customers
    context: tuple[np.ndarray, np.ndarray, np.ndarray]  # number of the rare context, word, customers

    def one_each(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.minimum(x[2], 1).astype(np.float64) for x in (self.pair, self.word, self.context))

    def seatings(self, model: Model, shard: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tables of the three kinds of cells after each of ``n`` sweeps."""
        numbers = stirling(model.discount, EXACT)
        tables = self.one_each()
        for sweep in range(n):
            before, rng = model.sweeps[sweep], np.random.default_rng([shard, sweep])
            opens = STRENGTH + model.discount * before.context
            u, w, c = self.pair
            pairs = draw(c, opens[u] * before.parent[w], model.discount, rng, numbers)
            word, u, c = self.word
            others = _sums(word, tables[1])[word] - tables[1]
            which = np.where(others > 0, others - before.discount, before.unseen / (before.known + 1)) / before.of_rare
            words = draw(c, opens[u] * which * np.where(u == HOT, 1.0, before.parent[-1]), model.discount, rng, numbers)
            context, w, c = self.context
            others = _sums(context, tables[2])[context] - tables[2]
            contexts = draw(c, (STRENGTH + model.discount * others) * before.parent[w], model.discount, rng, numbers)
            tables = pairs, words, contexts
            yield tables

    def totals(self, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Places: tables of hot contexts, of hot words, then of rare words (how many, tables, with one, with two), customers of the shared
        restaurant, cells with one and with two customers."""
        u, w, _ = self.pair
        word, code, c = self.word
        of_word = _sums(word, tables[1])
        counts = np.concatenate([self.pair[2], c, self.context[2]])
        rest = [(of_word > 0).sum(), of_word.sum(), (of_word == 1).sum(), (of_word == 2).sum(), c[code == HOT].sum(), (counts == 1).sum(), (counts == 2).sum()]
        size = HOT + 1
        return np.concatenate([np.bincount(u, tables[0], size) + np.bincount(code, tables[1], size), np.bincount(w, tables[0], size) + np.bincount(self.context[1], tables[2], size), rest])

    def predictions(self, model: Model, shard: int) -> list[np.ndarray]:
        """The averaged predictive probability of each cell, of the three kinds."""
        out, kept = [np.zeros(len(x[2])) for x in (self.pair, self.word, self.context)], 0
        customers = STRENGTH + model.customers
        word, code, c = self.word
        context = self.context[0]
        of_context = STRENGTH + _sums(context, self.context[2])
        for sweep, (pairs, words, contexts) in enumerate(self.seatings(model, shard, len(model.sweeps) - 1)):
            if sweep < BURN:
                continue
            now, d, kept = model.sweeps[sweep + 1], model.discount, kept + 1
            back = (STRENGTH + d * now.context) / customers
            u, w, n = self.pair
            out[0] += np.maximum(n - d * pairs, 0) / customers[u] + back[u] * now.parent[w]
            which = now.which(_sums(word, words))[word]
            out[1] += np.maximum(c - d * words, 0) / customers[code] + back[code] * which * np.where(code == HOT, 1.0, now.parent[-1])
            own = (STRENGTH + d * _sums(context, contexts)) / of_context
            out[2] += np.maximum(self.context[2] - d * contexts, 0) / of_context[context] + own[context] * now.parent[self.context[1]]
        return [x / kept for x in out]


def _sums(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.bincount(group, value, int(group[-1]) + 1 if len(group) else 0)


def _discount(once: float, twice: float) -> float:
    """From the counts of counts, within (0, 1)."""
    return float(min(0.95, max(0.05, once / (once + 2 * twice)))) if once + twice else 0.5


# Tasks


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training texts and how often each occurs."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "n"])

    for b in batches(it):
        for t in b.column(0):
            held.update(tokens(t.as_py()))
            if len(held) > COUNTED:
                yield out()
                held.clear()
    if held:
        yield out()


def _merged(g: np.ndarray, code: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Sorted by key, code and place, equal rows once, with their number."""
    order = np.lexsort((place, code, g))
    g, code, place = g[order], code[order], place[order]
    at = starts(g, code, place)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return [g[first], code[first], place[first], np.bincount(at).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)]


def _emit(shared, end: int, base, parts: int, schema: pa.Schema):
    """From (doc_id, held_out, text): a row for each document, and for each batch and shard the packed occurrences of the three kinds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        get, unigram = shared.value.get, base.value
        for b in batches(it, BATCH):
            uid = uuid.uuid4().int >> 65
            ids, hashes, sizes = [], [], []
            for t in b.column(2):
                said = tokens(t.as_py())
                found = np.fromiter(map(get, said, repeat(-1)), np.int64, len(said))
                ids.append(found)
                hashes += [xxh3_64_intdigest(said[i]) for i in np.flatnonzero(found < 0).tolist()]
                sizes.append(len(said))
            if not sizes:
                continue
            word, n = np.concatenate(ids), np.array(sizes)
            doc = np.repeat(np.arange(len(n)), n)
            h = np.zeros(len(word), np.uint64)
            h[word < 0] = np.array(hashes, np.uint64)
            first = np.cumsum(n) - n
            before, before_h = np.roll(word, 1), np.roll(h, 1)
            before[first], before_h[first] = end, xxh3_64_intdigest(b"")
            hot, hot_before = word >= 0, before >= 0
            train = ~np.array(b.column(1).to_pylist(), bool)
            place = (doc * 2 + train[doc]).astype(np.uint32)
            known = np.bincount(doc[hot], minlength=len(n))
            bases = np.bincount(doc[hot], unigram[word[hot]], len(n))
            kinds = []
            for some, g, code in (
                (hot & hot_before, (before * (HOT + 1) + word).astype(np.uint64), np.zeros(len(word), np.uint32)),
                (~hot, h, np.where(hot_before, before, HOT).astype(np.uint32)),
                (~hot_before, before_h, np.where(hot, word, HOT).astype(np.uint32)),
            ):
                rows = _merged(g[some], code[some], place[some])
                at = spread(rows[0], parts)
                order = np.argsort(at, kind="stable")
                kinds.append(([c[order] for c in rows], np.searchsorted(at[order], np.arange(parts + 1))))
            shards, data = [], []
            for p in range(parts):
                packed = [pack([c[cut[p] : cut[p + 1]] for c in rows]) for rows, cut in kinds]
                if any(packed):
                    shards.append(p)
                    data.append(packed)
            m, k = len(n), len(shards)
            cols = [
                pa.array([*[uid % parts] * m, *shards], pa.int32()), pa.array([uid] * (m + k), pa.int64()), pa.array([*range(m), *[None] * k], pa.int32()),
                pa.concat_arrays([b.column(0), pa.nulls(k, b.column(0).type)]), pa.concat_arrays([b.column(1), pa.nulls(k, pa.bool_())]),
                pa.array([*sizes, *[None] * k], pa.int64()), pa.array([*known.tolist(), *[None] * k], pa.int64()), pa.array([*bases.tolist(), *[None] * k], pa.float64()),
                *[pa.array([*[None] * m, *[d[i] for d in data]], pa.binary()) for i in range(3)],
            ]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return run


def _gather(names: list[str], uids_type: pa.DataType):
    """From rows sorted by shard: those of documents as they are, and one row for each shard: its batches, and all occurrences of each kind
    sorted by key and code, with the batch's number."""

    def joined(p: int, held: list[tuple]) -> list:
        uids = [x[0] for x in held]
        out = []
        for kind in range(3):
            parts = [unpack(x[1 + kind], "u4", "u4", "u4") for x in held]
            batch = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(x[0]) for x in parts])
            g, code, place, n = (np.concatenate([x[i] for x in parts]) for i in range(4))
            order = np.lexsort((code, g))
            out.append(pack([c[order] for c in (g, code, batch, place, n)]))
        return [p, uids, *out]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def done() -> pa.RecordBatch:
            p, uids, *packed = joined(last, held)
            one = [pa.array([p], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, uids_type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64())]
            return pa.RecordBatch.from_arrays([*one, *[pa.array([x], pa.binary()) for x in packed], pa.array([uids], pa.list_(pa.int64()))], [*names, "uids"])

        for b in it:
            is_doc = b.column(2).is_valid()
            docs = b.filter(is_doc)
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([*docs.columns, pa.nulls(docs.num_rows, pa.list_(pa.int64()))], [*names, "uids"])
            lists = b.filter(pa.compute.invert(is_doc))
            for p, uid, *packed in zip(lists.column(0).to_pylist(), lists.column(1).to_pylist(), *[lists.column(8 + i).to_pylist() for i in range(3)], strict=True):
                if held and p != last:
                    yield done()
                    held = []
                last = p
                held.append((uid, *packed))
        if held:
            yield done()

    return run


def _shards(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each shard: its number, batches, the three kinds' rows (key, code, batch, place, n), their cells' numbers, and the cells."""
    for b in it:
        for i in range(b.num_rows):
            kinds, at, cells = [], [], []
            for k in range(3):
                g, code, batch, place, n = unpack(b.column(2 + k)[i].as_py(), "u4", "u4", "u4", "u4")
                cell = starts(g, code)
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                count = np.bincount(cell, n * (place & 1)) if len(cell) else np.zeros(0)
                kinds.append((g, code, batch, place, n))
                at.append(cell)
                pair, size = g[first], np.uint64(HOT + 1)
                two = (pair // size, pair % size) if k == 0 else (starts(pair), code[first])
                cells.append((*(x.astype(np.int64) for x in two), count))
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), kinds, at, Cells(*cells)


def _sweep(model):
    """Totals after the next sweep, over a task's shards: (block, sums)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for p, _, _, _, cells in _shards(it):
            tables = cells.one_each()
            for tables in cells.seatings(model.value, p, len(model.value.sweeps)):  # noqa: B007
                pass
            sums = cells.totals(tables) + (0 if sums is None else sums)
        if sums is not None:
            sums = np.pad(sums, (0, -len(sums) % BLOCK)).reshape(-1, BLOCK)
            some = np.flatnonzero(sums.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x.tobytes() for x in sums[some]], pa.binary())], ["block", "sums"])

    return run


def _added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal blocks."""
    held: dict[int, np.ndarray] = {}
    for b in it:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[k] = held.get(k, 0) + np.frombuffer(x)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "sums"])


def _scores(model):
    """Of each shard and batch the sums over the shard's occurrences in the batch's documents: scores, and for rare words known and base."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for p, uids, kinds, at, cells in _shards(it):
            logs = [np.log10(x) for x in cells.predictions(m, p)]
            total = _sums(cells.word[0], cells.word[2])[cells.word[0]][at[1]]
            rare = [x[3] >> 1 for x in kinds]
            places = [x[2].astype(np.int64) << 32 | r for x, r in zip(kinds, rare, strict=True)]
            where, inverse = np.unique(np.concatenate(places), return_inverse=True)
            score = np.bincount(inverse, np.concatenate([x[4] * g[a] for x, g, a in zip(kinds, logs, at, strict=True)]), len(where))
            some, inverse = np.unique(places[1], return_inverse=True)
            base = np.bincount(inverse, kinds[1][4] * np.log10((total + 1) / (m.tokens + m.words + 1)), len(some))
            known = np.bincount(inverse, kinds[1][4] * (total > 0), len(some))
            cuts = [np.searchsorted(x >> 32, np.arange(len(uids) + 1)) for x in (where, some)]
            made: list[list] = [[], [], []]
            for k, uid in enumerate(uids):
                (i, j), (v, w) = ((c[k], c[k + 1]) for c in cuts)
                if i < j:
                    made[0].append(uid)
                    made[1].append(pack([(where[i:j] & 0xFFFFFFFF).astype(np.uint64), score[i:j].astype(np.float32)]))
                    made[2].append(pack([(some[v:w] & 0xFFFFFFFF).astype(np.uint64), known[v:w].astype(np.uint32), base[v:w]]))
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.binary()), pa.array(made[2], pa.binary())], ["uid", "scores", "rare"])

    return run


def _by_document(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (uid, scores, rare) sorted by uid: (uid, doc, score, base, known), sums over the shards."""
    last, held = None, np.zeros((4, 0))

    def done() -> pa.RecordBatch:
        some = np.flatnonzero(held[3])
        cols = [pa.array(np.full(len(some), last, np.int64)), pa.array(some.astype(np.int32)), pa.array(held[0][some]), pa.array(held[1][some]), pa.array(held[2][some].astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["uid", "doc", "s", "b", "k"])

    for batch in it:
        for uid, scores, rare in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and uid != last:
                yield done()
                held = np.zeros((4, 0))
            last = uid
            (doc, score), (of, known, base) = unpack(scores, "f4"), unpack(rare, "u4", "f8")
            held = np.pad(held, ((0, 0), (0, max(0, int(doc[-1]) + 1 - held.shape[1]))))
            held[0, doc.astype(np.int64)] += score
            held[3, doc.astype(np.int64)] = 1
            held[1, of.astype(np.int64)] += base
            held[2, of.astype(np.int64)] += known
    if last is not None:
        yield done()


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows whose remainder is 2 are held out of training."""
    spark = docs.sparkSession
    share, scratch = spark.sparkContext.broadcast, Scratch(spark, "hpylm")
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    counts = rows.where("NOT held_out").select("text").mapInArrow(_count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # The hot tokens, all those above a count that no more than HOT have: a histogram of fixed size tells which count that is.
    step = F.floor(F.log("n") * 64).cast("int")
    left, least = HOT - 1, None
    for r in counts.where("w <> X''").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        left -= r["words"]
        if left < 0:
            break
        least = r["step"]
    found = counts.where("w <> X''").where(step >= least).collect() if least is not None else []  # bounded by HOT
    top = {bytes(r["w"]): r["n"] for r in sorted(found, key=lambda r: (-r["n"], bytes(r["w"])))}
    ends = counts.where("w = X''").first()
    top[b""] = ends["n"] if ends else 0
    hot, customers = {w: i for i, w in enumerate(top)}, np.zeros(HOT + 1)
    customers[: len(top)] = list(top.values())
    model = Model(int(n_tokens), int(n_words), customers)
    if not top[b""]:  # nothing to learn from: all words are unknown, the end as well
        hot = {}
    base = np.log10((customers + 1) / (model.tokens + model.words + 1))
    parts = max(8, -(-model.tokens // SHARD_TOKENS))

    fields = [StructField("p", IntegerType()), StructField("uid", LongType()), StructField("doc", IntegerType()), StructField("doc_id", docs.schema[doc_id].dataType), StructField("held_out", BooleanType())]
    fields += [StructField("n_tokens", LongType()), StructField("known", LongType()), StructField("base", DoubleType()), *[StructField(f"kind{i}", BinaryType()) for i in range(3)]]
    names = [f.name for f in fields]
    emitted = rows.mapInArrow(_emit(share(hot), hot.get(b"", -1), share(base), parts, pa.schema([(n, pa.null()) for n in names])), StructType(fields))
    dealt = emitted.repartition("p").sortWithinPartitions("p")
    dealt = dealt.mapInArrow(_gather(names, to_arrow_type(docs.schema[doc_id].dataType)), StructType([*fields, StructField("uids", ArrayType(LongType()))]))
    dealt = scratch.save(dealt, "dealt")
    lists = dealt.where("doc IS NULL").select("p", "uids", "kind0", "kind1", "kind2")
    for sweep in range(SWEEPS + 1):
        sums = lists.mapInArrow(_sweep(share(model)), "block int, sums binary").repartition("block").mapInArrow(_added, "block int, sums binary")
        flat = np.zeros(-(-(2 * HOT + 9) // BLOCK) * BLOCK).reshape(-1, BLOCK)
        for r in sums.collect():  # bounded: 129 blocks
            flat[r["block"]] = np.frombuffer(r["sums"])
        flat, size = flat.ravel(), HOT + 1
        rest = flat[2 * size :]
        if sweep == 0:
            model.customers[HOT], model.discount = rest[4], _discount(rest[5], rest[6])
        model.sweeps.append(Totals(flat[:size], flat[size : 2 * size], rest[:4]))
    sums = lists.mapInArrow(_scores(share(model)), "uid long, scores binary, rare binary").repartition("uid").sortWithinPartitions("uid")
    sums = sums.mapInArrow(_by_document, "uid long, doc int, s double, b double, k long")
    both = dealt.where("doc IS NOT NULL").select("uid", "doc", "doc_id", "held_out", "n_tokens", "known", "base").join(sums, ["uid", "doc"])
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("k")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("b")).alias("base_score"), F.col("s").alias("score"),
    )
