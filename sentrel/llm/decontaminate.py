"""Benchmark decontamination with an FM-index per training shard.

The words of a shard of documents become a sequence of ids over the benchmark's vocabulary. Other words end a segment, as no
window holds them; segments too short for any window are left out, long ones are cut with an overlap that no window exceeds.
Over this sequence a suffix array is sorted by prefix doubling (separators are unique, so depth is bounded by a
segment), its Burrows-Wheeler transform goes into a wavelet matrix, and all benchmark windows are searched backwards
at once through its ranks. Occurrences are located by walking to sampled suffix positions; overlapping occurrences
merge into removal spans.

Benchmark windows travel to the executors in blocks of ``BLOCK`` bytes of text at most; every block is one more narrow pass over
the documents, so the benchmark may have any size. Documents are never shuffled. Defined cases: a null text has no words; items
without words have no window; a null item_id reads as the empty string; items may share texts, and then all are
reported; repeated documents and very long ones are handled one by one; columns named as the results are replaced; an empty benchmark hits
nothing, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sentrel.llm.common import batches

#: Words of a window; bytes of benchmark text in a pass; symbols in a shard; words in a segment; sampled suffix positions.
WINDOW, BLOCK, SHARD, SEGMENT, SAMPLE = 10, 4 << 20, 1 << 19, 64, 8

# Bytes that separate words, and A-Z to lower case.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class WaveletMatrix:
    """Ranks over a sequence of small integers: one bit vector a level, with counts for each 64 bits."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for level in reversed(range(bits)):
            bit = (seq >> level) & 1 == 1
            self.levels.append((*packed(bit), int(len(bit) - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbol's occurrences before ``at`` end, in the sequence sorted by the matrix."""
        for level, (words, counts, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            ones = rank_of(words, counts, at)
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``at``, and the rank of each as ``rank`` gives it."""
        symbol = np.zeros(len(at), np.int64)
        for words, counts, zeros in self.levels:
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = rank_of(words, counts, at)
            at = np.where(bit, zeros + ones, at - ones)
            symbol = symbol << 1 | bit
        return symbol, at


def packed(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
    padded[: len(bit)] = bit
    words = np.packbits(padded, bitorder="little").view(np.uint64)
    return words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])


def rank_of(words: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return counts[at >> 6] + np.bitwise_count(words[at >> 6] & below).astype(np.int64)


def suffix_array(seq: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Suffixes in order, each compared up to its separator (0), then by position. ``depth``: the longest segment."""
    n = len(seq)
    place = max(1, int(n - 1).bit_length())
    if 2 * (place + 1) + place > 63:
        raise ValueError("a shard is too long for packed ranks")
    at = np.arange(n, dtype=np.int64)
    ends = np.where(seq == 0, at, n)
    ends = np.minimum.accumulate(ends[::-1])[::-1]  # the next separator
    width = max(1, min(depth, (63 - place) // bits))
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate([seq, np.zeros(width, seq.dtype)])
    for k in range(width):
        key = key << bits | np.where(alive, padded[k : k + n], 0)
        alive &= padded[k : k + n] > 0
    while True:
        order = np.sort(key << place | at)
        value, order = order >> place, order & ((1 << place) - 1)
        step = np.concatenate([[0], value[1:] != value[:-1]]).cumsum()
        if width > depth or step[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = step
        inside = at + width <= ends
        key = rank << (place + 1)
        key[inside] |= rank[(at + width)[inside].clip(max=n - 1)] + 1
        width *= 2


class FMIndex:
    """An index of one shard. ``seq`` holds symbols from 1 on, with 0 after each segment."""

    def __init__(self, seq: np.ndarray, sigma: int, depth: int = SEGMENT) -> None:
        seq = seq.astype(np.int64)
        bits = max(1, int(sigma).bit_length())
        order = suffix_array(seq, bits, depth)
        bwt = np.where(order > 0, seq[order - 1], 0)
        self.n, self.wavelet = len(seq), WaveletMatrix(bwt, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))])
        self.base = self.wavelet.rank(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.marks, self.samples = packed(sampled), order[sampled]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern; patterns are right-aligned rows of symbols."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(1, patterns.shape[1] + 1):
            live = live[(length[live] >= k) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = patterns[live, -k]
            shift = self.first[symbol] - self.base[symbol]
            low[live] = self.wavelet.rank(symbol, low[live]) + shift
            high[live] = self.wavelet.rank(symbol, high[live]) + shift
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows, by steps back to a sampled one."""
        out, steps, at = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            here = at[todo]
            hit = (self.marks[0][here >> 6] >> (here & 63).astype(np.uint64)) & np.uint64(1) == 1
            done = todo[hit]
            out[done] = self.samples[rank_of(*self.marks, at[done])] + steps[done]
            todo = todo[~hit]
            symbol, rank = self.wavelet.access(at[todo])
            at[todo] = self.first[symbol] + rank - self.base[symbol]
            steps[todo] += 1
        return out


class Windows:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.ids = {w: k for k, w in enumerate(sorted({w for p in found for w in p}), 1)}
        self.length = np.array([len(p) for p in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.patterns[k, window - len(p) :] = [self.ids[w] for w in p]
        self.items = [sorted(x) for x in found.values()]
        self.shortest, self.longest = int(self.length.min(initial=window)), int(self.length.max(initial=1))

    def symbols(self, text: str | None) -> np.ndarray:
        """Ids of the text's words, 0 for those in no window; long texts are cut at separators and read in pieces."""
        raw, get, out, at = (text or "").encode().translate(_TABLE), self.ids.get, [], 0
        while at < len(raw):
            cut = raw.find(b" ", at + (4 << 20)) if len(raw) - at > 4 << 20 else -1
            cut = len(raw) if cut < 0 else cut
            words = raw[at:cut].split()
            out.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
            at = cut
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def hits(self, texts: list[np.ndarray]) -> tuple[np.ndarray, list[set[str]]]:
        """For the texts' symbols end to end: which words are hit, and for each text the items that occur."""
        whole = np.concatenate([*texts, np.zeros(0, np.int32)])
        bounds = np.cumsum([0, *map(len, texts)])
        items: list[set[str]] = [set() for _ in texts]
        # Segments: runs of known words within a text.
        inside = np.concatenate([[0], whole > 0, [0]]).astype(np.int8)
        edge = np.diff(inside)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = bounds[1:-1]
        if len(cuts) and len(begin):  # a run that crosses the border of two texts is two runs
            run = np.searchsorted(begin, cuts, "right") - 1
            cuts = np.unique(cuts[(run >= 0) & (begin[run] < cuts) & (cuts < end[run])])
            begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        stride = SEGMENT - self.longest + 1
        pieces = np.maximum(1, -(-(end - begin - self.longest + 1) // stride))
        start = np.repeat(begin, pieces) + stride * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(np.repeat(end, pieces) - start, SEGMENT)
        delta = np.zeros(len(whole) + 1, np.int64)
        filled, shard = np.cumsum(size + 1), 0
        while shard < len(size):
            stop = max(shard + 1, int(np.searchsorted(filled, (filled[shard - 1] if shard else 0) + SHARD, "right")))
            at, n = start[shard:stop], size[shard:stop]
            offset = np.cumsum(n + 1) - (n + 1)
            place = np.repeat(at - offset, n + 1) + np.arange(int((n + 1).sum()))  # of each symbol among all words
            seq = np.where(np.arange(len(place)) == np.repeat(offset + n, n + 1), 0, whole[place.clip(max=len(whole) - 1)])
            index = FMIndex(seq, len(self.ids))
            low, high = index.search(self.patterns, self.length)
            count = np.maximum(high - low, 0)
            which = np.repeat(np.arange(len(count)), count)
            rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            position = place[index.locate(rows)]
            np.add.at(delta, position, 1)
            np.add.at(delta, position + self.length[which], -1)
            doc = np.searchsorted(bounds, position, "right") - 1
            for d, k in np.unique(np.stack([doc, which], 1), axis=0):
                items[d].update(self.items[k])
            shard = stop
        return np.cumsum(delta[:-1]) > 0, items


def runs(hit: np.ndarray) -> np.ndarray:
    """[start, end) of each run of true values."""
    edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points [start, end) of runs of words, each from its first word's first character to its last word's last."""
    raw = np.frombuffer(text.encode(), np.uint8)
    word = np.frombuffer(_TABLE, np.uint8)[raw] != 0x20
    at = runs(word)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(points[at[a, 0]]), int(points[at[b - 1, 1]])) for a, b in spans]


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def blocks(benchmark: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of bounded size; the driver holds one at a time."""
    block, held = [], 0
    for item, words in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), text).where(F.col(text).isNotNull()).toLocalIterator():
        if block and held + len(words.encode()) > size:
            yield block
            block, held = [], 0
        block.append((item, words))
        held += len(words.encode())
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """All columns of ``docs``, and n_words, spans (array of [start, end) over words, merged), items (array of ids, sorted); columns of ``docs`` with
    those names are replaced."""
    made = ["n_words", "spans", "items"]
    names = [c for c in docs.columns if c == text or c.lower() not in made]
    out = docs.select(*names, F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))

    def step(windows) -> object:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = Windows(windows.value, window) if windows else None
            for b in batches(it, 4 << 20):
                texts = b.column(names.index(text)).to_pylist()
                if w is None:
                    n, spans, items = [len(words_of(t)) for t in texts], b.column(len(names) + 1), b.column(len(names) + 2)
                else:
                    symbols = [w.symbols(t) for t in texts]
                    hit, found = w.hits(symbols)
                    n, spans, items, at = [len(s) for s in symbols], [], [], 0
                    for size, old, mine, had in zip(n, b.column(len(names) + 1).to_pylist(), found, b.column(len(names) + 2).to_pylist(), strict=True):
                        own = hit[at : at + size]
                        for s in old:
                            own[s["start"] : s["end"]] = True
                        spans.append([{"start": int(x), "end": int(y)} for x, y in runs(own)])
                        items.append(sorted(mine | set(had)))
                        at += size
                    spans, items = pa.array(spans, _ARROW_SPANS), pa.array(items, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(n, pa.int64()), spans, items], [*names, *made])

        return run

    schema = StructType([*out.schema.fields[: len(names)], StructField("n_words", LongType()), StructField("spans", _SPANS), StructField("items", ArrayType(StringType()))])
    context, any_block = docs.sparkSession.sparkContext, False
    for items in blocks(benchmark, item_id, item_text, block):
        out, any_block = out.mapInArrow(step(context.broadcast(items)), schema), True
    if not any_block:
        out = out.mapInArrow(step(None), schema)
    return out


_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with the words of ``spans`` cut out of ``text``."""

    def cut(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(batch_iter):
            k, out = b.schema.get_field_index(text), []
            for t, s in zip(b.column(k).to_pylist(), b.column(b.schema.get_field_index(spans)).to_pylist(), strict=True):
                if t and s:
                    kept, at = [], 0
                    for a, e in char_spans(t, [(x["start"], x["end"]) for x in s]):
                        kept.append(t[at:a])
                        at = e
                    t = "".join([*kept, t[at:]])
                out.append(t)
            yield b.set_column(k, b.schema.field(k).name, pa.array(out, pa.string()))

    return docs.mapInArrow(cut, docs.schema)


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
