"""BPE encoding and decoding by dynamic programming over prefixes.

Byte-pair encoding has a property that makes the greedy merge loop unnecessary: every prefix of a word has exactly one
possible last token. A token that ends at position i is the last one of that prefix if it is compatible with the
last token of the prefix that it leaves, that is, if merging the two tokens' symbols yields these two tokens again. So one
pass over the tokens that end at each position (an Aho-Corasick automaton, whose states are the suffixes that are tokens)
stores the last token of each prefix, and back-pointers give the ids. Compatibility of a pair is found once and kept.

The tokenizer file (the ``tokenizers`` JSON format, BPE with an end-of-word suffix, split by a pattern, byte-level
alphabet) is a parameter; its bytes, of fixed size, travel to the executors. Defined cases: a null text is empty; special
tokens found in a text are encoded as such; empty text gives no ids and the empty string; rows are independent of each
other, so repeated rows and long texts need no care; columns named as the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.llm.common import batches, free, kept_model

#: Chunks of text whose encoding is kept by each worker, and pairs of tokens whose compatibility is kept.
CHUNKS_KEPT, PAIRS_KEPT = 360_000, 250_000
#: Slots that tell which chunks were met before: a chunk is kept from its second time on, so one-off chunks take no room.
SLOTS = 1 << 21


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, spec: bytes) -> None:
        import ahocorasick
        import regex
        import tokenizers

        spec = json.loads(spec)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        if not self.suffix or model["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError("a BPE file with an end-of-word suffix and no decoder is needed")
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in reversed(merges)}
        self.edges: dict[str, list[tuple[str, int]]] = {}
        self.id_text = {t: str(i) for t, i in self.ids.items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in added.items()}
        self.shown = {str(i): t for i, t in self.tokens.items()}
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.space = regex.compile(r"\s+")
        self.separators = regex.compile(r"[\x1C-\x1F]").search
        # Beyond the Latin blocks Unicode versions differ, so normalising and splitting are left to the library there.
        self.wide = regex.compile(r"[^\x00-\u024F]").search
        # The normalizer alone is wanted, so the library gets the file without its vocabulary.
        bare = spec | {"added_tokens": [], "post_processor": None, "model": model | {"vocab": {}, "merges": [], "unk_token": None}}
        self.normal = tokenizers.Tokenizer.from_str(json.dumps(bare)).normalizer.normalize_str
        self.wide_split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.byte = byte_alphabet()
        self.table = {b: c for b, c in enumerate(self.byte)}
        # Tokens that stand inside a word, and those that end it; a token counts only if it encodes as itself.
        self.inside = ahocorasick.Automaton()
        self.ends: dict[str, int] = {}
        self.longest_end = 0
        for t in self.ids:
            if t.endswith(self.suffix) and t != self.suffix:
                if self.merge([*t[: -len(self.suffix)][:-1], t[: -len(self.suffix)][-1] + self.suffix]) == [t]:
                    self.ends[t[: -len(self.suffix)]] = self.ids[t]
                    self.longest_end = max(self.longest_end, len(t) - len(self.suffix))
            elif self.merge([*t]) == [t]:
                self.inside.add_word(t, t)
        self.inside.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.met, self.marks = bytearray(SLOTS), 0

    def merge(self, symbols: list[str]) -> list[str]:
        """The merge loop itself; used on single tokens and pairs of tokens only."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def spine(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The symbols that stand at one edge of a token while it is merged, each with the rank of the merge that uses it up."""
        out, gone = [(token, 1 << 60)], 1 << 60
        while (parts := self.parts.get(token)) is not None:
            gone = self.rank[parts]
            token = parts[right]
            out.append((token, gone))
        return out

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` followed by ``right`` stays these two tokens: no merge joins symbols across the boundary while both are there."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            rank, known = self.rank.get, True
            starts = self.edges.get(right) or self.edges.setdefault(right, self.spine(right, False))
            for a, a_gone in self.spine(left, True):
                for b, b_gone in starts:
                    r = rank((a, b))
                    if r is not None and r < a_gone and r <= b_gone:  # of equal merges the left one comes first
                        known = False
            self.pairs[left, right] = known
        return known

    def encode_word(self, word: str) -> list[str]:
        """The tokens of one word, given in the byte-level alphabet."""
        n = len(word)
        if n <= self.longest_end and word in self.ends:
            return [word + self.suffix]
        last: list[str] = [""] * (n + 1)
        done, known, compatible = 0, self.pairs.get, self.compatible
        if n > 1:
            for end, token in self.inside.iter(word, 0, n - 1):
                if done <= end:
                    begin = end + 1 - len(token)
                    if begin:
                        left = last[begin]
                        fits = known((left, token))
                        if fits is None:
                            fits = compatible(left, token)
                        if not fits:
                            continue
                    done = end + 1
                    last[done] = token
        ends = self.ends
        for size in range(min(n, self.longest_end), 0, -1):
            token = word[n - size :]
            if token in ends and (n == size or self.compatible(last[n - size], token + self.suffix)):
                break
        else:
            raise ValueError(f"no encoding of {word!r}")
        out, at = [token + self.suffix], n - size
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def chunk(self, chunk: str) -> str:
        """Ids, joined by spaces, of what stands between two white spaces."""
        found = self.chunks.get(chunk) or self.older.get(chunk)
        if len(self.chunks) >= CHUNKS_KEPT // 2:
            self.older, self.chunks = self.chunks, {}
        if found:
            self.chunks[chunk] = found
            return found
        if not chunk.isascii() and self.wide(chunk):
            pieces = [piece for piece, _ in self.wide_split(self.normal(chunk))]
        else:
            pieces = self.split(chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).lower())
        tokens = []
        for piece in pieces:  # printable ASCII stands for itself in the byte alphabet
            plain = piece.isascii() and piece.isprintable()
            tokens += self.encode_word(piece if plain else piece.encode().decode("latin-1").translate(self.table))
        found = " ".join([self.id_text[t] for t in tokens])
        slot = hash(chunk) % SLOTS
        if self.met[slot]:
            self.chunks[chunk] = found
        else:
            if self.marks >= SLOTS // 2:
                self.met, self.marks = bytearray(SLOTS), 0
            self.met[slot], self.marks = 1, self.marks + 1
        return found

    def encode(self, text: str) -> tuple[str, int, str]:
        """Ids joined by spaces, how many, and the decoded text. No token spans white space, so encodings of chunks are kept."""
        get, out = self.chunks.get, []
        for k, part in enumerate(self.special.split(text) if any(a in text for a in self.added) else [text]):
            if k % 2:
                out.append(str(self.added[part]))
            else:
                # Python's split also cuts at the four separators 1C to 1F, which are not white space to the library.
                found = self.space.split(part) if self.separators(part) else part.split()
                out += [get(c) or self.chunk(c) for c in found]
        joined = " ".join(filter(None, out))
        ids = joined.split()
        return joined, len(ids), " ".join(map(self.shown.__getitem__, ids))

    def ids_of(self, text: str) -> list[int]:
        joined = self.encode(text)[0]
        return [int(x) for x in joined.split(" ")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: tokens joined by spaces, unknown ids left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encoder(spec: bytes) -> PrefixBpe:
    """One encoder per worker and file."""
    return kept_model(_key(spec), lambda: PrefixBpe(spec))


def _key(spec: bytes) -> str:
    return f"bpe-{hashlib.sha256(spec).hexdigest()}"


def encode_table(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Per row: the columns ``keep``, then ids (array of int, if asked for), n_tokens, ids_sha256, decoded_sha256."""
    spec = Path(tokenizer).read_bytes()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c.lower() not in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(free(docs, "_text")))
    schema = "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema += (", " if keep else "") + ("ids: array<int>, " if with_ids else "") + "n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
    names = [*keep, *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for b in batches(it, 1 << 21, _key(shared.value)):
            ids, ends, counts, ids_sha, text_sha = array("i"), [0], [], [], []
            for t in b.column(len(keep)):
                joined, n, decoded = bpe.encode(t.as_py())
                counts.append(n)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids.extend(map(int, joined.split()))
                    ends.append(len(ids))
            made = ([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))] if with_ids else []) + [pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names)

    from pyspark.sql.types import _parse_datatype_string

    return source.mapInArrow(run, _parse_datatype_string(schema))
