"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrel.llm import bpe, chat_format, cws, decontaminate, hpylm, line_dedup, quality, sharding, simhash, url_filter
from sentrel.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans string"


def words(rnd, n, vocabulary=40):
    return " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empties, copies, near copies, repeated rows, a shared passage, odd characters and a long text."""
    rnd = random.Random(5)
    passage = words(rnd, 60, 400)
    texts = [None, "", " \n ", "one", "one two", words(rnd, 40), words(rnd, 40, 400), "é漢字 😀 <|endoftext|> don't", words(rnd, 9000, 400)]
    copy = words(rnd, 120, 400)
    texts += [copy, copy, copy + " x", passage, "head\n" + passage + "\ntail", words(rnd, 30) + "\n" + passage, "a\nb\nc", "a\nb\nc"]
    rows = [(i, t, "en", "s", len(t or ""), "extra", "extra") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id", None, None, None, None, None)]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_like_the_library(spark, docs, empty):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rnd = random.Random(1)
    texts = ["", "ΟΔΟΣ İ ẞ é", "'s 't 12½", "x" * 500, "\x1c a\x85b", *("".join(rnd.choice("abcé' <|>thinger\t.!AÉ漢😀") for _ in range(30)) for _ in range(300))]
    mine = bpe.PrefixBpe(open(path, "rb").read())
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert mine.ids_of(t) == ids
        assert mine.decode(ids) == mine.encode(t)[2] == library.decode(ids, skip_special_tokens=False)
    got = bpe.encode_table(docs, path)
    assert got.count() == docs.count() and {"lang", "n_tokens", "ids"} <= set(got.columns)
    assert bpe.encode_table(empty, path).count() == 0


def brute_hits(text, windows):
    said = decontaminate.words_of(text)
    hit, items = set(), set()
    for w, ids in windows.items():
        for i in range(len(said) - len(w) + 1):
            if tuple(said[i : i + len(w)]) == w:
                hit.update(range(i, i + len(w)))
                items |= ids
    return len(said), len(hit), sorted(items)


def test_decontamination_like_brute_force(spark, docs, corpus, empty):
    rnd = random.Random(2)
    passage = corpus[12][1].split()
    items = [(1, " ".join(passage[5:30])), (2, "one two"), (3, None), (4, ""), (5, words(rnd, 15)), (6, " ".join(passage[:12])), (6, "b"), (None, "tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        said = decontaminate.words_of(t)
        for k in range(max(1, len(said) - 9) if said else 0):
            windows.setdefault(tuple(said[k : k + 10]), set()).add("" if i is None else str(i))
    for block in (1 << 20, 40):  # one pass, and many
        plain = docs
        got = decontaminate.find_contamination(plain, bench, block=block).select("text", "n_words", decontaminate.hit_words().alias("n"), "items").collect()
        for r in got:
            assert (r["n_words"], r["n"], r["items"]) == brute_hits(r["text"], windows)
        assert len(got) == len(corpus)
    cut = decontaminate.remove_spans(decontaminate.find_contamination(docs, bench))
    for r in cut.collect():
        assert not (set(windows) & {tuple(decontaminate.words_of(r["text"])[i : i + 10]) for i in range(20)})
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(plain, bench.limit(0)).where(F.size("spans") > 0).count() == 0


def test_index_finds_all_occurrences():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        seq = rnd.integers(0, 4, 300)
        seq[-1] = 0
        index = decontaminate.FMIndex(seq, 3, depth=300)
        for n in (1, 2, 3):
            patterns = np.array(list(itertools.product((1, 2, 3), repeat=n)))
            low, high = index.search(patterns, np.full(len(patterns), n))
            for p, a, b in zip(patterns, low, high, strict=True):
                want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_shards(spark, docs, corpus, empty):
    rnd = random.Random(4)
    for _ in range(200):
        sizes = [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 10))]
        k = rnd.randrange(1, 5)
        best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *c, len(sizes)])) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1))
        at = sharding.cuts(sizes, k)
        assert len(at) == k + 1 and at[0] == 0 and at[-1] == len(sizes) and at == sorted(at)
        assert sharding.smallest_capacity(sizes, k) == best == max(sum(sizes[a:b]) for a, b in itertools.pairwise(at))
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(corpus)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((t or "").encode()) for r in got for t in [next(c[1] for c in corpus if c[0] == r["doc_id"])])
    assert sharding.shard(empty, 4).count() == 0


@pytest.mark.parametrize(("bits", "finer"), [(16, 256), (2, 3)])
def test_capacity_is_the_smallest_over_all_groups(spark, monkeypatch, bits, finer):
    """The shards of the query: equal texts together, groups contiguous in their order, no capacity smaller over the groups themselves."""
    monkeypatch.setattr(sharding, "CELL_BITS", bits)
    monkeypatch.setattr(sharding, "FINER", finer)
    rnd = random.Random(7)
    texts = [words(rnd, rnd.randrange(1, 60), 9) for _ in range(150)]
    rows = [(i, rnd.choice(texts[: 20 if i % 3 else 150])) for i in range(400)] + [(i, texts[0]) for i in range(400, 1500)] + [(None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, 7).collect()
    hashed = df.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("size")).collect()
    groups, cells = Counter(), Counter()
    for r in hashed:
        groups[r["h"]] += r["size"]
        cells[(r["h"] % 2**64) >> (64 - bits)] += r["size"]
    cell = lambda h: (h % 2**64) >> (64 - bits)
    order = sorted(groups, key=lambda h: (-cells[cell(h)], cell(h), h))
    best = sharding.smallest_capacity([groups[h] for h in order], 7)
    by_crc = {r["crc"]: r["h"] for r in hashed}
    at = {}
    for r in got:
        assert at.setdefault(by_crc[r["text_crc32"]], r["shard"]) == r["shard"]
    assert [at[h] for h in order] == sorted(at[h] for h in order)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) == best
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_language_model(spark, docs, corpus, empty):
    got = hpylm.score_documents(docs).collect()
    train = Counter(w for c in corpus if zlib.crc32(str(c[0] if c[0] is not None else "").encode()) % 7 != 2 for w in hpylm.tokens(c[1]))
    n, v = sum(train.values()), len(train)
    assert len(got) == len(corpus)
    for r in got:
        said = hpylm.tokens(next(c[1] for c in corpus if c[0] == r["doc_id"]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(said), sum(train[w] > 0 for w in said), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in said))
        assert r["score"] < 0
    assert hpylm.score_documents(empty).count() == 0
    assert {r["n_known"] for r in hpylm.score_documents(docs.where("doc_id IS NULL OR crc32(cast(doc_id AS string)) % 7 = 2")).where("held_out").collect()} != set()


def seated_model(monkeypatch, texts, hot=6):
    """A model of one shard with few hot words, and its cells: each kind holds all pairs of known words, also those that never occurred."""
    monkeypatch.setattr(hpylm, "HOT", hot)
    said = [w for t in texts for w in t.split()]
    count = Counter(said)
    ranked = [w for w, _ in count.most_common()]
    at = {w: i for i, w in enumerate(ranked)}
    pairs = Counter(itertools.pairwise(said))
    kinds = [[], [], []]
    for u in ranked:
        for w in ranked:
            c = pairs[u, w]
            if at[u] < hot and at[w] < hot:
                kinds[0].append((at[u], at[w], c))
            elif at[u] < hot:
                kinds[1].append((at[w] - hot, at[u], c))
    for w in ranked[hot:]:
        kinds[1].append((at[w] - hot, hot, sum(pairs[u, w] for u in ranked[hot:])))
    for u in ranked[hot:]:
        kinds[2] += [(at[u] - hot, at[w], pairs[u, w]) for w in ranked[:hot]] + [(at[u] - hot, hot, sum(pairs[u, w] for w in ranked[hot:]))]
    cells = hpylm.Cells(*(tuple(np.array(x) for x in zip(*sorted(k), strict=True)) for k in kinds))
    customers = np.array([sum(c for (u, _), c in pairs.items() if u == w) for w in ranked[:hot]] + [cells.word[2][cells.word[1] == hot].sum()], float)
    model = hpylm.Model(len(said), len(count), customers, 0.6)
    for sweep in range(hpylm.SWEEPS + 1):
        tables = cells.one_each()
        for tables in cells.seatings(model, 0, sweep):  # noqa: B007
            for t, k in zip(tables, (cells.pair, cells.word, cells.context), strict=True):
                assert (t <= k[2]).all() and ((t > 0) == (k[2] > 0)).all()
        places = cells.totals(tables)
        model.sweeps.append(hpylm.Totals(places[: hot + 1], places[hot + 1 : 2 * hot + 2], places[2 * hot + 2 :][:4]))
    return model, cells


def test_predictions_sum_to_one(monkeypatch):
    rnd = random.Random(1)
    model, cells = seated_model(monkeypatch, [" ".join(rnd.choices("abcdefghijkl", [90, 60, 40, 20, 10, 8, 6, 5, 3, 2, 2, 1], k=4000))])
    p = cells.predictions(model, 0)
    unknown = np.mean([(1 + 0.6 * s.context) / (1 + model.customers) * s.which(np.zeros(1)) * np.append(np.full(6, s.parent[-1]), 1.0) for s in model.sweeps[1 + hpylm.BURN :]], axis=0)
    for u in range(7):  # each hot context over all words, then the shared restaurant over the rare ones
        assert p[0][cells.pair[0] == u].sum() + p[1][cells.word[1] == u].sum() + unknown[u] == pytest.approx(1)
    for u in set(cells.context[0].tolist()):  # each rare context over the hot words and "a rare word"
        assert p[2][cells.context[0] == u].sum() == pytest.approx(1)


def test_seating_like_the_exact_distribution(monkeypatch):
    """Beyond EXACT customers, seatings drawn forward and weighed have the mean and the spread of t ~ A^t S_d(c, t)."""
    for count, weight in ((200, 0.3), (200, 5.0), (600, 40.0), (2000, 2.0), (2000, 100.0)):
        row = hpylm.stirling(0.6, count)[count] + np.log(weight) * np.arange(1, count + 1)
        p = np.exp(row - row.max())
        p /= p.sum()
        t = np.arange(1, count + 1)
        mean, spread = (p * t).sum(), np.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
        got = hpylm.draw(np.full(4000, count), np.full(4000, weight), 0.6, np.random.default_rng(5), hpylm.stirling(0.6, hpylm.EXACT))
        assert got.mean() == pytest.approx(mean, rel=0.03) and got.std() == pytest.approx(spread, rel=0.15)


def test_packed_lists():
    rnd = np.random.default_rng(4)
    arrays = [np.sort(rnd.integers(0, 1 << 63, 500).astype(np.uint64)), rnd.integers(0, 1 << 32, 500).astype(np.uint32)]
    assert all((a == b).all() for a, b in zip(arrays, hpylm.unpack(hpylm.pack(arrays), "u4"), strict=True))
    assert hpylm.unpack(hpylm.pack([a[:0] for a in arrays]), "u4")[0].size == 0


def test_model_beats_the_base_on_held_out_texts(spark):
    """Texts of a bigram chain: held-out perplexity by the model is below that by the base."""
    rnd = random.Random(3)
    follows = {w: [rnd.choice("abcdefghijklmnopqrst") for _ in range(3)] for w in "abcdefghijklmnopqrst"}
    rows = []
    for i in range(200):
        said = ["a"]
        for _ in range(60):
            said.append(rnd.choice(follows[said[-1]]))
        rows.append((i, " ".join(said)))
    got = hpylm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert 10 ** (-got[0] / got[2]) < 0.4 * 10 ** (-got[1] / got[2])


def test_chat(spark):
    odd = "a\\b <|im_end|>\n <\\|x [INST] </s> [\\/INST] <"
    rows = [(1, 0, "user", odd), (1, 1, "user", ""), (1, 2, "assistant", odd + odd), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 5, "assistant", "n"), (3, None, "r<|im_msg|>", "y"), (4, 900, "user", "late"), (4, -3, "assistant", "é😀"), (4, 64, "user", "mid")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat_format.format_chat(df)
    got = {r["conv_id"]: r for r in done.select("conv_id", chat_format.read_chat(F.col("formatted")).alias("t"), chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [tuple(t) for t in got[conv]["t"]] == [(w[2], w[3]) for w in want]
        assert got[conv]["loss"] == [w[3] for w in want if w[2] == "assistant"]
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_quality(spark, docs, empty):
    rnd = random.Random(6)
    rows = [(i, " ".join(("good" if i % 4 else "BAD!!") + str(rnd.randrange(99)) for _ in range(60))) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows if i % 3] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(table, labels)
    got = quality.score(table, model).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 > 0) for r in got]) > 0.97
    scored = quality.score(docs, model)
    assert scored.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality.score(empty, model).count() == 0
    assert quality.score(docs, quality.fit(table, labels.limit(0))).select("score").distinct().collect()[0][0] == 0.5


def plain_score(model, text):
    """The classifier by loops over places, blocks and chunks."""
    n = max(1, -(-(len(text) + quality.WIDTH - 1) // quality.BLOCK))
    data = text + bytes(n * quality.BLOCK - len(text))
    places = [sum(model.table[k][data[i + k]] for k in range(quality.WIDTH)) + model.bias for i in range(len(data) - quality.WIDTH + 1)]
    blocks = [np.maximum(np.max(places[i : i + quality.BLOCK], axis=0), 0) for i in range(0, len(data), quality.BLOCK)]
    chunks = [np.maximum(blocks[i], blocks[i + 1] if i + 1 < n else blocks[i - 1]) if n > 1 else blocks[0] for i in range(n)]
    values = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0), np.min(chunks, 0)])
    return 1 / (1 + np.exp(-(values @ model.weight + model.out[0])))


def test_scores_like_plain_loops():
    """Whole texts, at the borders of blocks too; neighbours in a batch don't matter."""
    model, rnd = quality.ByteCnn(), np.random.default_rng(3)
    texts = [rnd.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 56, 57, 58, 63, 64, 65, 500, 5000)]
    assert np.allclose(model.score(texts), [plain_score(model, t) for t in texts], atol=1e-4)
    assert np.array_equal(model.score(texts), np.concatenate([model.score([t]) for t in texts]))


def test_quality_of_odd_tables(spark):
    """Other id types, repeated ids, contradicting labels, a very long text and a column of the score's name."""
    rows = [(f"d{i % 50}", ("good " if i % 2 else "bad ") * (40_000 if i == 7 else 20), "old") for i in range(60)] + [(None, None, None)]
    table = spark.createDataFrame(rows, "doc_id string, text string, score string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(50)] + [("d1", 0), ("d3", None)], "doc_id string, quality int")
    got = quality.score(table, quality.fit(table, labels))
    assert got.columns == ["doc_id", "text", "score"] and got.count() == len(rows)
    assert [r["score"] for r in got.orderBy("doc_id", "text").collect()] == [r["score"] for r in quality.score(table.repartition(7), quality.fit(table.repartition(3), labels)).orderBy("doc_id", "text").collect()]


def test_gradients():
    model = quality.ByteCnn()
    rnd = np.random.default_rng(2)
    texts, label = [rnd.integers(97, 103, n).astype(np.uint8).tobytes() for n in (300, 10, 500)], np.array([1, 0, 1], np.float32)

    def loss():
        p = model.score(texts)
        return -np.mean(np.where(label == 1, np.log(p), np.log(1 - p)))

    grads = model.gradients(texts, label)
    for value, grad in zip((model.table, model.weight, model.out), (grads[0], grads[2], grads[3]), strict=True):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        value[at] += 1e-3
        up = loss()
        value[at] -= 2e-3
        slope = (up - loss()) / 2e-3
        value[at] += 1e-3
        assert slope == pytest.approx(grad[at], rel=0.1, abs=1e-4)


def brute_runs(corpus, least):
    """Lines of later copies: by all runs of lines with enough words."""
    texts = sorted({(c[0] is not None, c[0] or 0, c[1]) for c in corpus if c[1] is not None})
    seen, gone = {}, {}
    for d, (_, _, t) in enumerate(texts):
        lines = t.split("\n")
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.encode().split()) for x in lines[i:j]) >= least:
                    run = tuple(lines[i:j])
                    if run in seen and seen[run] != (d, i):
                        gone.setdefault(t, set()).update(range(i, j)) if seen[run][0] != d else gone.setdefault((d, t), set()).update(range(i, j))
                    seen.setdefault(run, (d, i))
    return texts, gone


def test_line_dedup(spark, empty):
    rnd = random.Random(8)
    lines = [" ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(0, 30))) for _ in range(12)]
    rows = [(i, None if i == 3 else "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 25)))) for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int")
    got = {r["doc_id"]: r for r in line_dedup.remove_repeats(df).collect()}
    first, gone = {}, {i: set() for i, _ in rows}
    for i, t in rows:
        parts = [] if t is None else t.split("\n")
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                if sum(len(x.split()) for x in parts[a:b]) >= line_dedup.MIN_WORDS:
                    run = tuple(parts[a:b])
                    if first.setdefault(run, (i, a)) != (i, a):
                        gone[i] |= set(range(a, b))
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert got[i]["text"] == want and got[i]["n_removed"] == len(gone[i])
    assert line_dedup.remove_repeats(empty).count() == 0


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow")]
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q", "http://net", "x://net/", "http://mynet/a", "http://example.net/de/1#f", "http://a.example.net/en", "a://b://c/d", *[f"http://h.org/p/{i}" for i in range(30)]]
    df = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(df, rules).collect()}
    assert len(got) == len(urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(10)] == [("", "", None)] * 3 + [("a.example.net", "/en/x", "example.net/en/"), ("net", "", None), ("net", "/", "net/"), ("mynet", "/a", None), ("example.net", "/de/1", "net/"), ("a.example.net", "/en", "net/"), ("b:", "//c/d", None)]
    assert {got[i]["template"] for i in range(10, 40)} == {"/p/*"}
    assert got[3]["verdict"] == "allow" and got[5]["verdict"] == "block" and got[15]["verdict"] == "allow"
    assert url_filter.judge(df.limit(0), rules).count() == 0


def test_template_tree(spark, monkeypatch):
    """Deep paths, repeated and very long urls; sections of a large host that are blocked alone; merged branches; the same by shuffles."""
    rules = [("bad.h.org", "/", "block"), *[("h.org", f"/s{i}/", "block" if i == 3 else "allow") for i in range(0, 30, 3)]]
    urls = [f"http://h.org/s{i}/d/e/f/{k}/g/x{k % 2}" for i in range(30) for k in range(40)] + [f"http://h.org/id{i}" for i in range(300)]
    urls += ["http://h.org/" + "a/" * 30, "http://h.org/" + "b" * 100_000, *["http://bad.h.org/x"] * 5]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(df, rules).collect()
    assert len(got) == len(urls)
    said = {r["path"]: r for r in got}
    assert said["/s3/d/e/f/7/g/x1"]["verdict"] == "block" and said["/s3/d/e/f/7/g/x1"]["template"] == "/s3/d/e/f/*/g/x1"
    assert {r["verdict"] for r in got if r["host"] == "h.org" and not r["path"].startswith("/s3/")} == {"allow"}
    assert said["/id7"]["template"] == "/*" and {r["verdict"] for r in got if r["host"] == "bad.h.org"} == {"block"}
    monkeypatch.setattr(url_filter, "SMALL", 0)
    assert sorted(map(str, url_filter.judge(df, rules).collect())) == sorted(map(str, got))


def brute_components(fps, distance=2):
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= distance:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in distinct}


@pytest.mark.parametrize("crowd", [512, 3])
def test_links_and_components(spark, crowd):
    rnd = random.Random(9)
    fps = []
    for _ in range(12):
        at = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 15)):
            fps.append(at)
            at ^= 1 << rnd.randrange(64)
            at ^= rnd.choice([0, 1 << rnd.randrange(64)])
    signed = sorted({int(np.uint64(f).astype(np.int64)) for f in fps} | {0})
    scratch = Scratch(spark, "test")
    pairs = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), scratch, crowd)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want
    roots = {r["node"]: r["root"] for r in simhash.components(pairs, scratch).collect()}
    unsigned = brute_components([f & (2**64 - 1) for f in signed])
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert [g for g in groups({f: roots.get(f, f) for f in signed})] == sorted(sorted(int(np.uint64(k).astype(np.int64)) for k in unsigned if unsigned[k] == v) for v in set(unsigned.values()))


def test_fingerprints(spark, docs, corpus, empty):
    xxhash = pytest.importorskip("xxhash")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        t = next(c[1] for c in corpus if c[0] == r["doc_id"]) or ""
        w = t.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0
        assert r["fp"] & (2**64 - 1) == want
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[10] == by[9] == 9 and by[1] == by[2] == by[0] == 0
    stay = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert len(stay) == len(set(stay)) == len(set(by.values())) and 10 not in stay
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_weighted_samples(spark, docs, corpus, empty):
    got = cws.edited_fingerprints(docs).collect()
    assert len(got) == len(corpus)
    order = sorted(corpus, key=lambda c: (c[0] is None, -(c[0] or 0)))
    texts = [c[1] or "" for c in order]
    for c, t, after in zip(order, texts, [*texts[1:], texts[0]], strict=True):
        if c[0] == 5:
            continue  # a repeated row: its two copies follow each other
        r = next(r for r in got if r["doc_id"] == c[0])
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = {}
    for r in got:
        t = next(c[1] or "" for c in corpus if c[0] == r["doc_id"])
        assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == 4 * cws.SAMPLES
    assert cws.edited_fingerprints(empty).count() == 0


def test_collision_rate_is_generalised_jaccard(spark):
    rnd = random.Random(11)
    rows, want = [], []
    for i in range(60):
        a = [f"t{rnd.randrange(30)}s" for _ in range(40)]
        b = a[:20] + [f"t{rnd.randrange(30)}s" for _ in range(20)]
        rows.append((i, " ".join(a), " ".join(b)))
        ca, cb = Counter(), Counter()
        for c, terms in ((ca, a), (cb, b)):
            for t in terms:
                c[t] += len(t)
        keys = set(ca) | set(cb)
        want.append(sum(min(ca[k], cb[k]) for k in keys) / sum(max(ca[k], cb[k]) for k in keys))
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), cws.weighed(F.col(v)).alias("c")) for v in "ab"])).alias("x"))
    cells = df.select("i", "x.v", F.explode("x.c").alias("c")).select("i", "v", "c.h", F.log("c.w").alias("lw"))
    mins = cells.crossJoin(spark.range(64).withColumnRenamed("id", "k")).groupBy("i", "v", "k").agg(F.min(cws.sample(F.col("h"), F.col("lw"), F.col("k"))).alias("s"))
    agree = mins.groupBy("i", "k").agg((F.min("s") == F.max("s")).cast("int").alias("same")).agg(F.avg("same")).first()[0]
    assert agree == pytest.approx(np.mean(want), abs=0.03)


def test_columns_of_the_results_names(spark, docs):
    """Columns named as an operator's results are replaced, others stay, whatever they are called."""
    tokenizers_path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    taken = docs.selectExpr("doc_id", "text", *[f"'old' AS {c}" for c in ("n_words", "items", "spans", "n_tokens", "ids", "score", "n_lines", "n_removed", "_runs", "_text", "fp", "_k", "_id", "h", "id")])
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    found = decontaminate.find_contamination(taken, bench)
    assert found.where("size(spans) > 0 AND n_words > 0 AND items[0] = '1' AND _text = 'old'").count() == 1
    assert decontaminate.remove_spans(found).count() == docs.count()
    assert dict(bpe.encode_table(taken, tokenizers_path).dtypes)["n_tokens"] == "bigint" and bpe.encode_table(taken, tokenizers_path).where("n_tokens >= 0 AND _text = 'old'").count() == docs.count()
    cut = line_dedup.remove_repeats(taken)
    assert cut.where("n_lines >= 0 AND _runs = 'old' AND _id = 'old' AND h = 'old'").count() == docs.count()
    stay = simhash.one_of_each(taken)
    assert stay.columns == taken.columns and stay.where("fp = 'old' AND _k = 'old' AND id = 'old'").count() == stay.count() > 0


def test_tied_and_untimed_turns(spark):
    """Pieces of a conversation hold so many turns at most, also where turns have one number or none."""
    rows = [(1, None, "user" if i % 3 else "assistant", f"t{i:04}") for i in range(500)] + [(1, 7, "user" if i % 2 else "assistant", f"u{i:04}") for i in range(300)]
    done = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = done.select(chat_format.read_chat(F.col("formatted")).alias("t"), chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    want = sorted((r[1] is not None, r[1] or 0, r[2], r[3]) for r in rows)
    assert [tuple(t) for t in got["t"]] == [w[2:] for w in want] and got["loss"] == [w[3] for w in want if w[2] == "assistant"]
