import collections
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from loomfeed.llm import license_scan, lm_score, quality
from loomfeed.llm.attention import BIN, BINS, CLASSES, CONTEXT, NEW, Attention, Pass, features, windows
from loomfeed.llm.common import connected_components
from loomfeed.llm.jaccard_join import similarity_classes
from loomfeed.llm.lm_score import Scorer, _features, _id_streams, score, subwords, train_all
from loomfeed.llm.substring_dedup import remove_repeats


def words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 9), (3, 1), (20, 19), (7, 7), (None, 2)] + [(100 + i, 101 + i) for i in range(30)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {k: got[k] for k in (1, 3, 4, 5, 8, 9, 19, 20)} == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 19: 19, 20: 19}
    assert all(got[100 + i] == 100 for i in range(31)) and 7 not in got
    assert connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("width, inner, hot", [(50, 24, 2000), (10, 4, 3)])
def test_substring_equals_brute_force(docs, none, corpus, width, inner, hot):
    first = {}
    for i, t in sorted(corpus, key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - width + 1):
            first.setdefault(tuple(w[j : j + width]), i)
    out = remove_repeats(docs, width, inner, hot)
    assert set(docs.columns) < set(out.columns)
    got = {r.doc_id: r.cut for r in out.collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone[j : j + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (got[i].n_words, got[i].n_removed, got[i].kept.encode()) == (len(w), len(w) - len(kept), b" ".join(kept)), i
    assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("percent, hot", [(85, 400), (50, 3)])
def test_jaccard_equals_brute_force(docs, none, corpus, percent, hot):
    sets = {}
    for i, t in corpus:
        w = words(t, True)
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(docs, 4, percent, hot).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert similarity_classes(none).count() == 0


def test_jaccard_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, None), (3, 0, 3)], key=str)


def test_license_scan(spark, docs, none):
    mit = dict(license_scan.TEMPLATES)["mit-permission"]
    cut = mit.split()
    rows = [(1, "x y z " * 30 + mit + " tail " * 20), (2, " ".join(cut[: len(cut) * 9 // 10])), (3, " ".join(cut[: len(cut) // 2])), (4, "RELEASED under the MIT license. and Licensed under CC BY-NC 4.0."), (4, "RELEASED under the MIT license. and Licensed under CC BY-NC 4.0."), (5, None), (6, "the MIT License."), (None, mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = sorted(tuple(r) for r in license_scan.scan(df).select("doc_id", "license", "containment", "start_word").collect())
    c = duckdb.connect()
    t = df.toPandas()
    t["doc_id"] = t["doc_id"].astype("Int64")
    c.register("documents", t)
    assert got == sorted(c.execute(f"SELECT doc_id, license, containment, start_word FROM ({license_scan.oracle_sql()}) t").fetchall())
    assert {(r[0], r[1]) for r in got} == {(1, "mit-permission"), (2, "mit-permission"), (4, "mit"), (4, "cc-by-nc-4.0")}
    assert license_scan.scan(none).count() == 0


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over bytes, one look-up at a time."""

    def __init__(self, texts, order=5):
        self.c = {order: collections.Counter()}
        for t in texts:
            b = b"\n" * (order - 1) + t.encode()
            for i in range(order - 1, len(b)):
                self.c[order][b[i - order + 1 : i + 1]] += 1
        for k in range(order - 1, 0, -1):
            self.c[k] = collections.Counter(g[1:] for g in self.c[k + 1])
        self.order, self.d, self.sums = order, {}, {}
        for k, c in self.c.items():
            n = collections.Counter(c.values())
            plain = [0, 0.5, 0.75, 0.9]
            if n[1] and n[2] and n[3]:
                y = n[1] / (n[1] + 2 * n[2])
                plain = [0] + [min(max(m - (m + 1) * y * n[m + 1] / n[m], 0.1), m - 0.05) for m in (1, 2, 3)]
            self.d[k] = plain
            for g, x in c.items():
                total = self.sums.setdefault((k, g[:-1]), [0, 0])
                total[0] += x
                total[1] += plain[min(x, 3)]

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / 256
        total = self.sums.get((k, g[:-1]))
        if not total:
            return self.p(g[1:])
        x = self.c[k][g]
        return (x - self.d[k][min(x, 3)]) / total[0] + total[1] / total[0] * self.p(g[1:])

    def nats(self, text):
        b = b"\n" * (self.order - 1) + text.encode()
        return -sum(math.log(self.p(b[i - self.order + 1 : i + 1])) for i in range(self.order - 1, len(b)))


def test_quality_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    clean = lambda n: " ".join(rng.choice(["the", "of", "reading", "water", "goes", "under", "bridge", "and"], n))
    autre = lambda n: " ".join(rng.choice(["le", "pont", "dans", "été", "lire", "eau"], n))
    rows = [(i, clean(60), "en") for i in range(60)] + [(100 + i, autre(60), "fr") for i in range(30)]
    rows += [(200 + i, "".join(map(chr, rng.integers(33, 126, 400))), ("en", "fr", None)[i % 3]) for i in range(9)]
    rows += [(300, None, "en"), (301, "", None), (302, clean(50), None), (303, clean(3), "xx"), (304, clean(3000), "en"), (304, clean(3000), "en"), (None, clean(20), "en"), (305, rows[3][1], "en"), (306, "x" * 20000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"quality": F.lit(1), "block": F.lit("b"), "row": F.lit(2.5), "kept": F.lit(None).cast("string")})
    good = [i for i in (*range(50), *range(100, 125))]
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(200, 0, 0), (201, 1, 1), (None, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    quantile = {"en": 0.97, quality.ANY: 1.0}
    got = quality.classify(docs, labels, quantile=quantile, block_bytes=9000, out_col="made").collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {*docs.columns, "made"} and all(r.row == 2.5 and r.block == "b" for r in got)
    text = {i: t for i, t, _ in rows}
    models = {"en": PlainKneserNey(text[i] for i in good if i < 100), "fr": PlainKneserNey(text[i] for i in good if i >= 100), "": PlainKneserNey(text[i] for i in good)}
    limit = {}
    for lang, m in models.items():
        own = [(m.nats(text[i]), len(text[i].encode())) for i in good if not lang or (i < 100) == (lang == "en")]
        mean = sum(x for x, _ in own) / sum(n for _, n in own)
        x = sorted((x + 200 * mean) / (n + 200) for x, n in own)
        limit[lang] = mean, x[math.ceil(quantile.get(lang, 1.0) * len(x)) - 1]
    for r in got:
        lang = r.lang if r.lang in models else ""
        mean, most = limit[lang]
        assert abs(r.made.threshold - math.exp(most)) < 1e-4
        if not r.text:
            assert r.made.perplexity is None and r.made.kept
            continue
        n, nats = len(r.text.encode()), models[lang].nats(r.text)
        assert r.made.n_bytes == n and abs(r.made.perplexity / math.exp(nats / n) - 1) < 1e-4, r
        x = (nats + 200 * mean) / (n + 200)
        assert abs(x - most) < 1e-5 or r.made.kept == (x <= most), r
    assert not any(r.made.kept for r in got if r.doc_id and 200 <= r.doc_id < 300) and sum(r.made.kept for r in got) >= 95
    assert quality.classify(docs.limit(0), labels, out_col="made").count() == 0
    assert all(r.made.kept for r in quality.classify(docs, labels.limit(0), out_col="made").collect())


def test_quality_error_rates(spark):
    """By the quantile alone some two in a thousand trusted documents may go; of those with quality 0 hardly any stays."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id", "left_semi")
    got = quality.classify(known, labels, out_col="made").join(labels, "doc_id").select("quality", "toxic", "made.kept", "made.perplexity").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.toxic and r.perplexity is not None]
    bad = [r.kept for r in got if r.quality == 0 and r.perplexity is not None]
    assert len(good) > 2000 and good.count(False) <= 0.003 * len(good)
    assert len(bad) > 400 and bad.count(True) <= 0.03 * len(bad)


@pytest.mark.parametrize("ids", [1_000_000, 300])
def test_quality_counts_come_from_all_trusted_rows(spark, monkeypatch, ids):
    """3000 documents of a language, some of them with a word of their own; ids are broadcast in one part or in ten."""
    monkeypatch.setattr(quality, "IDS", ids)
    held = []
    monkeypatch.setattr(quality, "kneser_ney", lambda counts, plain=quality.kneser_ney: held.extend(counts.collect()) or plain(counts))
    rows = [(i, f"the water {i:04d}" if i % 3 else None if i % 2 else "", "en") for i in range(3000)] + [(3000 + i, "le pont", "fr") for i in range(5)] + [(1, "das Wasser", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    quality.decisions(docs, spark.range(3004).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    got = {(r.model, r.gram): r.c for r in held}
    want = collections.Counter()
    for i, text, lang in rows:
        if text and i < 3004:
            b = b"\n" * 4 + text.encode()
            for j in range(5, len(b) + 1):
                g = int.from_bytes(b[j - 5 : j], "big")
                want[lang, g] += 1
                want["", g] += 1
    assert got == want


def test_quality_sample_is_bounded_and_probabilities_sum_to_one(spark):
    counts = spark.createDataFrame([("a", int.from_bytes(bytes(b"\n\n\n\nabracadabra banana"[i : i + 5]), "big"), 1 + i % 3) for i in range(18)], "model string, gram long, c long")
    rows = quality.kneser_ney(counts).collect()
    p = {(r.k, r.gram): r.p for r in rows if r.p is not None}
    w = {(r.k, r.gram): r.weight for r in rows if r.p is None}

    def prob(k, g):
        if not k:
            return 1 / 256
        mask = (1 << 8 * (k - 1)) - 1
        return p[k, g] if (k, g) in p else w.get((k, g >> 8), 1.0) * prob(k - 1, g & mask)

    for context in (b"abra", b"nana", b"zzzz", b"zbra"):
        base = int.from_bytes(context, "big") << 8
        assert abs(sum(prob(5, base | i) for i in range(256)) - 1) < 1e-9


def test_attention_gradients_and_windows():
    rng = np.random.default_rng(0)
    n = 30
    model = Attention(n, rng.integers(-1, CLASSES, n), np.ones(CLASSES))
    ids = [rng.integers(0, n, k).astype(np.int32) for k in (1, NEW, 2 * NEW + 3)]
    w, real = windows(ids, 0, model.pad)
    assert w.shape[1] == CONTEXT + NEW and real.sum() == sum(map(len, ids))
    assert (w[:, CONTEXT:][real] == np.concatenate(ids)).all()
    # the batched windows equal one place at a time
    lp = model.log_p(w)
    i, t = next((i, t) for i, t in zip(*np.nonzero(real), strict=True) if i == len(w) - 2 and model.class_of[w[i, CONTEXT + t]] >= 0)
    assert (lp[model.class_of[w[:, CONTEXT:]] < 0] == 0).all()
    x = model.E[w[i, :-1]] + model.P
    q = x[CONTEXT - 1 + t] @ model.Wq / np.sqrt(model.E.shape[1])
    s = np.array([q @ (x[k] @ model.Wk) if k <= CONTEXT - 1 + t and w[i, k] != model.pad else -np.inf for k in range(len(x))])
    a = np.exp(s - s.max())
    h = x[CONTEXT - 1 + t] + (a / a.sum()) @ (x @ model.Wv) @ model.Wo
    z = h @ model.Wc + model.b
    want = z[model.class_of[w[i, CONTEXT + t]]] - np.log(np.exp(z).sum())
    assert abs(lp[i, t] - want) < 1e-4
    grads = model._gradients(w)
    loss = lambda: -model.log_p(w)[model.class_of[w[:, CONTEXT:]] >= 0].mean()
    for name in ("Wq", "Wk", "Wv", "Wo", "Wc", "P"):
        p = getattr(model, name)
        at = (3, 2)
        old = p[at]
        p[at] = old + 0.02
        up = loss()
        p[at] = old - 0.02
        down = loss()
        p[at] = old
        assert abs((up - down) / 0.04 - grads[name][at]) < 2e-3, name
    before = loss()
    model.train(w, 60)
    assert loss() < before - 0.3


def test_mixture_is_a_probability():
    # words a a a b c c of two classes, of which b occurred once
    s = Scorer(None, 6, 3, 1, np.array([4.0, 2.0]), 0.6)
    att = np.log(np.array([0.7 / 4, 0.7 / 4, 0.3 / 2, 1.0]))
    a, b, c, unknown = 10 ** s.mixed(np.array([3.0, 1.0, 2.0, 0.0]), att)
    assert math.isclose(unknown, 2 / 10) and math.isclose(a + b + c + unknown, 1) and math.isclose(a, 0.8 * (0.6 * 3 / 6 + 0.4 * 0.7 * 3 / 4))


def test_score_of_held_out_texts_is_above_the_base(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: r for r in score(docs, *args, block_bytes=200_000).collect()}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores(docs, none, corpus):
    counts = collections.Counter()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in corpus}
    for i, t in corpus:
        if not held[i]:
            counts.update([*words(t, True), None])
    n, v = sum(counts.values()), len(counts)
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = score(docs, *args, sample=40, steps=60, block_bytes=20_000).collect()
    assert len(got) == len(corpus)
    texts = dict(corpus)
    for r in got:
        w = [*words(texts[r.doc_id], True), None]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and -1e6 < r.score < 0 and (r.n_tokens > 1 or r.n_known == 1)
    assert score(none, *args).count() == 0


def test_attention_learns_from_every_training_window(spark, docs, corpus):
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    sub = subwords(*args)
    rows = docs.selectExpr("coalesce(text, '') AS text", "doc_id % 10 > 0 AS kept").repartition(5)
    streams = _id_streams(rows, *args)
    texts = {i: np.concatenate([np.frombuffer(sub[w], np.int32) for w in words(t, True)] + [np.frombuffer(sub.tail, np.int32)]) for i, t in corpus}
    top = np.array([sub.end, 17, 300])
    assert (_features(streams, top, sub.size) == sum(features([x], top, sub.size) for x in texts.values())).all()
    model = Attention(sub.size, np.where(sub.begins, np.random.default_rng(1).integers(0, CLASSES, sub.size), -1), np.ones(CLASSES))
    before = model.Wc.copy()
    kept = [texts[i] for i in texts if i % 10]
    w, real = windows(kept, sub.end, model.pad)
    real = model.class_of[w[:, CONTEXT:]] >= 0
    loss = -model.log_p(w)[real].mean()
    assert train_all(model, streams.where("kept"), sub.end) == len(w)  # the text of 6000 words too, to its end
    assert (model.Wc != before).any()
    assert -model.log_p(w)[real].mean() < loss


def test_every_window_trains_every_weight(spark):
    """The mean of the tasks' copies: each row of the embedding by how often a task saw its id, the rest by windows; nothing is kept back."""
    sub = subwords(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(4)
    model = Attention(sub.size, np.where(sub.begins, rng.integers(0, CLASSES, sub.size), -1), np.ones(CLASSES))
    start = {k: getattr(model, k).copy() for k in model.NAMES}
    ids = [rng.choice([5, 17, 300, 301, 400 + 50 * i, sub.end], 4000).astype(np.int32) for i in range(3)]
    alone = [Pass(model) for _ in ids]
    for over, x in zip(alone, ids):
        over.add(windows([x], sub.end, model.pad)[0])
        over.close()
    several = spark.createDataFrame(spark.sparkContext.parallelize([(bytearray(x.tobytes()), True) for x in ids], 3), "ids binary, kept boolean")
    n, ratios = lm_score._trained(model, several, sub.end)
    assert n == sum(o.windows for o in alone) == 750
    apart = ratios - sum(o.ratios for o in alone)  # rounding may put some into the next bin
    assert np.abs(apart).sum() <= 0.01 * ratios.sum() and np.abs(np.cumsum(apart)).max() <= 0.01 * ratios.sum()
    assert ratios.sum() == sum((model.class_of[x] >= 0).sum() for x in ids)
    for k in model.NAMES:
        assert (getattr(model, k) != start[k]).any(), k
        if k != "E":
            assert np.allclose(getattr(model, k), sum(getattr(o.model, k) for o in alone) / 3, atol=1e-5), k
    seen = sum(o.seen for o in alone)
    want = sum(o.seen[:, None] * o.model.E for o in alone) / np.maximum(seen, 1)[:, None]
    assert np.allclose(model.E[seen > 0], want[seen > 0], atol=1e-5) and (model.E[seen == 0] == start["E"][seen == 0]).all()


def test_summed_gradients_are_those_of_the_plain_pass():
    rng = np.random.default_rng(6)
    model = Attention(40, np.where(np.arange(40) % 3 > 0, np.arange(40) % CLASSES, -1), np.arange(1.0, CLASSES + 1))
    w, _ = windows([rng.integers(0, 40, n).astype(np.int32) for n in (3, 100, 17)], 0, 40)
    g, seen, dx = model._parts(w)
    sums, ids, rows, ratio = model.sums(w)
    real = model.class_of[w[:, CONTEXT:]] >= 0
    assert (ids == seen).all() and len(ratio) == real.sum() and np.allclose(rows / len(ratio), dx, atol=1e-6)
    assert all(np.allclose(sums[k] / len(ratio), g[k], atol=1e-6) for k in g)
    assert np.allclose(ratio, (model.log_p(w) - model.prior[model.class_of[w[:, CONTEXT:]]])[real], atol=1e-4)


def test_words_encoded_together_are_encoded_alone():
    sub = lm_score.Subwords(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(8)
    odd = ["it's", "\u3000a", "b\x85", "'s", "12", "é日", "...", "x" * 70, "\x1cq", "a\u2009b", "<|endoftext|>", "_", "\x00"]
    many = ["".join(rng.choice(list("abcdeinorst.,'1é日-"), rng.integers(1, 12))) for _ in range(3000)]
    for part in (many, odd, [*many[:20], *odd], [" "], ["a", " ", "b"], []):
        part = [w.encode() for w in part]
        alone = [np.frombuffer(lm_score.Subwords.__missing__(sub, w), np.int32) for w in part]
        flat, sizes = sub.encoded(part)
        assert sizes.tolist() == list(map(len, alone)) and flat.tolist() == [i for x in alone for i in x]
    assert list(lm_score._runs([3, 1, 5, 0, 9], 5)) == [(0, 3), (3, 5)] and list(lm_score._runs([], 5)) == [] and list(lm_score._runs([9, 1], 5)) == [(0, 1), (1, 2)]


def test_attention_is_reckoned_where_a_word_begins():
    """No query is made at places whose next id begins no word, and windows without one need none."""
    rng = np.random.default_rng(11)
    model = Attention(40, np.where(np.arange(40) % 3 == 0, np.arange(40) % CLASSES, -1), np.ones(CLASSES))
    w, _ = windows([rng.integers(0, 40, n).astype(np.int32) for n in (3, 100, 17)] + [np.full(5, 1, np.int32)], 0, 40)
    used = (model.class_of[w[:, CONTEXT:]] >= 0).sum(1)
    of, slot, before, x, q, s, mean = model._attended(w, model._folded()[0])
    assert s.shape == (len(w), used.max(), CONTEXT + NEW - 1) and 0 < used.max() < NEW and used[-1] == 0
    assert len(of) == len(slot) == len(before) == len(mean) == used.sum() and (used == model._used(w)).all()
    assert np.allclose(s.reshape(-1, s.shape[2])[slot].sum(1), 1) and len(set(slot.tolist())) == len(slot)
    for part in (w[:0], w[-1:]):
        g, seen, dx, ratio = model.sums(part)
        assert len(ratio) == 0 and dx.shape == (seen.size, model.E.shape[1]) and not dx.any() and not any(a.any() for a in g.values())
        assert not model.log_p(part).any()


def test_each_word_is_counted_and_encoded_once_in_the_corpus(spark):
    """Words of several blocks, tasks and parts come back with the corpus's count and ids, in the order of their numbers; no text is lost."""
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    sub = subwords(*args)
    texts = ["", " \t ", "A b a", "\x0bb  c\u3000d\x85 \x1c", "é É b\n", *(f"w{i % 7} x{i} {'long' * (i % 40)} a" for i in range(60))]
    rows = spark.createDataFrame([(i, t, i % 3 > 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean").repartition(3)
    dealt = lm_score._dealt(rows.selectExpr("CAST(spark_partition_id() AS LONG) AS task", "*"), 5, 500).cache()
    assert dealt.where("part IS NULL").select("block").distinct().count() > 3 and dealt.selectExpr("max(part) - min(part)").first()[0] == 4
    counted = lm_score._counted(dealt.where("part IS NOT NULL"), *args).cache()
    want = collections.Counter(x for i, t in enumerate(texts) if i % 3 for x in [*words(t, True), None])
    total, distinct = sum(want.values()), len(want)
    got = counted.selectExpr("sum(total)", "sum(distinct)", "sum(single)", "count(total)", "count(DISTINCT part)").first()
    assert tuple(got) == (total, distinct, sum(x == 1 for x in want.values()), 5, 5)
    begun = collections.Counter(int(np.frombuffer(sub[w] if w else sub.tail, np.int32)[0]) for w in want.elements())
    assert {r.id: r.c for r in counted.selectExpr("inline(begun)").groupBy("id").agg(F.sum("c").alias("c")).collect()} == begun
    out = {r.doc_id: r for r in lm_score._streams(dealt.where("part IS NULL"), counted, total, distinct).collect()}
    assert sorted(out) == list(range(len(texts)))
    for i, t in enumerate(texts):
        own = [*words(t, True), None]
        ids = [np.frombuffer(sub[w] if w else sub.tail, np.int32) for w in own]
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train) == (len(own), sum(want[w] > 0 for w in own), i % 3 > 0)
        assert np.frombuffer(r.ids, np.int32).tolist() == np.concatenate(ids).tolist()
        assert lm_score._thick(r.sizes, len(own)).tolist() == list(map(len, ids)) and lm_score._thick(r.counts, len(own)).tolist() == [want[w] for w in own]
        assert math.isclose(r.base_score, sum(math.log10((want[w] + 1) / (total + distinct + 1)) for w in own))


def test_numbers_are_packed_whole():
    for a in ([], [0], [65535, 0], [65536, 3], [2**24 - 1, 2**24, 2**31 - 1]):
        a = np.array(a, np.int32)
        assert lm_score._whole(lm_score._halves(a), len(a)).tolist() == lm_score._thick(lm_score._thin(a), len(a)).tolist() == a.tolist()
    assert len(lm_score._halves(np.arange(70_000))) == 210_000


def test_weight_from_ratios():
    s = Scorer(None, 6, 3, 1, np.ones(2))
    ratios = np.zeros(BINS)
    ratios[BINS // 2 + 60] = 30  # a class is some e**3 times likelier than by counts
    ratios[BINS // 2 - 100] = 70  # or e**-5
    s.fit_weight(ratios, 500)
    a, b = math.exp(60.5 * BIN), math.exp(-99.5 * BIN)
    grid = np.linspace(0.01, 0.99, 9801)
    best = grid[np.argmax(30 * np.log(grid + (1 - grid) * a) + 70 * np.log(grid + (1 - grid) * b))]
    assert abs(s.weight - best) < 1e-3


def test_pass_uses_each_window_once():
    w, _ = windows([np.arange(NEW * 50, dtype=np.int32) % 30], 0, 30)
    over = Pass(Attention(30, np.arange(30) % CLASSES, np.ones(CLASSES)), batch=16)
    over.add(w[:23])
    over.add(w[23:])
    assert over.windows == 48 and len(over.rest) == 2
    over.close()
    assert over.windows == 50 and over.steps == 4


def test_attention_has_all_its_classes():
    assert CLASSES == 96
