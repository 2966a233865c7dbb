import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomfeed.llm import bpe
from loomfeed.llm.bpe import Codec, encode_digests, encode_documents, merge_ids
from loomfeed.llm.packing import best_fit_plan, pack
from loomfeed.llm.token_count import count_tokens

RANKS, MODEL, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
ODD = [(200, "<s> a</s>  b"), (201, "<|endoftext|> x"), (202, "▁ a ▁b"), (203, " lead"), (204, "trail "), (205, "a\n b\n\n c  d"), (206, "x" * 3000), (207, "a b"), (208, "'s don't 1 2  3")]


@pytest.fixture(scope="module")
def enc():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd(spark, docs):
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))


def test_counts_equal_the_library_and_the_cache_is_used(spark, odd, corpus, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    cache = str(tmp_path / "cache")
    texts = dict([*corpus, *ODD])
    for _ in range(2):
        got = count_tokens(odd, MODEL, cache, limit=100).collect()
        assert len(got) == len(texts)
        for r in got:
            t = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 100)
        rows = spark.read.parquet(cache)
        assert rows.count() == rows.select("digest").distinct().count() == len({t or "" for t in texts.values()})


def test_counts_of_other_tokenizers_and_empty_tables(odd, none, corpus):
    tk = Tokenizer.from_file(JSON)
    texts = dict([*corpus, *ODD])
    assert all(r.n_tokens == len(tk.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in count_tokens(odd, JSON).collect())
    assert count_tokens(none, MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_segment_tree_merges_as_a_plain_loop(data):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"aa": 257, b"abab": 258, b"ba": 259, b"\0\0": 260, b"aab": 261, b"\0\0\0\0": 262}
    parts = [data[i : i + 1] for i in range(len(data))]
    if data not in ranks:
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    else:
        parts = [data]
    assert merge_ids(data, ranks) == [ranks[p] for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  \n\t'sé日1.\x1c\x85 　"), max_size=40))
def test_encoding_equals_the_library(text):
    enc = _enc()
    assert _codec().encode(text) == np.array(enc.encode_ordinary(text), "<u4").tobytes()


def test_matches_are_merged_once(monkeypatch):
    asked = []
    monkeypatch.setattr(bpe, "merge_ids", lambda part, ranks: asked.append(part) or merge_ids(part, ranks))
    text = " ".join(["Xqzwj xqzwj,", "xqzwj.\nxqzwj", "xqzwj\nqqz", "xqzwj, qqz. xqzwj."] * 3)
    want = np.array(_enc().encode_ordinary(text), "<u4").tobytes()
    assert Codec(RANKS, P.PATTERN).encode(text) == want
    assert len(asked) == len(set(asked))
    small = Codec(RANKS, P.PATTERN, bound=3)  # what is known is put aside again and again
    assert [small.encode(text) for _ in range(3)] == [want] * 3 and len(small.matches) <= 3 and len(small.matches.older) <= 3


_held = {}


def _codec():
    if "c" not in _held:
        _held["c"] = Codec(RANKS, P.PATTERN)
    return _held["c"]


def _enc():
    if "e" not in _held:
        with open(RANKS, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _held["e"] = tiktoken.Encoding("own2", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _held["e"]


def test_digests_round_trip(odd, none, corpus, enc):
    texts = dict([*corpus, *ODD])
    for r in encode_digests(odd, RANKS, P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert encode_digests(none, RANKS, P.PATTERN).count() == 0
    assert encode_documents(odd, RANKS, P.PATTERN).count() == len(texts)


def test_packing(odd, none, corpus):
    tk = Tokenizer.from_file(JSON)
    texts = dict([*corpus, *ODD])
    rows = pack(odd, JSON, size=128, per_group=20).collect()
    total, by_doc, by_seq = 0, {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length <= 128 and (k == 0 or r.length == 128)
            at += r.length
        assert at == len(ids) and (len(ids) > 128 or len(by_doc[i]) == 1)
    for part in by_seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert len(by_seq) <= 1.03 * total / 128 + 3
    assert pack(none, JSON).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 50), max_size=10))
def test_plan_places_every_item_once(counts):
    used, seen = {}, {}
    for length, first, n, seq, offset in best_fit_plan(counts, 16):
        for k in range(n):
            seen.setdefault(length, set()).add(first + k)
            used.setdefault(seq + k, []).append((offset, length))
    assert {k: len(v) for k, v in seen.items()} == counts
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
