import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomfeed.llm import alignment
from loomfeed.llm.alignment import align_tokenizers, best_partners

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [(200, "<s> a</s>  b"), (201, "<|endoftext|> x <|endoftext|>"), (202, "▁ a ▁b"), (203, " lead"), (204, "trail "), (205, "a\n b\n\n c  d"), (206, "x" * 3000), (207, "a b"), (208, "'s don't 1 2  3"), (209, "ﬁ ① Å é ​ zero"), (210, "\x00 nul\x1f x"), (None, "same text"), (0, "same text"), (211, "👩‍👩‍👧 emoji 日本語テキスト"), (212, "\n"), (213, " "), (214, "the the the the")]


def plain(rows):
    """The contract, a document at a time."""
    tk, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tk.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    piece_a = {i: bytes(byte[c] for c in t) for t, i in tk.get_vocab(with_added_tokens=False).items()}
    docs, counts = [], Counter()
    for i, t in rows:
        t = t or ""
        a = tk.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        bytes_a, bytes_b = [piece_a[x] for x in a], [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            docs.append((i, [], [], [], ""))
            continue
        span_a, span_b = ([(sum(map(len, x[:k])), sum(map(len, x[: k + 1]))) for k in range(len(x))] if len(x) < 400 else list(zip(np.cumsum([0, *map(len, x)])[:-1].tolist(), np.cumsum(list(map(len, x))).tolist())) for x in (bytes_a, bytes_b))
        ends_b = {y for _, y in span_b}
        links, j = [], 0
        for x, (lo, hi) in zip(a, span_a):
            while span_b[j][1] <= lo:
                j += 1
            k = j
            while k < len(b) and span_b[k][0] < hi:
                links.append((x, b[k]))
                k += 1
        text, start_a, start_b = [], 0, 0
        for k, (_, hi) in enumerate(span_a):
            if hi in ends_b:
                m = next(m for m in range(start_b, len(b)) if span_b[m][1] == hi)
                text.append(",".join(map(str, a[start_a : k + 1])) + "|" + ",".join(map(str, b[start_b : m + 1])))
                start_a, start_b = k + 1, m + 1
        docs.append((i, a, b, links, ";".join(text)))
        counts.update(set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = [(i, len(a), len(b), text.count(";") + bool(text), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "") for i, a, b, links, text in docs]
    return out, {(x, y, n) for (x, y), n in counts.items() if n == most[x]}


@pytest.fixture(scope="module")
def rows(corpus):
    return [*corpus, *ODD]


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, block string, place int, n_a int").repartition(3)


@pytest.mark.parametrize("block,fan", [(4 << 20, 512), (3000, 2)])
def test_alignment_equals_a_plain_loop(odd, rows, block, fan):
    got = sorted((tuple(r) for r in align_tokenizers(odd, A, B, block_bytes=block, fan=fan).collect()), key=repr)
    assert got == sorted(plain(rows)[0], key=repr)
    assert sum(r[1] == 0 for r in got) >= 3


def test_best_partners(odd, rows):
    got = [tuple(r) for r in best_partners(odd, A, B).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)[1]


def test_frequent_parts_are_split_into_entries(rows, monkeypatch):
    pair = alignment.Pair(A, B)
    texts = [t or "" for _, t in rows][:60] + ["the the of " * 50]

    def links(many):
        monkeypatch.setattr(alignment, "MANY", many)
        return [(s, n, *map(bytes, x)) for s, n, *x in alignment._block(texts, pair, 7)[2]]

    assert links(24) == links(7)


def test_parts_are_whole_texts_for_tokenizers_that_do_not_split(rows):
    pair = alignment.Pair(A, B)
    texts = [t or "" for _, t in rows][:100] + [t for _, t in ODD]
    want = alignment._block(texts, pair, 5)
    pair.split = False
    got = alignment._block(texts, pair, 5)
    assert all((x == y).all() for x, y in zip(got[0], want[0])) and got[1:] == want[1:]


def test_empty_tables(odd):
    assert align_tokenizers(odd.limit(0), A, B).count() == 0
    nothing = align_tokenizers(odd.where("text IS NULL OR text = ''"), A, B).collect()
    assert nothing and all(r.n_a == r.n_links == r.count_sum == 0 and r.groups_sha256 == "" for r in nothing)
