"""The pipeline against brute force, stage by stage, each on its own input."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(0)
    junk = [(1000 + i, "".join(map(chr, rng.integers(33, 126, 300))), "en", "s", 300) for i in range(5)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = docs.select(cols).unionByName(spark.createDataFrame(junk, kind))
    # columns that are called what the stages call theirs
    rows = rows.withColumns({"quality": F.lit("q"), "cut": F.col("doc_id"), "row": F.lit(1), "key": F.lit(2.5), "made": F.lit(True), "text_digest": F.lit("t"), "component_id": F.lit(7), "rid": F.lit(None).cast("long")})
    rows.write.parquet(f"{d}/documents.parquet")
    docs.where("doc_id < 95").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{d}/labels.parquet")
    return str(d)


def words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def shingles(t):
    w = words(t, True)
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 3:
            assert seen[-1].columns == docs.columns
    before, quality, unique, cut = ({r.doc_id: r for r in x.collect()} for x in seen[:4])
    assert set(before) - set(quality) >= set(range(1000, 1005)) and set(range(95)) <= set(quality)
    assert all(quality[i] == before[i] for i in quality)

    sets = {i: shingles(r.text) for i, r in quality.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(unique) == {i for i in sets if find(i) == i}
    assert all(unique[i] == quality[i] for i in unique)

    first = {}
    for i in sorted(unique):
        w = words(unique[i].text)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    assert set(cut) == set(unique)
    for i, r in unique.items():
        w = words(r.text)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        want = r.text if not any(gone) else b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        assert cut[i].text == want and (cut[i].n_chars == (len(want) if any(gone) else r.n_chars))

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tk.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in cut.values())
    assert seen[4].agg(F.sum("length")).first()[0] == total
    assert corpus_pipeline.ORACLE_SQL is None
    # run() is the stages one after the other
    piece = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert piece(corpus_pipeline.run(spark, sf_dir)) == piece(seen[4])


def test_stages_on_few_columns_and_repeated_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "another text of six words"), (2, text), (3, None), (None, text)], "doc_id long, text string")
    unique = corpus_pipeline.jaccard_join(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in unique.collect()), key=str) == sorted([(1, text), (1, "another text of six words"), (3, None), (None, text)], key=str)
    cut = corpus_pipeline.substring_dedup(spark, docs, "")
    assert cut.columns == docs.columns and sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted([(1, text), (1, text), (1, "another text of six words"), (2, ""), (3, None), (None, text)], key=str)
