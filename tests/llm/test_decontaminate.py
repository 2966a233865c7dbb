import random
import re

import pytest

from loomfeed.llm.decontaminate import build_index, decontaminate, find

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RNG = random.Random(3)
SIZE = 4


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(n, k=12):
    return " ".join(RNG.choice("ab") * 2 + str(RNG.randrange(k)) for _ in range(n))


COMMON = prose(9, 3)
ITEMS = [(i, prose(RNG.randrange(3, 9), 3)) for i in range(30)] + [(40, "Bb1"), (41, "aa1, BB2!"), (42, None), (43, ""), (44, "-- ,"), (45, COMMON), (45, "zz zz"), (46, COMMON), (None, "yy yy yy"), (47, "no such words here at all"), (48, "Ñandú é-日本 x\x85y")]
DOCS = [(i, prose(RNG.randrange(0, 60), 3)) for i in range(60)] + [(70, None), (71, ""), (72, "?"), (73, COMMON.upper() + " zz  zz\tyy yy yy ñandú Ñandú é日本 日本 x\x85y"), (73, COMMON), (None, COMMON), (74, f"{prose(5)}. {COMMON}; {prose(4000, 3)}"), (75, "zz ZZ zz"), (76, "Ñandú É 日本 x\x85y Ñandú é 日本 x\x85y"), (77, "bb1")]


def windows(text):
    w = split(text)
    return [tuple(w[k : k + SIZE]) for k in range(max(len(w) - SIZE, 0) + 1)] if w else []


def brute(text, slop):
    """(words hit by phrases, items of phrases, items of proximity matches)."""
    w = split(text)
    hit, items, near = set(), set(), set()
    for name, t in ITEMS:
        for x in windows(t):
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    items.add(str(name) if name is not None else None)
            for k in range(-slop, len(w)):
                if all(any(w[p] == c for p in range(max(k + j, 0), min(k + j + slop + 1, len(w)))) for j, c in enumerate(x)):
                    near.add(str(name) if name is not None else None)
    return hit, sorted(items - {None}), sorted(near - {None})


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, segment string, n_words int").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, n_words int")
    return docs, items


@pytest.mark.parametrize("slop", [0, 2])
@pytest.mark.parametrize("segment,chunk", [(8 << 20, 16 << 20), (900, 16 << 20), (2000, 400)])
def test_phrases_and_proximity_equal_brute_force(tables, slop, segment, chunk):
    docs, items = tables
    index = build_index(docs, segment_bytes=segment)
    got = find(index, items, SIZE, slop, chunk_bytes=chunk).collect()
    want = []
    for i, t in DOCS:
        hit, names, near = brute(t, slop)
        want.append((i, len(split(t)), len(hit), sorted(hit), names, near))
    have = [(r.doc_id, r.n_words, r.n_hit, [p for s in r.spans for p in range(s.start, s.end)], r["items"], r.near_items) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))
    if slop == 0:
        assert all(r.spans == r.near_spans for r in got)


def test_the_index_holds_every_place(tables):
    docs, _ = tables
    n = sum(len(split(t)) for _, t in DOCS)
    rows = build_index(docs, segment_bytes=2000).collect()
    assert len(rows) > 5 and len({r.segment for r in rows}) == len(rows)
    assert sum(len(r.postings) // 4 for r in rows) == n and sum(len(r.ids) for r in rows) == len(DOCS)


def test_empty_tables(tables):
    docs, items = tables
    assert decontaminate(docs.limit(0), items).count() == 0
    clean = decontaminate(docs, items.limit(0)).collect()
    assert len(clean) == len(DOCS) and not any(r.n_hit or r.spans or r["items"] for r in clean)
    assert not any(r.n_hit for r in decontaminate(docs, items.where("text IS NULL")).collect())


def test_query_digest_of_items(spark):
    from loomfeed.llm.queries import op13_benchmark_decontamination, oracle_sql

    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = op13_benchmark_decontamination(spark, d)
    cur = con.execute(oracle_sql()["op13_benchmark_decontamination"])
    assert [c[0] for c in cur.description] == df.columns
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(cur.fetchall()) and any(r[2] for r in got)
