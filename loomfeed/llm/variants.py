"""Spelling variants: words one edit apart, grouped without pairs.

Every word goes to the groups it can share with a near word: one wildcard group for each
of its places (the text before, a star, the text after), where words differ by a
replacement, and one group for each string it becomes by a deletion, where a shorter
word may be at home. A group keeps its size and its two most frequent words; that is all
a member needs to count its near words there and to name the most frequent one. Wildcard
groups have at most one word a letter of the alphabet and deletion groups at most that
for each place, so no group is large, whatever the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, trim

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: A form has ten times its word's count at least, and counts are below 2 ** 63: no chain of forms is longer.
CHAIN = 19


def count_words(docs: DataFrame, shortest: int = 7, least: int = 2, slips: int = 0, id_col: str = "doc_id", text_col: str = "text", most: int = 400_000) -> DataFrame:
    """word, n of the runs of letters A-Z, a-z and U+00C0-U+00FF with at least `shortest` code points and `least` occurrences; A-Z in lower case.

    slips: where it divides the crc32 of `<id>:<run>`, all occurrences of the run in that
    document lose one code point, a reproducible share of misspellings; 0 for none. Null
    texts have no words; a null id is an empty string there. Each task adds up its words,
    `most` at a time, before anything moves.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = Counter(runs.findall((t.as_py() or b"").translate(_LOWER).decode()))
                if not slips:
                    total.update(found)
                else:
                    begin = zlib.crc32(f"{i or ''}:".encode())
                    for w, n in found.items():
                        h = zlib.crc32(w.encode(), begin)
                        if not h % slips:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                            if len(w) < shortest:
                                continue
                        total[w] += n
                if len(total) >= most:
                    yield counted()
                    total.clear()
        yield counted()
        total.clear()
        trim()

    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best struct<n, word>: how many words are one edit away, and the most frequent of them (ties: the smallest).

    words: word, n, each word once. An edit inserts, deletes or replaces one code point.
    Words without near ones have n_near 0 and a null best.
    """
    w, size = F.col("word"), F.length("word")
    part = lambda i, star: F.concat(F.substring(w, F.lit(1), i - 1), F.lit(star), F.substring(w, i + 1, size))
    places = F.sequence(F.lit(1), size)
    wild, shorter = F.transform(places, lambda i: part(i, "*")), F.array_distinct(F.transform(places, lambda i: part(i, "")))
    # rows of a group: home 1 is the word that the group's key spells, home 0 its members
    groups = words.where(size > 0).select("word", "n", F.explode(F.concat(wild, shorter, F.array(w))).alias("key"))
    groups = groups.withColumn("home", (F.col("key") == w).cast("int"))
    whole = Window.partitionBy("key").orderBy("home", F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.when(F.col("home") == 0, F.struct((-F.col("n")).alias("less"), w.alias("word")))
    groups = groups.select(
        "word", "n", "key", "home",
        F.sum(1 - F.col("home")).over(whole).alias("size"),
        F.max(F.when(F.col("home") == 1, F.col("n"))).over(whole).alias("n_home"),
        F.nth_value(member, 1).over(whole).alias("first"),
        F.nth_value(member, 2).over(whole).alias("second"),
    )
    star, home = F.col("key").contains("*"), F.col("home") == 1
    near = F.when(star, F.col("size") - 1).when(home, F.col("size")).otherwise(F.col("n_home").isNotNull().cast("int"))
    best = F.when(star, F.when(F.col("first.word") == w, F.col("second")).otherwise(F.col("first"))).when(home, F.col("first"))
    best = best.otherwise(F.when(F.col("n_home").isNotNull(), F.struct((-F.col("n_home")).alias("less"), F.col("key").alias("word"))))
    found = groups.select("word", "n", "home", near.cast("long").alias("near"), best.alias("best")).where("near > 0 OR home = 1")
    out = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")))
    return out.select("word", "n", "n_near", best.alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for the words that have a form: the end of the chain of forms, its steps doubled each round."""
    reach, steps = materialise(forms.select("word", F.col("form").alias("root")), "forms"), 1
    while steps < CHAIN:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if reach.join(further, "root", "left_semi").isEmpty():
            break
        last, reach = reach, materialise(reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
        discard(last)
        steps *= 2
    return reach


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, factor: int = 10, slips: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that count_words() finds.

    form: the near word of largest n (ties: the smallest in code-point order), if that is
    at least `factor` (10 or more) times n, else null; form_n: its count; root: where the
    chain of forms ends, the word itself without one. Null and empty texts, null ids,
    repeated rows (each counts) and very long texts are as count_words() has them; an empty
    table gives no rows; other columns are ignored.
    """
    if factor < 10:
        raise ValueError("factor is at least 10")
    words = materialise(count_words(docs, shortest, least, slips, id_col, text_col), "words")
    ok = F.col("best.n") >= factor * F.col("n")
    out = materialise(near_words(words).select("word", "n", "n_near", F.when(ok, F.col("best.word")).alias("form"), F.when(ok, F.col("best.n")).alias("form_n")), "near")
    discard(words)
    roots = _roots(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql(shortest: int = 7, least: int = 2, factor: int = 10, slips: int = 31) -> str:
    """The query in SQL; crc32 goes through the text's half bytes."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    byte = "CASE WHEN unicode(s) < 128 THEN [unicode(s) & 15, unicode(s) >> 4] ELSE [(192 | (unicode(s) >> 6)) & 15, (192 | (unicode(s) >> 6)) >> 4, (128 | (unicode(s) & 63)) & 15, (128 | (unicode(s) & 63)) >> 4] END"
    return f"""
    WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]{{{shortest},}}')) AS w FROM documents),
    c AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS x, w, count(*) AS n FROM r GROUP BY ALL),
    h AS (SELECT w, n, xor(list_reduce(flatten(list_transform(string_split(x, ''), lambda s: {byte})), lambda c, b: xor(c >> 4, {table}[(xor(c, b) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM c),
    v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {slips} = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h) WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {least}),
    p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
    wild AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM p),
    cut AS (SELECT DISTINCT word, n, a || z AS s FROM wild),
    near AS (SELECT x.word, y.word AS other, y.n FROM wild x JOIN wild y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
             UNION ALL SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.s = v.word
             UNION ALL SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.s = v.word),
    best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
    top AS (SELECT near.word, min(other) AS other, any_value(most) AS most FROM near JOIN best ON near.word = best.word AND near.n = best.most GROUP BY near.word),
    f AS (SELECT v.word, v.n, CASE WHEN most >= {factor} * v.n THEN other END AS form, CASE WHEN most >= {factor} * v.n THEN most END AS form_n FROM v LEFT JOIN top USING (word)),
    chain AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, last.root, f.n, coalesce(best.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
    FROM f LEFT JOIN best USING (word) JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) AS last USING (word)"""
