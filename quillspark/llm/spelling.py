"""Spelling variants: words one edit apart, and the form that each rarer spelling stands for.

Two words are near if one code point inserted, deleted or replaced makes them equal. Of words s and t, with s not the
longer one, all but Q positional q-grams of s (all but Q - 1 if t is longer) stand in t, at the same place or, behind an
insertion, one further on. So with a positional inverted index (gram, length, place) -> words, the postings of the grams of s
that have the length and places allowed are merged by a heap; words that come up often enough (the count filter) are
candidates, and compared.

The index is dealt out. Of all grams in one order, the rarest first, near words share one among the first Q + 1 of each (the
first Q of a shorter one): prefix filter. So a word is indexed in, and asks, those shards alone that hold such a gram and
length. A shard gets whole words, indexes all of their grams, and merges all of a question's. The words of one gram and
length beyond CHUNK are split between shards, and questions go to each: no gram is too frequent, none is left out.

Defined cases: null and empty texts have no words; a null id is an empty one where damage is drawn; counts add up over
repeated rows; of near words with equal counts the first in code-point order is the form; forms have larger counts than
their words, so chains end; an empty table gives no rows; words of any length are taken whole; further columns take no part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.letters import small_letters

#: Gram length; least code points of a word, for which the count filter needs one common gram at least; least occurrences.
Q, LENGTH, COUNT = 3, 6, 5
#: A form has at least so many times the count of its word.
TIMES = 5
#: Words of one gram and length that go to one shard, and words a shard is meant to hold.
CHUNK, HELD = 20_000, 8_000
#: Letters of words, small ones.
LETTERS = "a-zÀ-ÿ"
#: One in so many (document, word) pairs loses a letter, in the damaged counts.
ONE_IN = 199


def damaged(doc_id: Column, run: Column, one_in: int = ONE_IN) -> Column:
    """The run without one of its code points, where the hash of the document and the run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.left(run, at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, length: int = LENGTH, count: int = COUNT, one_in: int | None = None) -> DataFrame:
    """(word, n) of maximal runs of letters, lowered from A to Z alone, that are long and frequent enough; with one_in, of damaged ones."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(small_letters(F.col("text")), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("run"))
    word = F.col("run") if one_in is None else damaged(F.col("doc_id"), F.col("run"), one_in)
    return runs.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _merged(lists: list[list[int]], least: int, start: int = 0) -> Iterator[int]:
    """Numbers from start on that stand in at least so many of the ascending lists: a heap of list heads, and jumps past what cannot reach the count."""
    heap = [(x[at], k, at) for k, x in enumerate(lists) if (at := bisect_left(x, start)) < len(x)]
    heapify(heap)
    while len(heap) >= least:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heappop(heap))
        if len(taken) >= least:
            yield top
            goal = top + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heappop(heap))
            if not heap:
                return
            goal = heap[0][0]
        for _, k, at in taken:
            at = bisect_left(lists[k], goal, at)
            if at < len(lists[k]):
                heappush(heap, (lists[k][at], k, at))


def is_near(s: str, t: str) -> bool:
    """One code point replaced, or inserted into s."""
    k = next((k for k, (a, b) in enumerate(zip(s, t)) if a != b), len(s))
    return s != t and s[k + (len(s) == len(t)) :] == t[k + 1 :]


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """Near pairs among the words of a shard, and between them and the words that ask it: of their length, kept in other shards, or shorter by one."""
    own = rows[rows["asks"] < 0].sort_values("word")
    words, counts = own["word"].tolist(), own["n"].tolist()
    grams = lambda w: [(w[p : p + Q], p) for p in range(len(w) - Q + 1)]
    postings = defaultdict(list)
    for k, w in enumerate(words):
        for g, p in grams(w):
            postings[g, len(w), p].append(k)
    out = []
    for k, s in enumerate(words):
        lists = [x for g, p in grams(s) if (x := postings[g, len(s), p])[-1] > k]
        out += [(s, counts[k], words[t], counts[t]) for t in _merged(lists, len(s) + 1 - 2 * Q, k + 1) if is_near(s, words[t])]
    asked = rows[rows["asks"] >= 0]
    for s, n, longer in zip(asked["word"], asked["n"], asked["asks"]):
        lists = [x for g, p in grams(s) for at in range(p, p + longer + 1) if (x := postings.get((g, len(s) + longer, at)))]
        out += [(s, n, words[t], counts[t]) for t in _merged(lists, len(s) + 1 + longer - 2 * Q) if (longer or s < words[t]) and is_near(s, words[t])]
    return pd.DataFrame(out, columns=["word", "n", "other", "other_n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of each pair of words (word, n) one edit apart, once; words have at least 2 * Q code points."""
    size = F.length("word")
    grams = words.select("word", "n", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), size - Q + 1), lambda p: F.substring("word", p, F.lit(Q)))).alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("_in"))
    # Repeated grams of a word are told apart by their number, which the order of equal grams stands for.
    ranked = grams.join(common, "gram").withColumn("_rank", F.row_number().over(Window.partitionBy("word").orderBy("_in", "gram"))).where(F.col("_rank") <= Q + 1)
    rarest = scratch.saved(ranked.groupBy("word", "n", "size", "gram").agg(F.min("_rank").alias("rank")), "grams")
    keys = rarest.groupBy("gram", "size").agg(F.count("*").alias("held"))
    keys = scratch.saved(keys.withColumn("parts", F.ceil(F.col("held") / CHUNK)), "gram-sizes")
    shards = max(1, -(-(keys.agg(F.sum("held")).first()[0] or 0) // HELD))
    shard = lambda part: F.pmod(F.xxhash64("gram", "size", part), F.lit(shards)).cast("int").alias("shard")
    own_part = F.pmod(F.xxhash64("word"), "parts")
    every = lambda df: df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    row = lambda part, asks: (shard(part), "word", "n", F.lit(asks).alias("asks"))
    known = rarest.join(keys, ["gram", "size"])
    same = every(known.where("parts > 1")).where(F.col("_part") != own_part).select(*row(F.col("_part"), 0))
    longer = rarest.where(F.col("rank") <= Q).select("word", "n", "gram", (F.col("size") + 1).alias("size")).join(keys, ["gram", "size"])
    routed = known.select(*row(own_part, -1)).unionByName(same).unionByName(every(longer).select(*row(F.col("_part"), 1))).distinct()
    return routed.groupBy("shard").applyInPandas(_search, "word string, n long, other string, other_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, twice as far each round; counts grow TIMES-fold a step, so five rounds do for any counts."""
    reached = scratch.saved(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reached = scratch.saved(reached.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if reached.where("_moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.drop("_moved")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): the near word of largest count is the form, if its count is so many times the word's."""
    pairs = scratch.saved(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("_best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("_best.word").alias("_form"), (-F.col("_best.n")).alias("_form_n"))
    stands = F.col("_form_n") >= F.col("n") * times
    known = scratch.saved(known.select("word", "n", "n_near", F.when(stands, F.col("_form")).alias("form"), F.when(stands, F.col("_form_n")).alias("form_n")), "variants")
    out = known.join(_roots(known.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def damaged_variants(docs: DataFrame) -> DataFrame:
    """Variants of the words of documents, of which some have lost a letter."""
    return variants(scratch.saved(word_counts(docs, one_in=ONE_IN), "words"))


#: crc32 of a text of any letters: its bytes and the eight shifts of each, one after another.
_CRC = "xor(4294967295, list_reduce(flatten([[CAST('0x' || substr({0}, 2 * k + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR k IN range(length({0}) // 2)]), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, (a & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)))"
#: Near words meet on what is left of them without one code point.
ORACLE_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{{LENGTH},}}')) AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_CRC.format("x")} AS h FROM once),
words AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= {LENGTH} AND sum(n) >= {COUNT}),
less AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word UNION SELECT w.word, l.word FROM words w JOIN less l ON l.v = w.word UNION SELECT l.word, w.word FROM words w JOIN less l ON l.v = w.word),
best AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, (-o.n, p.other)) AS form, max(o.n) AS form_n FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN form END AS form, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM known UNION ALL SELECT walk.word, known.form FROM walk JOIN known ON known.word = walk.root AND known.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN known ON known.word = walk.root WHERE known.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN ends USING (word)
"""
