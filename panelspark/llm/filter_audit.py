"""Operator 12: how five filters interact, over all orders, by recursive enumeration.

Each document fails a set of filters; documents become cells (part, set as a mask) at once, and nothing below sees a text.
A recursive CTE starts with the 32 masks and the empty prefix and extends each prefix by each letter that it lacks,
carrying the applied bits; each level tells of each mask what the step does with it. The levels are a fixed table (32 x 326
rows); joined with the cells by mask and summed they are the metrics of each part, prefix and step. An order reads
those of its prefixes, which the orders that begin alike share.

Copies: texts are compared by 128-bit hashes; the least doc_id of each text goes back to its rows by `shared.meet`, so
that a text with many copies is dealt to many tasks. Rows that share doc_id, part and mask are summed before they meet labels.

Defined results: null text is empty and has no words (fails A only, and E as any other text); null source is the part
''; a null doc_id is smaller than none and greater than none, and has no labels; rows that repeat a doc_id and a text are
documents each, and none of them is a copy of the other for that; of several labels of a doc_id, one with the value counts;
very long texts are taken whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import meet, stored, whole_text

LETTERS = "ABCDE"
METRICS = ("kept", "removed", "redundant", "unique_fails")

#: The prefixes by level: what the step of the last letter does with each mask.
_LEVELS = """WITH RECURSIVE levels(prefix, letter, step, mask, applied, before) AS (
    SELECT '', '', 0, mask, 0, 0 FROM (SELECT explode(sequence(0, 31)) AS mask)
    UNION ALL
    SELECT prefix || next, next, step + 1, mask, applied | shiftleft(1, instr('ABCDE', next) - 1), applied
    FROM levels LATERAL VIEW explode(filter(split('ABCDE', ''), x -> x <> '' AND instr(prefix, x) = 0)) n AS next
)
SELECT prefix, letter, step, mask, mask & applied = 0 AS kept, mask & before = 0 AND mask & applied <> 0 AS removed,
    mask & before <> 0 AND mask & (applied - before) <> 0 AS redundant, mask = applied - before AS unique_fails
FROM levels WHERE step > 0"""


def failures(text: str | Column = "text") -> Column:
    """Bits 1, 2, 4 and 8 of the filters A to D that a text (not null) fails."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")

    def bits(words: Column, text: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
        fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.char_length(text), text.rlike(r"[#$%&*|]")]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    return F.get(F.transform(F.array(words), lambda w: bits(w, text)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just the filters of a mask, and how many of them are labelled so."""
    text = whole_text()
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("bits"), F.xxhash64(text).alias("d"), F.xxhash64(F.lit(7), text).alias("e"))
    rows = stored(rows, "failures")
    copies = stored(rows.groupBy("d", "e").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "copies")
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    masked = meet(rows, copies, ["d", "e"], ["doc_id"]).select("doc_id", "part", (F.col("bits") + F.when(copied, 16).otherwise(0)).alias("mask"))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    summed = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(told, "doc_id", "left")
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return summed.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, filter order and step, with the step's counts and its filter's sum over all orders."""
    levels = docs.sparkSession.sql(_LEVELS)
    counted = cells(docs, labels).join(F.broadcast(levels), "mask")
    total = lambda of, when: F.sum(F.when(F.col(when), F.col(of)).otherwise(0)).cast("bigint")
    by_prefix = counted.groupBy("part", "prefix", "letter", "step").agg(*[total("n", m).alias(m) for m in METRICS], total("good", "removed").alias("good_lost"), total("toxic", "removed").alias("toxic_lost"))
    orders = levels.where("step = 5 and mask = 0").select(F.col("prefix").alias("filter_order"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.substring("prefix", F.lit(1), k))).alias("prefix"))
    steps = by_prefix.join(F.broadcast(orders), "prefix")  # 600 rows
    shapley = F.sum("removed").over(W.partitionBy("part", "letter")).alias("shapley")
    return steps.select("part", "filter_order", "step", *METRICS, "good_lost", "toxic_lost", shapley)


def oracle() -> str:
    """The same over `documents` and `labels` as DuckDB SQL."""
    return r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
b AS (SELECT doc_id, part, (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
+ (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
+ (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM b LEFT JOIN l ON b.doc_id = l.doc_id GROUP BY part, mask),
letters AS (SELECT chr(65 + i) AS letter, 1 << i AS bit FROM (SELECT unnest(range(0, 5))::INT AS i)),
p AS (SELECT '' AS prefix, '' AS letter, 0 AS bit, 0 AS before, 0 AS step UNION ALL SELECT prefix || l.letter, l.letter, l.bit, before | p.bit, step + 1 FROM p JOIN letters l ON (before | p.bit) & l.bit = 0),
m AS (SELECT part, prefix, letter, step, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
FROM c, p WHERE step > 0 GROUP BY part, prefix, letter, step)
SELECT part, o.prefix AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM m JOIN (SELECT prefix FROM p WHERE step = 5) o ON m.prefix = o.prefix[1:m.step]"""
