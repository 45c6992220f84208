"""Operator 3: line deduplication by the suffixes of line-id sequences. DataFrame functions only.

A document is the sequence of its lines with a visible character; a suffix starts at each of them. Prefix doubling ranks
suffixes by their first 1, 2, 4, ... lines: the rank at 2n orders the pairs of the ranks at n of a suffix and of the one
n lines on, by a distributed sort of the distinct pairs. Lines enter by a 128-bit hash (two of 1e11 lines share one with a
probability of 2e-17); from there on ranks stand for pairs of ranks, and nothing else can collide. A suffix that shares
its rank with no other is decided and leaves, so that rounds shrink, and they end when no repeated run is that long.

Suffixes of one rank at 2n are an LCP interval of depth 2n at least. Descending from the last round, each interval is
split by the ranks of the lines that follow, at half the step each time. Of each part the first suffix, in the order of
(doc_id, text hash, line), stays as well in the interval above, for those that the split took away from all earlier
ones. So every suffix ends in the deepest interval that holds an earlier suffix, and that depth is the length of
its longest run of lines that stands somewhere before: a maximal repeated run, of any length.

A later copy counts if it has `min_lines` lines, or is one line of `min_chars` characters. All its lines are deleted.

Ranks that many rows hold are few, and meet their rows by a broadcast of bounded size (`shared.meet`). Text is put together from the slices between deleted lines.

Defined results: null text stays null and has 0 lines; lines without a visible character are never deleted and do not
break runs; rows with the same doc_id and text are one document, so repeated rows get the same result; null doc_ids
come first; an empty table gives no rows; other columns pass through `without_repeated_lines`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import counted, forget, measured, meet, stored

MIN_LINES, MIN_CHARS = 2, 100
BLANK = " \t\r\f\v"
AT = ("doc_id", "d", "e", "pos")


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _hashes(*of: Column) -> tuple[Column, Column]:
    return F.xxhash64(*of), F.xxhash64(F.lit(7), *of)


def _document() -> tuple[Column, Column]:
    d, e = _hashes(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.col("text"))
    return d.alias("d"), e.alias("e")


def suffixes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row a suffix: document and its order, position among the worded lines, line number, whether long, line hash."""

    def line(x: Column, i: Column) -> Column:
        a, b = _hashes(x)
        return F.struct(i.alias("line"), (F.char_length(x) >= min_chars).alias("long"), (F.trim(x, F.lit(BLANK)) != "").alias("seen"), a.alias("left"), b.alias("right"))

    own = docs.where("text is not null").select("doc_id", *_document(), F.filter(F.transform(_lines(), line), lambda x: x["seen"]).alias("lines")).dropDuplicates(["d", "e"])
    return own.select("doc_id", "d", "e", F.posexplode("lines").alias("pos", "x")).select(*AT, "x.line", "x.long", "x.left", "x.right")


def _few(df: DataFrame, rows: int | None) -> DataFrame:
    """`df` in tasks of some 50,000 of at most so many rows: late rounds have few, whatever the number of shuffle partitions."""
    return df if rows is None else df.coalesce(max(8, rows // 50_000 + 1))


def _grouped(rows: DataFrame, keys: list[str], most_rows: int | None, in_order: bool) -> tuple[DataFrame, int]:
    """`rows` with rank, n and first of their key where two rows or more have it (else null), and how many have one; ranks tell keys apart, or follow their order too."""
    groups = _few(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*AT)).alias("first")).where("n > 1"), most_rows)
    groups, counts = counted(_few((groups.orderBy(*keys) if in_order else groups).withColumn("rank", F.monotonically_increasing_id()), most_rows), "ranks")
    return _few(meet(rows, groups, keys, list(AT), counts), most_rows), counts["total"]


def _level(pairs: DataFrame, most_rows: int | None) -> tuple[DataFrame | None, int]:
    """The suffixes that share a rank, and whether an earlier one has it; how many they are (no table where there are none)."""
    shared, rows = _grouped(pairs, ["left", "right"], most_rows, True)
    shared = shared.where("n is not null").select(*AT, "line", "long", "rank", (~F.struct(*AT).eqNullSafe(F.col("first"))).alias("later"))
    return (stored(shared, "suffixes") if rows else None), rows


def levels(docs: DataFrame, min_chars: int = MIN_CHARS) -> list[DataFrame]:
    """For the first 1, 2, 4, ... lines, the suffixes in LCP intervals of that depth."""
    found, (level, rows) = [], _level(suffixes(docs, min_chars), None)
    while rows:
        found.append(level)
        step = 1 << len(found) - 1
        on = W.partitionBy("d", "e").orderBy("pos").rangeBetween(step, step)
        pairs = level.select(*AT, "line", "long", F.col("rank").alias("left"), F.first("rank").over(on).alias("right")).where("right is not null")
        level, rows = _level(_few(pairs, rows), rows)
    return found


_STATE = [*AT, "line", "long", "kind", "rank", "depth", "lead", "size"]


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every suffix that begins with an earlier line: its document, pos, line, long, and depth, the length of its longest run that stands before."""
    found, state, rows = levels(docs, min_chars), None, 0
    for j in range(len(found) - 1, -1, -1):
        here = found[j]
        # those with no earlier suffix in their interval of the round after, and so the first of each of its intervals
        if j + 1 < len(found):
            here = here.join(found[j + 1].where("later").select("d", "e", "pos"), ["d", "e", "pos"], "left_anti")
        new = here.select(*AT, "line", "long", F.lit(2 * j).alias("kind"), "rank", F.lit(1 << j).alias("depth"), (~F.col("later")).alias("lead"), F.lit(None).cast("bigint").alias("size"))
        if state is not None:
            after = found[j].select("d", "e", (F.col("pos")).alias("at"), F.col("rank").alias("next"))
            on = _few(state.withColumn("at", F.col("pos") + F.col("depth")).join(after, ["d", "e", "at"], "left").drop("at"), rows)
            # a null marks a suffix that no other follows: the only one of its part
            parts, _ = _grouped(on.withColumnRenamed("rank", "above").withColumn("next", F.coalesce("next", -F.lit(1) - F.xxhash64(*AT).bitwiseAND(F.lit((1 << 62) - 1)))), ["kind", "above", "next"], rows, False)
            first = F.col("n").isNull() | F.struct(*AT).eqNullSafe(F.col("first"))
            deeper = parts.where("n is not null").select(*AT, "line", "long", F.lit(2 * j + 1).alias("kind"), "rank", (F.col("depth") + (1 << j)).alias("depth"), first.alias("lead"), F.col("n").alias("size"))
            same = parts.where(first & ~F.coalesce(F.col("n") == F.col("size"), F.lit(False))).select(*AT, "line", "long", "kind", F.col("above").alias("rank"), "depth", "lead", F.lit(None).cast("bigint").alias("size"))
            new = new.select(*_STATE).union(deeper.select(*_STATE)).union(same.select(*_STATE))
        before = state
        state, seen = measured(new.select(*_STATE), "intervals", rows=F.count(F.lit(1)))
        rows = seen["rows"]
        if before is not None:
            forget(before)
    if state is None:
        return suffixes(docs, min_chars).select(*AT, "line", "long", F.lit(0).alias("depth")).where("false")
    return state.where("not lead").select(*AT, "line", "long", "depth")


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """d, e, deleted (line numbers in order), longest_run (lines of the longest later copy that begins in the document)."""
    counts = (F.col("depth") >= min_lines) | F.col("long")
    so_far = W.partitionBy("d", "e").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("depth") >= min_lines, F.col("pos") + F.col("depth"))).over(so_far)
    rows = repeated_runs(docs, min_chars).select("d", "e", "line", F.when(counts, F.col("depth")).alias("run"), (F.col("long") | F.coalesce(reach > F.col("pos"), F.lit(False))).alias("gone"))
    return rows.where("gone").groupBy("d", "e").agg(F.array_sort(F.collect_list("line")).alias("deleted"), F.max("run").alias("longest_run"))


def line_report(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (a struct of all columns but the text), text without later copies, n_lines, n_removed, longest_run."""
    gone = deleted_lines(docs.select("doc_id", "text"), min_lines, min_chars)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), _lines().alias("lines"), *_document())
    joined = keyed.join(gone, ["d", "e"], "left")
    # the lines from after the i-th deleted one to before the next
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("deleted", i - 1) + 1)
    end = lambda i: F.coalesce(F.get("deleted", i), F.size("lines"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("deleted")), lambda i: F.slice("lines", start(i) + 1, end(i) - start(i))))
    text = F.array_join(F.when(F.col("deleted").isNull(), F.col("lines")).otherwise(kept), "\n")
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("bigint")
    return joined.select("row", text.alias("text"), n.alias("n_lines"), F.when(F.col("deleted").isNull(), 0).otherwise(F.size("deleted")).cast("bigint").alias("n_removed"), F.coalesce("longest_run", F.lit(0)).cast("bigint").alias("longest_run"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text, n_lines, n_removed, longest_run for every row of `docs`."""
    return line_report(docs.select("doc_id", "text"), min_lines, min_chars).select("row.doc_id", "text", "n_lines", "n_removed", "longest_run")


def without_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` without later copies; documents that were nothing else go. A column n_chars follows the text."""
    out = line_report(docs, min_lines, min_chars).where((F.col("n_removed") == 0) | (F.trim(F.col("text"), F.lit(BLANK + "\n")) != ""))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        own = F.col("row").getField(name)
        if name == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(own).cast(dict(docs.dtypes)[name])
        return own.alias(name)

    return out.select(*map(column, docs.columns))


def oracle(min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> str:
    """The same over `documents` as DuckDB SQL, one line more a round, for distinct doc_ids."""
    return f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos, length(x) >= {min_chars} AS long FROM l WHERE trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
r AS (SELECT doc_id, pos, 1 AS run, md5(x) AS name FROM s
UNION ALL SELECT q.doc_id, q.pos, q.run + 1, md5(q.name || md5(s.x)) FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM r) q JOIN s ON s.doc_id = q.doc_id AND s.pos = q.pos + q.run WHERE q.n > 1),
later AS (SELECT doc_id, pos, max(run) AS run FROM (SELECT *, row_number() OVER (PARTITION BY run, name ORDER BY doc_id, pos) AS k FROM r) WHERE k > 1 GROUP BY 1, 2),
runs AS (SELECT p.doc_id, p.pos, p.run, s.line, s.long, coalesce(max(CASE WHEN run >= {min_lines} THEN p.pos + p.run END) OVER (PARTITION BY p.doc_id ORDER BY p.pos), 0) AS reach FROM later p JOIN s ON s.doc_id = p.doc_id AND s.pos = p.pos),
removed AS (SELECT doc_id, line, CASE WHEN run >= {min_lines} OR long THEN run END AS run FROM runs WHERE long OR reach > pos),
kept AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.line) AS text FROM l LEFT JOIN removed r ON l.doc_id = r.doc_id AND l.line = r.line WHERE r.line IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(m.run, 0) AS BIGINT) AS longest_run
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n, max(run) AS run FROM removed GROUP BY doc_id) m ON d.doc_id = m.doc_id"""
