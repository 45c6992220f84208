"""Operator 4: quality rules as weak supervision.

Each rule looks at one statistic of a whole text and votes good (+1), bad (-1) or, between its two bounds, abstains (0);
no rule asks what another says. The votes of all documents are counted by pattern (at most 3 ** len(RULES) of them).
Expectation-maximisation over these counts estimates, for each rule, how often its vote is right on good documents and on two
kinds of bad ones, and their shares; a document's posterior probability of being good replaces an all-must-pass filter,
so that one bad vote of a rule that the others seldom bear out rejects nothing. Only pattern counts reach the driver.

Defined results: null or empty text has all counts 0 and fails the base rule (as all texts under 50 words do); very long
texts are judged whole, in one row; a posterior equal to the threshold keeps; repeated rows are scored row by row; an empty table gives no rows; other columns pass through `kept_documents`,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, blocks, document_of, mixed, span_hashes, spans
from .shared import stored

_SYMBOL, _UPPER, _LOWER, _STOP = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LOWER[97:123] = True
_STOP[list(b".!?")] = True
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True
_K = mixed(np.arange(101, 105, dtype=np.uint64)) | np.uint64(1)

_LETTER = _UPPER | _LOWER | (np.arange(256) >= 0xC0)  # of a character beyond ASCII the first byte

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_stops", "n_letters"]


def _per_document(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[starts[1:]] - sums[starts[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found twice or more; is it not the first of its value."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order[1:]] |= same
    later[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def statistics(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of each document of a block, each over its whole text."""
    n = len(starts) - 1
    begin, end, first = spans(data, starts)
    doc = document_of(first)
    words = span_hashes(data, begin, end)
    space = SPACE[data]
    own = doc.astype(np.uint64) * _K[3]
    out = {"n_words": np.diff(first), "word_chars": _per_document(~space & ((data & 0xC0) != 0x80), starts), "n_symbols": _per_document(_SYMBOL[data], starts)}
    a, b, line_first = spans(data, starts, _LINE_END)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=filled[1:])
    worded = filled[b] > filled[a]
    line_doc = document_of(line_first)[worded]
    _, later = _again(mixed(span_hashes(data, a[worded], b[worded]) + line_doc.astype(np.uint64) * _K[3]))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        whole = doc[2:] == doc[:-2]
        many, _ = _again(mixed(words[:-2] * _K[0] + words[1:-1] * _K[1] + words[2:] * _K[2] + own[:-2])[whole])
        at = np.flatnonzero(whole)[many]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    _, later = _again(mixed(words + own))
    out["n_distinct_words"] = out["n_words"] - np.bincount(doc[later], minlength=n)
    for name, kind in (("n_upper", _UPPER), ("n_lower", _LOWER), ("n_stops", _STOP)):
        out[name] = _per_document(kind[data], starts)
    out["n_letters"] = _per_document(_LETTER[data], starts)
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


RULES = ("symbols", "other characters", "capitals", "repeated windows", "distinct words", "repeated lines", "sentence ends", "word length", "line length")
_POWERS = 3 ** np.arange(len(RULES))
#: The bands are set so that at most one good document in 200 gets a bad vote of a rule; EM holds on to that.
LEAST_RIGHT = 0.995


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row a document, one column a rule: -1 bad, 0 abstain, 1 good.

    No two rules look at the same characters' counts: symbols count in the first alone, so that a text full of them gets one bad
    vote for it, and word length and other characters leave them out.
    """
    w = s["n_words"]
    plain = s["word_chars"] - s["n_symbols"]

    def below(x: np.ndarray, good: float, bad: float) -> np.ndarray:
        return np.where(x > bad, -1, np.where(x < good, 1, 0))

    def within(x: np.ndarray, bad: tuple[float, float], good: tuple[float, float]) -> np.ndarray:
        return np.where((x < bad[0]) | (x > bad[1]), -1, np.where((x >= good[0]) & (x <= good[1]), 1, 0))

    variety = np.log(np.maximum(s["n_distinct_words"], 1)) / np.log(np.maximum(w, 2))  # hardly depends on the length
    return np.stack(
        [
            below(_share(s["n_symbols"], w), 0.05, 0.3),
            below(_share(plain - s["n_letters"], plain), 0.05, 0.1),
            below(_share(s["n_upper"], s["n_upper"] + s["n_lower"]), 0.03, 0.05),
            below(_share(s["n_repeat_words"], w), 0.03, 0.2),
            -below(variety, 0.9, 0.94),
            below(_share(s["n_dup_lines"], s["n_lines"]), 0.05, 0.32),
            within(_share(s["n_stops"], w), (0.03, 0.2), (0.05, 0.15)),
            within(_share(plain, w), (4.2, 6.4), (4.6, 5.7)),
            within(_share(w, s["n_lines"]), (9, 200), (15, 120)),
        ],
        axis=1,
    ).astype(np.int8)


def fitted(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> dict:
    """How often each rule's vote is right on good documents and on either kind of bad ones, and the three shares, by EM over vote patterns.

    Bad documents are of two kinds, each with accuracies of its own: those on which rules agree, and those that one rule alone speaks
    against. EM starts from the filter that it replaces: two bad votes or more put a text with the first kind, one with the
    second. A rule whose lone votes are few and scattered gains no kind by them, so that these reject nothing. An abstention
    says nothing. Right votes on good documents have a Beta(19, 1) prior and those on bad ones Beta(2, 2), the shares
    Dirichlet(8, 1, 1); on good documents votes are right at least LEAST_RIGHT of the time, and all stay within 0.001 to 0.999,
    so that few documents, or none, give a usable model.
    """
    v = patterns.reshape(len(counts), len(RULES)).astype(float)
    up, down = v > 0, v < 0
    n_bad = down.sum(1)
    p = np.stack([np.where(n_bad == 0, 0.9, 0.1), np.where(n_bad > 1, 0.8, np.where(n_bad == 1, 0.1, 0.05)), np.where(n_bad == 1, 0.8, np.where(n_bad > 1, 0.1, 0.05))], axis=1)
    before = None
    for _ in range(rounds):
        mass = p * counts[:, None]
        yes, no = mass.T @ up, mass.T @ down
        prior = np.array([[19.0, 1.0], [2.0, 2.0], [2.0, 2.0]])
        right = np.concatenate([(yes[:1] + 19) / (yes[:1] + no[:1] + 20), (no[1:] + prior[1:, :1]) / (yes[1:] + no[1:] + 4)])
        m = {"right": np.clip(right, np.array([[LEAST_RIGHT], [0.001], [0.001]]), 0.999), "share": np.clip((mass.sum(0) + [8, 1, 1]) / (counts.sum() + 10), 0.001, 0.999)}
        p = kinds(v, m)
        now = np.concatenate([m["right"].ravel(), m["share"]])
        if before is not None and np.abs(now - before).max() < 1e-9:
            break
        before = now
    return m


def weights(m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each kind of bad document, log odds of good against it: what a good and a bad vote of each rule add, and those before any vote."""
    good, bad = m["right"][0], m["right"][1:]
    return np.log(good / (1 - bad)), np.log((1 - good) / bad), np.log(m["share"][0] / m["share"][1:])


def kinds(v: np.ndarray, m: dict) -> np.ndarray:
    """Probabilities of good and of the two kinds of bad, a row for each row of votes."""
    up, down, odds = weights(m)
    against = np.exp(-(odds + (v > 0) @ up.T + (v < 0) @ down.T))
    good = 1 / (1 + against.sum(1))
    return np.column_stack([good, against * good[:, None]])


def posterior(v: np.ndarray, m: dict) -> np.ndarray:
    return kinds(v, m)[:, 0]


def _base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in blocks(batches):
        s = statistics(data, starts)
        code = (votes(s) + 1) @ _POWERS
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[k], pa.int64()) for k in STATISTICS), pa.array(_base_failed(s)), pa.array(code, pa.int64())], names=["doc_id", *STATISTICS, "base_failed", "votes"])


def _model(votes_: DataFrame) -> dict:
    rows = votes_.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # at most 3 ** len(RULES) rows
    codes = np.array([r["votes"] for r in rows], np.int64)
    return fitted(codes[:, None] // _POWERS % 3 - 1, np.array([r["n"] for r in rows], float))


def _posterior(m: dict, votes_: Column) -> Column:
    against = F.lit(0.0)
    for up, down, prior in zip(*weights(m)):
        odds = F.lit(float(prior))
        for k in range(len(RULES)):
            vote = F.floor(votes_ / int(3**k)) % 3
            odds = odds + F.when(vote == 2, float(up[k])).when(vote == 0, float(down[k])).otherwise(0.0)
        against = against + F.exp(-odds)
    return 1 / (1 + against)


def scored(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the statistics, base_failed, posterior and kept for every row of `docs`."""
    kind = dict(docs.dtypes)["doc_id"]
    columns = ", ".join(f"{k} bigint" for k in STATISTICS)
    s = stored(docs.select("doc_id", "text").mapInArrow(_described, f"doc_id {kind}, {columns}, base_failed boolean, votes bigint"), "statistics")
    s = s.withColumn("posterior", _posterior(_model(s), F.col("votes")))
    return s.select("doc_id", *STATISTICS, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"))


def kept_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, that the base rule and the posterior keep.

    Rows are written with their votes, so that texts are read by the rules once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in blocks(batches):
            s = statistics(data, starts)
            code = (votes(s) + 1) @ _POWERS
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_base_failed(s)), pa.array(code, pa.int64())], names=[*places, "base_failed", "votes"])

    # columns go by number, whatever their names
    places = [f"c{i}" if c != "text" else "text" for i, c in enumerate(docs.columns)]
    numbered = docs.toDF(*places)
    schema = ", ".join(f"{c} {t}" for c, t in numbered.dtypes)
    voted = stored(numbered.mapInArrow(run, f"{schema}, base_failed boolean, votes bigint"), "voted")
    kept = voted.where(~F.col("base_failed") & (_posterior(_model(voted), F.col("votes")) >= threshold))
    return kept.select(*places).toDF(*docs.columns)
