"""Operator 9: learned decision lists for document quality.

Sequential covering over labelled statistics: each rule is a conjunction of thresholds,
grown condition by condition on one part of the labelled rows by information gain and
pruned on the other. The list becomes one ordered conditional expression in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.arrays import hashes, ngram_hashes, runs, sliced, spans, steady_memory, utf8
from loam.llm.common import pick, quoted


_of = lambda chars: np.isin(np.arange(256), list(chars.encode()))
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_MARK = np.array([b < 128 and chr(b).isprintable() and not chr(b).isalnum() and b != 32 for b in range(256)])
#: Shares of a text's characters, by class of bytes. Characters beyond ASCII count as letters.
_SHARES = {
    "upper_ratio": np.array([65 <= b <= 90 for b in range(256)]),
    "digit_ratio": np.array([48 <= b <= 57 for b in range(256)]),
    "space_ratio": _SPACE,
    "newline_ratio": _of("\n"),
    "sentence_mark_ratio": _of(".,;:!?"),
    "quote_ratio": _of("'\"`"),
    "bracket_ratio": _of("()[]{}"),
    "markup_ratio": _of("<>/\\|_~^"),
    "symbol_ratio": _of("$+=<>|~^`"),
    "other_mark_ratio": _of("#%&*@"),
}
STATISTICS = (*_SHARES, "mean_word_length", "letterless_word_ratio", "word_end_marks_ratio", "repetition_ratio", "repeated_trigram_ratio", "repeated_line_ratio", "line_end_ratio")


def _again(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Where a code isn't the first of its kind of its owner."""
    order = np.lexsort((code, owner))
    same = (owner[order[1:]] == owner[order[:-1]]) & (code[order[1:]] == code[order[:-1]])
    return np.sort(order[1:][same])


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text, from its whole length; 0 for an empty text."""
    n = len(offsets) - 1
    texts = np.arange(n)
    share = lambda part, whole: part / np.maximum(whole, 1)
    times = np.bincount(np.repeat(texts, np.diff(offsets)) * 256 + data, minlength=n * 256).reshape(n, 256)
    chars = times[:, :128].sum(axis=1) + times[:, 192:].sum(axis=1)
    out = {name: share(times[:, kind].sum(axis=1), chars) for name, kind in _SHARES.items()}
    inside = ~_SPACE[data]
    start, end = spans(inside, offsets)
    per = np.diff(np.searchsorted(start, offsets))
    owner = np.repeat(texts, per)
    out["mean_word_length"] = share(chars - times[:, _SPACE].sum(axis=1), per)
    letters = np.add.reduceat(_LETTER[data], start, dtype=np.int64) if len(start) else start
    out["letterless_word_ratio"] = share(np.bincount(owner[letters == 0], minlength=n), per)
    marks = _MARK[data]
    noisy = (end - start >= 2) & marks[end - 1] & marks[end - 2]
    out["word_end_marks_ratio"] = share(np.bincount(owner[noisy], minlength=n), per)
    word = hashes(data[inside], end - start)
    gram, have = ngram_hashes(word, per, 3)
    of = np.repeat(texts, have)
    again = _again(of, gram)
    out["repeated_trigram_ratio"] = share(np.bincount(of[again], minlength=n), have)
    # words that stand where they stood before: after their like, or at the end of a trigram that came before
    stale = np.zeros(len(word), bool)
    stale[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    stale[again + (np.cumsum(per) - per - np.cumsum(have) + have)[of[again]] + 2] = True
    out["repetition_ratio"] = share(np.bincount(owner[stale], minlength=n), per)
    inside = data != 10
    start, end = spans(inside, offsets)
    lines = np.diff(np.searchsorted(start, offsets))
    owner = np.repeat(texts, lines)
    out["repeated_line_ratio"] = share(np.bincount(owner[_again(owner, hashes(data[inside], end - start))], minlength=n), lines)
    closed = _of(".!?:;\"')")[data[end - 1]] if len(end) else np.empty(0, bool)
    out["line_end_ratio"] = share(np.bincount(owner[closed], minlength=n), lines)
    return {name: out[name] for name in STATISTICS}


def statistics(text: Column) -> Column:
    """A struct of the statistics that conditions test; NULL for NULL. Measured on Arrow's buffers, some 2 kB of counts a text at once."""

    @F.arrow_udf("struct<" + ",".join(f"{name}:double" for name in STATISTICS) + ">")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        steady_memory()
        for batch in batches:
            data, offsets = utf8(batch)
            parts = [measured(*sliced(data, offsets, a, b)) for a, b in runs(offsets)]
            columns = [pa.array(np.concatenate([np.empty(0), *(p[name] for p in parts)])) for name in STATISTICS]
            yield pa.StructArray.from_arrays(columns, STATISTICS, mask=batch.is_null())

    return measure(text)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] > self.threshold if self.above else table[self.name] <= self.threshold

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.name] > self.threshold if self.above else stats[self.name] <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    """A document for which all conditions hold is bad, with this chance among the labelled ones."""

    conditions: tuple[Condition, ...]
    precision: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(table) for c in self.conditions])


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def decide(self, stats: dict[str, Column]) -> Column:
        """One ordered conditional expression: the number of the first rule that holds, from 1; 0: none does."""
        out: Column | None = None
        for i, rule in enumerate(self.rules, 1):
            test = F.lit(True)
            for c in rule.conditions:
                test = test & c.column(stats)
            out = F.when(test, i) if out is None else out.when(test, i)
        return F.lit(0) if out is None else out.otherwise(0)

    def apply(self, table: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(table.values())))
        out = np.zeros(n, int)
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out[rule.holds(table)] = i
        return out

    def __str__(self) -> str:
        return "\n".join(f"{i}: bad if " + " and ".join(map(str, r.conditions)) + f" ({r.precision:.3f})" for i, r in enumerate(self.rules, 1))


def _best(table: dict[str, np.ndarray], bad: np.ndarray, cover: np.ndarray, close: float = 0.5) -> Condition | None:
    """The next condition for the covered rows: of those with `close` of the highest information gain the one with the widest gap.

    Thresholds lie midway between neighbouring values. The gap is that between them, as a share
    of the statistic's range; of equal ones the first by name, then `<=`, then the lowest.
    """
    p0, n0 = int(bad[cover].sum()), int((~bad[cover]).sum())
    if not p0 or not n0:
        return None
    prior = np.log2(p0 / (p0 + n0))
    found: list[tuple[np.ndarray, np.ndarray, str, bool, np.ndarray]] = []
    for name in sorted(table):
        values = table[name][cover]
        order = np.argsort(values, kind="stable")
        v, y = values[order], bad[cover][order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - prior), 0.0)
            found.append((gain, np.round((v[cut + 1] - v[cut]) / (v[-1] - v[0]), 9), name, above, (v[cut] + v[cut + 1]) / 2))
    best = max((float(gain.max()) for gain, *_ in found), default=0.0)
    if best <= 1e-9:
        return None
    widest, out = -1.0, None
    for gain, gap, name, above, threshold in found:
        there = np.where(gain >= close * best, gap, -1.0)
        i = int(there.argmax())
        if there[i] > widest:
            widest, out = float(there[i]), Condition(name, above, float(threshold[i]))
    return out


def fit_decision_list(table: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, max_rules: int = 12, max_conditions: int = 4, seed: int = 7) -> DecisionList:
    """Sequential covering: grow on two thirds, cut to the first conditions that do best on the rest and have min_precision, go on with what the rule doesn't cover.

    Where no part of a rule has min_precision, the statistic that it began with is left out from there on.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    random = np.random.Generator(np.random.PCG64(seed))
    part = random.permutation(len(bad)) % 3 == 0  # the part for pruning
    able = dict(table)  # without the statistics that a rule of too low a precision began with
    while able and len(rules) < max_rules and (left & bad).sum() >= 3:
        cover, conditions = left & ~part, []
        while len(conditions) < max_conditions:
            condition = _best(able, bad, cover)
            if condition is None:
                break
            conditions.append(condition)
            cover = cover & condition.holds(table)
        if not conditions:
            break

        held = [left]
        for c in conditions:
            held.append(held[-1] & c.holds(table))
        count = lambda rows: (int((rows & bad).sum()), int((rows & ~bad).sum()))

        def worth(k: int) -> float:
            p, n = count(held[k] & part)
            return (p - n) / (p + n) if p + n else -1.0

        good = [k for k in range(1, len(conditions) + 1) if (c := count(held[k]))[0] >= 2 and c[0] >= min_precision * sum(c)]
        if not good:
            del able[conditions[0].name]
            continue
        size = max(good, key=lambda k: (round(worth(k), 12), -k))
        p, n = count(held[size])
        rules.append(Rule(tuple(conditions[:size]), p / (p + n)))
        left = left & ~held[size]
    return DecisionList(tuple(rules))


def learn_quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, min_precision: float = 0.9, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DecisionList:
    """A decision list for quality 0, from at most about max_rows labelled documents.

    The bound is on the labelled rows that the driver fits on: those whose ids' hashes are
    the lowest share. Their whole texts count, however long. Labels other than 0 and 1, NULL
    labels, ids and texts are left out; of an id with several labels the lowest counts, and
    documents that repeat an id are rows each. Without labelled rows the list is empty and
    rejects nothing. Other columns are left out.
    """
    known = pick(labels, doc_id=id_col, bad=label_col).where("doc_id IS NOT NULL AND bad IN (0, 1)").groupBy("doc_id").agg((F.min("bad") == 0).alias("bad"))
    total = known.count()
    if not total:
        return DecisionList()
    if total > max_rows:
        known = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < int(2**63 * max_rows / total))
    rows = pick(docs, doc_id=id_col, text=text_col).where("text IS NOT NULL").join(F.broadcast(known), "doc_id")  # about max_rows ids at every size
    got = rows.select("bad", statistics(F.col("text")).alias("s")).select("bad", "s.*").toPandas().sort_values(["bad", *STATISTICS], kind="stable")
    if got.empty:
        return DecisionList()
    return fit_decision_list({k: got[k].to_numpy(float) for k in STATISTICS}, got["bad"].to_numpy(bool), min_precision)


def _ruled(docs: DataFrame, rules: DecisionList, text: Column, to: str) -> DataFrame:
    """docs with the number of the first rule that holds for a text; -1 for NULL and for texts of white space alone, 0: it stays."""
    s = f"{to}_statistics"
    found = docs.withColumn(s, statistics(text))
    number = F.when(text.isNull() | ~text.rlike(r"\S"), -1).otherwise(rules.decide({k: F.col(s)[k] for k in STATISTICS}))
    return found.withColumn(to, number).drop(s)


def apply_quality_rules(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, keep) of every row: the number of the first rule that holds (0: none) and whether the document stays.

    NULL texts and texts of white space alone have rule -1 and go: there is nothing to keep.
    Whole texts are measured, however long. Equal rows get equal results; NULL ids are no
    matter; an empty table gives an empty one; other columns are left out.
    """
    return _ruled(pick(docs, doc_id=id_col, text=text_col), rules, F.col("text"), "rule").select("doc_id", "rule", (F.col("rule") == 0).alias("keep"))


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns: NULL and blank texts go, equal rows stay or go together, an empty table stays empty."""
    to = "_rule" + "_" * max(map(len, docs.columns))  # longer than any column's name
    return _ruled(docs, rules, quoted(text_col), to).where(F.col(to) == 0).drop(to)
