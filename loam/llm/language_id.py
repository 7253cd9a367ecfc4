"""Operator 2: language identification with language-bitmask n-gram filters.

A Bloom filter per language, stored bit-sliced: position p of the table holds one bit per
language, so that the bitwise and of an n-gram's k positions gives all languages that
contain it. Per text the bits are counted by language, the counts are corrected for each
filter's false positives, and the best corrected share decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.arrays import mix, runs, sliced, steady_memory, utf8
from loam.llm.common import map_rows, pick

UNKNOWN = "und"
#: A text with few n-grams is too short to tell below so many bytes for each n-gram that it lacks to min_grams.
BRIEF = 20
#: Letters keep their byte; all else is a separator.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]
    table: np.ndarray  # at each position one bit per language, eight a byte
    false_positives: np.ndarray  # the rate of each language's filter
    n: int
    hashes: int


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of letters (UTF-8 bytes, one separator at most) of all texts, and each one's text."""
    if len(data) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    folded = _FOLD[data]
    size = len(folded) - n + 1
    gram = folded[:size].astype(np.uint64)
    apart = (folded == 32).astype(np.uint8)
    breaks = apart[:size].copy()
    for j in range(1, n):
        gram |= folded[j : size + j].astype(np.uint64) << np.uint64(8 * j)
        breaks += apart[j : size + j]
    ok = breaks < 2
    for j in range(1, n):
        late = offsets[1:] - j
        late = late[(late >= offsets[:-1]) & (late < size)]
        ok[late] = False
    return gram[ok], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:size][ok]


def _positions(gram: np.ndarray, hashes: int, bits: int):
    code = mix(gram)
    for j in range(hashes):
        if j:
            code = mix(code + np.uint64(j))
        yield (code >> np.uint64(64 - bits)).astype(np.int64)


def build_filters(languages: list[str], members: list[np.ndarray], n: int, bits: int = 17, hashes: int = 3) -> LanguageFilters:
    """Filters of any number of languages: a mask has a byte for eight of them."""
    table = np.zeros((1 << bits, max(1, -(-len(languages) // 8))), np.uint8)
    rates = []
    for i, gram in enumerate(members):
        own, bit = table[:, i // 8], np.uint8(1 << i % 8)
        for at in _positions(gram, hashes, bits):
            own[at] |= bit
        rates.append(float(np.count_nonzero(own & bit)) / len(table))
    return LanguageFilters(tuple(languages), table, np.array(rates) ** hashes, n, hashes)


def fit_language_filters(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 500, grams_per_language: int = 2000, n: int = 4, bits: int = 17, hashes: int = 3) -> LanguageFilters:
    """Filters of each language's profile, its grams_per_language most frequent n-grams, from a bounded sample of labelled rows.

    docs_per_language bounds the sample: the texts with the lowest hashes, whole and each
    once, however often it is repeated. Any number of languages goes. Rows with a NULL or
    empty text or without a language are left out, and so are other columns. A table without
    labelled rows gives filters of no language, under which every text is undetermined.
    """
    labelled = pick(docs, text=text_col, lang=lang_col).where("lang IS NOT NULL AND text <> ''")
    order = F.xxhash64("text")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.approx_count_distinct(order, 0.03).alias("n")).collect()}
    if not counts:
        return build_filters([], [], n, bits, hashes)
    shares = labelled.sparkSession.createDataFrame([(lang, min(1.0, 1.5 * docs_per_language / max(1, total) + 30 / max(1, total))) for lang, total in counts.items()], "lang string, share double")
    sample = labelled.join(F.broadcast(shares), "lang").where(F.pmod(order, F.lit(1_000_003)) < F.col("share") * 1_000_003).select("text", "lang", order.alias("hash"))
    sample = sample.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    sample = sample.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("k") <= docs_per_language)

    def count(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            data, offsets = utf8(batch.column(0), lower=True)
            gram, doc = grams(data, offsets, n)
            for i, name in enumerate(names):
                found, times = np.unique(gram[code[doc] == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(times)], ["lang", "gram", "n"])

    totals = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = totals.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= grams_per_language)
    members: dict[str, list[int]] = {lang: [] for lang in sorted(counts)}
    for row in best.select("lang", "gram").collect():
        members[row.lang].append(row.gram)
    return build_filters(list(members), [np.array(sorted(x), np.int64).view(np.uint64) for x in members.values()], n, bits, hashes)


def language_counts(filters: LanguageFilters, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many n-grams each language's filter holds (texts x languages), and how many there are."""
    n, width = len(offsets) - 1, filters.table.shape[1]
    gram, doc = grams(data, offsets, filters.n)
    mask = None
    for at in _positions(gram, filters.hashes, len(filters.table).bit_length() - 1):
        found = filters.table[at] if width > 1 else filters.table[:, 0][at]
        mask = found if mask is None else mask & found
    planes = mask.reshape(-1, width)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    hits = [np.bincount(doc * 256 + planes[:, w], minlength=n * 256).reshape(n, 256) @ bits for w in range(width)]
    return np.concatenate(hits, axis=1)[:, : len(filters.languages)], np.bincount(doc, minlength=n)


def decide(filters: LanguageFilters, hits: np.ndarray, total: np.ndarray, min_share: float, min_lead: float) -> tuple[np.ndarray, np.ndarray]:
    """The index of each text's language (-1: undetermined) and its corrected share."""
    if not hits.shape[1]:
        return np.full(len(total), -1), np.zeros(len(total))
    rate = filters.false_positives
    share = np.clip((hits - total[:, None] * rate) / np.maximum(total[:, None] * (1 - rate), 1e-9), 0, 1)
    best = share.argmax(axis=1)
    top = share[np.arange(len(best)), best]
    rest = share.copy()
    rest[np.arange(len(best)), best] = 0
    return np.where((total > 0) & (top >= min_share) & (top - rest.max(axis=1) >= min_lead), best, -1), top


def _judge(filters: LanguageFilters, column: pa.Array, min_share: float, min_lead: float, min_grams: int):
    """The language's index, corrected share and number of n-grams of each text, and whether it is kept."""
    data, offsets = utf8(column, lower=True)
    who, shares, totals = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
    for first, end in runs(offsets):
        hits, total = language_counts(filters, *sliced(data, offsets, first, end))
        best, share = decide(filters, hits, total, min_share, min_lead)
        who.append(best)
        shares.append(share)
        totals.append(total)
    share, total = np.concatenate(shares), np.concatenate(totals)
    brief = (total < min_grams) & (np.diff(offsets) < BRIEF * min_grams)
    return np.concatenate(who), share, total, ((share >= min_share) | brief) & np.asarray(column.is_valid())


def keep_known_languages(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", min_share: float = 0.15, min_grams: int = 20) -> DataFrame:
    """The rows that identify_language keeps, with all their columns: NULL texts go, short ones stay, equal rows stay or go together, an empty table stays empty."""
    at = docs.columns.index(text_col)

    def run(batches):
        steady_memory()
        for batch in batches:
            yield batch.filter(pa.array(_judge(filters, batch.column(at), min_share, 0.0, min_grams)[3]))

    return map_rows(docs, run)


def identify_language(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.15, min_lead: float = 0.05, min_grams: int = 20) -> DataFrame:
    """(doc_id, language, share, n_grams, keep) of every row.

    share is the corrected share of the text's n-grams that the language contains. A text is
    'und' where no language has min_share of them or the best leads by less than min_lead:
    NULL and empty texts and texts too short for an n-gram have share 0 and are 'und', and
    so is a tie. keep is false for NULL texts and where no language has min_share, unless the
    text is too short to tell: of fewer than min_grams n-grams in less than 20 bytes for each
    of these. A text of two languages is kept. Whole texts count, however long. Equal rows get
    equal results; NULL ids are no matter; an empty table gives an empty one; other columns are
    left out.
    """
    names = np.array([*filters.languages, UNKNOWN], object)
    kind = docs.select(F.col("`" + id_col.replace("`", "``") + "`")).dtypes[0][1]

    def run(batches):
        steady_memory()
        for batch in batches:
            best, share, total, keep = _judge(filters, batch.column(1), min_share, min_lead, min_grams)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(share), pa.array(total), pa.array(keep)], ["doc_id", "language", "share", "n_grams", "keep"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, language string, share double, n_grams long, keep boolean")
