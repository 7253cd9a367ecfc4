"""Text and score functions as Spark columns. NULL texts count as empty, except where a function says otherwise."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class: what Python's str.split and str.strip take as such.
WS = r"\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}"
CONTROL = r"\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}"
#: Neither letter, digit, white space, Chinese character nor common punctuation.
SPECIAL = r"[^\p{L}\p{N}_" + WS + r"\x{4e00}-\x{9fff}.,;:!?()\x{22}\x{27}\x{ff0c}\x{3002}\x{ff1a}\x{ff1b}\x{ff01}\x{ff1f}\x{ff08}\x{ff09}\x{3001}]"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
HEADING = rf"^#+[{WS}]"


def text(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def text_length(x: Column) -> Column:
    return F.length(text(x))


def word_count(x: Column) -> Column:
    return _count(text(x), f"[^{WS}]+")


def strip(x: Column) -> Column:
    return F.btrim(text(x), F.lit(_BLANKS))


def is_blank(x: Column) -> Column:
    return ~text(x).rlike(f"[^{WS}]")


def char_density(x: Column) -> Column:
    """The share of characters other than blank, tab and newline."""
    x = text(x)
    return _share(F.length(x) - _count(x, r"[ \t\n]"), F.length(x))


def cjk_ratio(x: Column) -> Column:
    x = text(x)
    return _share(_count(x, f"[{CJK}]"), F.length(x))


def _entropies(texts: pd.Series) -> pd.Series:
    def one(value: str | None) -> float:
        if not value:
            return 0.0
        counts = np.unique(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
        share = counts / counts.sum()
        return round(float(-(share * np.log2(share)).sum()), 9) + 0.0

    return texts.map(one, na_action=None)


def entropy(x: Column) -> Column:
    """Shannon entropy of the characters in bits, to 9 digits. Counted in Arrow batches: as rows of characters it would need a shuffle."""
    return F.pandas_udf(_entropies, "double")(x)


def gibberish_parts(x: Column) -> tuple[Column, Column, Column]:
    """Shares of replacement, control and special characters, each scaled and at most 1."""
    x = text(x)
    n = F.length(x)
    part = lambda pattern, factor: F.least(F.lit(1.0), _share(_count(x, pattern) * factor, n))
    return part(r"\x{fffd}", 10), part(f"[{CONTROL}]", 10), part(SPECIAL, 5)


def gibberish_score(x: Column) -> Column:
    a, b, c = gibberish_parts(x)
    return (a + b + c) / 3


def completeness_score(x: Column, min_length: int = 20, sections: Sequence[str] = ()) -> Column:
    """0 for blank texts; the stripped length's share of min_length, at most 1, times the share of expected sections that occur."""
    n = F.length(strip(x)).cast("double")
    score = F.when(n >= min_length, F.lit(1.0)).otherwise(n / max(1, min_length))
    if sections:
        low = F.lower(text(x))
        score = score * sum((F.when(low.contains(s.lower()), 1).otherwise(0) for s in sections), F.lit(0)) / len(sections)
    return F.when(is_blank(x), F.lit(0.0)).otherwise(score)


def chunk_quality(x: Column, min_length: int = 20) -> Column:
    """0.4 of what isn't gibberish, 0.3 of completeness, 0.3 of density against 0.7; 0 for blank texts."""
    return quality_of(is_blank(x), gibberish_score(x), F.length(strip(x)), char_density(x), min_length)


def quality_of(blank: Column, gibberish: Column, strip_length: Column, density: Column, min_length: int = 20) -> Column:
    """chunk_quality of what was measured before."""
    n = strip_length.cast("double")
    complete = F.when(n >= min_length, F.lit(1.0)).otherwise(n / max(1, min_length))
    score = (1 - gibberish) * 0.4 + complete * 0.3 + F.least(density / 0.7, F.lit(1.0)) * 0.3
    return F.when(blank, F.lit(0.0)).otherwise(score)


def age_days(updated: Column, as_of: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", updated, as_of) / F.lit(86_400_000_000.0)


def freshness_score(age: Column, ttl_days: Column | float = 30) -> Column:
    """1 at age 0 or less, 0 at ttl_days or more, linear between."""
    ttl = F.lit(ttl_days).cast("double") if not isinstance(ttl_days, Column) else ttl_days.cast("double")
    return F.when(age <= 0, F.lit(1.0)).when(age >= ttl, F.lit(0.0)).otherwise(1 - age / ttl)


def _xxh64(texts: pd.Series) -> pd.Series:
    import xxhash

    return texts.map(lambda x: xxhash.xxh64_hexdigest((x or "").encode("utf-8", "surrogatepass")), na_action=None)


def xxh64_hex(x: Column) -> Column:
    """xxHash64 with seed 0 as 16 hex digits; grouping within Spark uses normalized_hash instead."""
    return F.pandas_udf(_xxh64, "string")(x)


def normalize(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends. Lone blanks, most of them, need no replacing."""
    return F.trim(F.regexp_replace(text(x), f"(?:[{WS}&&[^ ]]| (?=[{WS}]))[{WS}]*", " "))


def normalized_hash(x: Column, normalized: bool = True) -> Column:
    return F.md5((normalize(x) if normalized else text(x)).cast("binary"))


#: Longer texts stay in the JVM, as damaged ones do, so that no Arrow batch takes more than its rows times this.
SHORT_BYTES = 16_384


def _hashes(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else hashlib.md5(" ".join(t.split()).encode()).hexdigest() for t in texts.to_pylist()], pa.string())


def split_hash(x: Column) -> Column:
    """normalized_hash(x), of all but long and damaged texts by str.split in Arrow batches, which takes a fifth of the time of the pattern."""
    short = F.when((F.octet_length(x) <= SHORT_BYTES) & F.is_valid_utf8(x), x)
    return F.coalesce(F.arrow_udf(_hashes, "string")(short), normalized_hash(x))


def short_sha256(x: Column) -> Column:
    return F.substring(F.sha2(text(x).cast("binary"), 256), 1, 16)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-case suffix with its dot; '' for names without one and for dot-files."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def path_category(rel: Column) -> Column:
    """The freshness category of a path within the knowledge folder."""
    top = F.element_at(F.split(rel, "/"), 1)
    return F.when(top.isin("短期", "short_term"), F.when(rel.contains("_cache_web"), "web_cache").otherwise("short_term")).when(top.isin("长期", "long_term"), "long_term").otherwise("unknown")


def valid_json(line: Column) -> Column:
    """Blank lines are valid. NaN and repeated keys are not."""
    return F.when(is_blank(line), True).otherwise(F.try_parse_json(line).isNotNull())


def has_key(line: Column, key: str) -> Column:
    """Whether the line is a JSON object with this key; arrays and scalars have none."""
    return F.coalesce(F.array_contains(F.json_object_keys(line), key), F.lit(False))


def json_truthy(line: Column, key: str) -> Column:
    """Whether the key's value is there and none of null, "", 0, false, [] and {}."""
    value = F.get_json_object(line, f"$.{key}")
    return F.coalesce(~value.isin("", "0", "0.0", "false", "null", "[]", "{}"), F.lit(False))


def has_heading(x: Column) -> Column:
    return text(x).rlike("(?md)" + HEADING)


def clamp(x: Column) -> Column:
    """x within 0 and 1; NULL stays NULL, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def score_bar(x: Column) -> Column:
    """A bar of ten blocks, with a mark at 0.8 and 0.6, and the percentage."""
    filled = F.floor(clamp(x) * 10).cast("int")
    mark = F.when(x >= 0.8, "✓").when(x >= 0.6, "⚠").otherwise("✗")
    return F.concat(mark, F.lit(" "), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), 10 - filled), F.lit(" "), F.format_string("%.1f%%", x * 100))
