import hashlib
import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam.functions import text as T

TEXTS = ["", " ", "　", "a\u001cb", "hello", "hello world", "  two\t words \n", "aaaa", "abcd", "���", "\x01\x02ok", "漢字かなカナ", "“curly” \\ back", "x" * 19, "x" * 20, "# head\nbody", "a.b,c;d:e!f?(g)", "é" * 10, "$$$%%%", "é", "🎉 party"]
PUNCT = set(".,;:!?()\"'，。；：！？（）、")


def special(c):
    return not (unicodedata.category(c)[0] in "LN" or c == "_" or c.isspace() or "一" <= c <= "鿿" or c in PUNCT)


def gibberish(t):
    if not t:
        return 0.0
    n = len(t)
    a = min(1, t.count("�") * 10 / n)
    b = min(1, len(re.findall("[\x00-\x08\x0b\x0c\x0e-\x1f]", t)) * 10 / n)
    return (a + b + min(1, 5 * sum(map(special, t)) / n)) / 3


def completeness(t, least):
    s = t.strip()
    return 0.0 if not s else min(1.0, len(s) / least)


def density(t):
    return sum(c not in " \t\n" for c in t) / len(t) if t else 0.0


def quality(t):
    return 0.0 if not t.strip() else (1 - gibberish(t)) * 0.4 + completeness(t, 20) * 0.3 + min(density(t) / 0.7, 1) * 0.3


def entropy(t):
    return sum(-c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0


def run(spark, expr, rows=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("column", "plain"),
    [
        (T.text_length, len),
        (T.word_count, lambda t: len(t.split())),
        (T.strip, str.strip),
        (T.normalize, lambda t: " ".join(t.split())),
        (T.is_blank, lambda t: not t.strip()),
        (T.has_heading, lambda t: bool(re.search(r"^#+\s", t, re.MULTILINE))),
    ],
)
def test_exact(spark, column, plain):
    assert run(spark, column) == [plain(t) for t in TEXTS]


def test_hashes_of_short_and_long_texts_are_the_same(spark):
    rows = [*TEXTS, " \t a  b\n" * 5000, "\u3000 x" * 9000, " ", " \u00a0", "a \u2003b"]
    want = [hashlib.md5(" ".join(t.split()).encode()).hexdigest() for t in rows]
    assert run(spark, T.split_hash, rows) == want == run(spark, T.normalized_hash, rows)
    assert run(spark, T.split_hash, [None, "a"])[0] == hashlib.md5(b"").hexdigest()
    damaged = spark.sql("SELECT i, cast(x AS string) AS x FROM VALUES (0, X'61FF2062'), (1, X'E28061'), (2, X'20F09F9820'), (3, X'EDA08061') AS t(i, x)")
    assert damaged.where(T.split_hash(F.col("x")) == T.normalized_hash(F.col("x"))).count() == 4


@pytest.mark.parametrize(
    ("column", "plain"),
    [
        (T.char_density, density),
        (T.cjk_ratio, lambda t: len(re.findall("[一-鿿぀-ゟ゠-ヿ]", t)) / len(t) if t else 0.0),
        (T.gibberish_score, gibberish),
        (T.entropy, entropy),
        (lambda x: T.completeness_score(x, 10), lambda t: completeness(t, 10)),
        (T.chunk_quality, quality),
    ],
)
def test_scores(spark, column, plain):
    assert run(spark, column) == pytest.approx([plain(t) for t in TEXTS], abs=1e-8)


def test_null_counts_as_empty(spark):
    for f in (T.text_length, T.word_count, T.char_density, T.gibberish_score, T.entropy, T.chunk_quality, T.completeness_score):
        assert run(spark, f, [None]) == [0]


def test_sections(spark):
    assert run(spark, lambda x: T.completeness_score(x, 1, ["Intro", "end"]), ["the INTRO", "intro to the end", "none"]) == [0.5, 1.0, 0.0]


def test_hashes(spark):
    assert run(spark, T.xxh64_hex, ["hello"]) == ["26c7827d889f6da3"]
    assert run(spark, T.short_sha256, ["hello"]) == ["2cf24dba5fb0a30e"]


def test_freshness(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' a, timestamp_ntz'2024-01-16 00:00:00' b")
    got = row.select(T.freshness_score(T.age_days(F.col("a"), F.col("b")), 30), T.freshness_score(T.age_days(F.col("b"), F.col("a")), 30), T.freshness_score(T.age_days(F.col("a"), F.col("b")), 15), T.freshness_score(T.age_days(F.lit(None).cast("timestamp_ntz"), F.col("b")), 15)).first()
    assert list(got)[:3] == [0.5, 1.0, 0.0]


def test_paths(spark):
    paths = ["kb/a.TXT", "b", ".hidden", "short_term/_cache_web/x.md", "短期/y.md", "长期/z.md", "long_term/q", "x/short_term/y"]
    assert run(spark, T.suffix, paths) == [".txt", "", "", ".md", ".md", ".md", "", ""]
    assert run(spark, T.path_category, paths) == ["unknown", "unknown", "unknown", "web_cache", "short_term", "long_term", "long_term", "unknown"]


def test_json(spark):
    lines = ['{"role":"u","content":"x"}', '{"content":""}', "[1]", '"role"', "5", "null", "{bad", "", '{"text":"t"}', '{"content":0,"role":null}']
    assert run(spark, T.valid_json, lines) == [True] * 6 + [False, True, True, True]
    assert run(spark, lambda x: T.has_key(x, "role"), lines) == [True, False, False, False, False, False, False, False, False, True]
    assert run(spark, lambda x: T.json_truthy(x, "content"), lines) == [True] + [False] * 9


def test_bar(spark):
    df = spark.createDataFrame([(0.85,), (0.6,), (0.0,)], "x double")
    assert [r[0] for r in df.select(T.score_bar(F.col("x"))).collect()] == ["✓ ████████░░ 85.0%", "⚠ ██████░░░░ 60.0%", "✗ ░░░░░░░░░░ 0.0%"]
