"""The queries again as SQL for DuckDB, written from the definitions."""

from __future__ import annotations

from loam.functions.text import CJK, CONTROL, SPECIAL, WS

AS_OF = "TIMESTAMP '2024-02-14 00:00:00'"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


def share(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / {b} END)"


def part(x: str, pattern: str, factor: int) -> str:
    return f"least(1.0::DOUBLE, {share(f'{count(x, pattern)} * {factor}', f'length({x})')})"


def gibberish(x: str) -> str:
    return f"(({part(x, chr(92) + 'x{fffd}', 10)} + {part(x, f'[{CONTROL}]', 10)} + {part(x, SPECIAL, 5)}) / 3)"


def density(x: str) -> str:
    return share(f"length(translate({x}, E' \\t\\n', ''))", f"length({x})")


def completeness(x: str, least: int, factor: str = "1.0::DOUBLE") -> str:
    n = f"length({strip(x)})"
    return f"(CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {n}::DOUBLE / {least}) * {factor} END)"


def quality(x: str) -> str:
    return f"(CASE WHEN length({strip(x)}) = 0 THEN 0.0::DOUBLE ELSE (1 - {gibberish(x)}) * 0.4::DOUBLE + {completeness(x, 20)} * 0.3::DOUBLE + least({density(x)} / 0.7::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE END)"


def normal(x: str) -> str:
    return f"regexp_replace({strip(x)}, '[{WS}]+', ' ', 'g')"


def base(x: str) -> str:
    return f"string_split({x}, '/')[-1]"


def age(updated: str, as_of: str = AS_OF) -> str:
    return f"((epoch_us({as_of}) - epoch_us({updated})) / 86400000000.0::DOUBLE)"


def fresh(age_: str, ttl: str) -> str:
    return f"(CASE WHEN {age_} <= 0 THEN 1.0::DOUBLE WHEN {age_} >= {ttl} THEN 0.0::DOUBLE ELSE 1 - {age_} / {ttl}::DOUBLE END)"


CHUNKS = f"""chunks AS (SELECT doc_id AS ordinal, 'doc_' || doc_id AS chunk_id, text AS content, source, lang FROM documents),
f AS MATERIALIZED (SELECT *, length(content) AS n, length({strip('content')}) AS sn, {gibberish('content')} AS g, md5(content) AS raw FROM chunks)"""


def chunk_profile(by: str = "", grouping: str = "") -> str:
    """The profile's columns before rounding, from f."""
    return f"""
sums AS (SELECT {by} count(*) AS total, count(*) FILTER (sn = 0) AS empty_count, count(*) FILTER (n > 0 AND sn < 20) AS short_count, count(DISTINCT raw) AS unique_count, avg(g) AS avg_gibberish, max(g) AS max_gibberish,
  avg(n) FILTER (n > 0) AS mean_length, coalesce(stddev_pop(n) FILTER (n > 0), 0) AS std_length, min(n) FILTER (n > 0)::INTEGER AS min_length, max(n) FILTER (n > 0)::INTEGER AS max_length, count(DISTINCT source) AS unique_sources FROM f {grouping}),
dims AS (SELECT *, total - unique_count AS duplicate_count, greatest(0, 1 - (empty_count + short_count * 0.5::DOUBLE) / total) AS completeness, unique_count::DOUBLE / total AS uniqueness, 1 - avg_gibberish AS validity, greatest(0, 1 - std_length / mean_length) AS consistency FROM sums),
profile AS (SELECT *, (completeness + uniqueness + validity + consistency) / 4 AS overall, (completeness < 0.8)::INTEGER + (uniqueness < 0.8)::INTEGER + (validity < 0.8)::INTEGER + (consistency < 0.8)::INTEGER AS issues FROM dims)"""


_ROUND = ("avg_gibberish", "max_gibberish", "mean_length", "std_length", "completeness", "uniqueness", "validity", "consistency", "overall")
_WHOLE = ("total", "empty_count", "short_count", "unique_count", "duplicate_count", "min_length", "max_length", "unique_sources", "issues")
PROFILE_COLUMNS = ", ".join([*_WHOLE, *(f"round({c}, 6) AS {c}" for c in _ROUND)])

RULES = f"""results AS (
  SELECT ordinal, 'chunk_not_empty' AS rule_name, sn > 0 AS passed, 'error' AS severity FROM r
  UNION ALL SELECT ordinal, 'chunk_min_length', sn >= 20, 'warning' FROM r
  UNION ALL SELECT ordinal, 'chunk_max_length', length(content) <= 5000, 'warning' FROM r
  UNION ALL SELECT ordinal, 'chunk_no_replacement_chars', NOT contains(content, chr(65533)), 'warning' FROM r
  UNION ALL SELECT ordinal, 'chunk_no_control_chars', NOT regexp_matches(content, '[{CONTROL}]'), 'warning' FROM r
  UNION ALL SELECT ordinal, 'chunk_has_source', coalesce(source, '') <> '', 'warning' FROM r)"""
CHECKED = f"r AS MATERIALIZED (SELECT doc_id AS ordinal, text AS content, source, length({strip('text')}) AS sn FROM documents), {RULES}"
SUMMARY = "count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed AND severity = 'error') AS errors, count(*) FILTER (NOT passed AND severity = 'warning') AS warnings, count(*) FILTER (NOT passed AND severity = 'info') AS infos, count(*) FILTER (passed)::DOUBLE / count(*) AS pass_rate"

POLICY = "policy(category, ttl_days, stale_days, action) AS (VALUES ('short_term', 30, 15, 'archive'), ('web_cache', 7, 3, 'delete'), ('long_term', NULL, 90, 'review'), ('chat_history', 180, 90, 'archive'), ('memory', NULL, 180, 'review'))"
RECORDS = f"""{POLICY},
assets AS (SELECT 'user_' || user_id AS asset_id, (['short_term', 'web_cache', 'long_term', 'chat_history', 'memory', 'unknown'])[user_id % 6 + 1] AS category, max(ts) AS updated_at FROM events GROUP BY user_id),
aged AS (SELECT a.asset_id, a.category, p.ttl_days, p.stale_days, p.action, {age('a.updated_at')} AS age_days FROM assets a LEFT JOIN policy p USING (category)),
records AS (SELECT *, coalesce(age_days > stale_days, false) AS is_stale, coalesce(age_days > ttl_days, false) AS is_expired,
  CASE WHEN age_days IS NULL OR (ttl_days IS NULL AND stale_days IS NULL) THEN 1.0::DOUBLE ELSE greatest(0, 1 - age_days / coalesce(ttl_days, stale_days * 2)) END AS freshness_score FROM aged)"""
FRESH = "count(*) AS total, count(*) FILTER (is_stale) AS stale_count, count(*) FILTER (is_expired) AS expired_count, avg(freshness_score) AS avg_freshness"

DUPLICATES = f"""h AS (SELECT doc_id AS ordinal, 'doc_' || doc_id AS chunk_id, md5({normal('text')}) AS hash FROM documents)"""
STATS = "count(*) AS total_items, count(DISTINCT hash) AS unique_items, count(*) - count(DISTINCT hash) AS duplicate_count, (SELECT count(*) FROM (SELECT hash FROM h GROUP BY hash HAVING count(*) > 1)) AS duplicate_groups, (count(*) - count(DISTINCT hash))::DOUBLE / count(*) AS duplicate_ratio"


def pairs(threshold: float) -> str:
    return f"""v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
pairs AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.e, y.e) / (x.n * y.n) AS similarity FROM v x JOIN v y ON x.id < y.id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= {threshold})"""


GROUPS = """ends AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, other) AS (SELECT a, a FROM ends UNION SELECT r.node, b.b FROM reach r JOIN ends b ON r.other = b.a),
components AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

NODES = """nodes AS (SELECT 'nation:' || n_nationkey AS id, n_name AS name, 'source' AS node_type, n_nationkey::BIGINT AS seq, NULL AS src FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'transform', c_custkey::BIGINT, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, o_orderkey::VARCHAR, 'storage', o_orderkey::BIGINT, NULL FROM orders),
edges AS (SELECT 'nation:' || c_nationkey AS source, 'customer:' || c_custkey AS target, 'chunk' AS operation, c_custkey::BIGINT AS seq FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'embed_store', o_orderkey::BIGINT FROM orders)"""

SIGNALS = f"""{CHUNKS}, {chunk_profile()}, {DUPLICATES}, stats AS (SELECT {STATS} FROM h), {CHECKED}, checked AS (SELECT {SUMMARY} FROM results), {RECORDS}, fresh AS (SELECT {FRESH} FROM records),
components AS (SELECT 'Data Quality' AS name, overall AS score, 0.35::DOUBLE AS weight FROM profile UNION ALL SELECT 'Validation', passed::DOUBLE / total, 0.25 FROM checked UNION ALL SELECT 'Uniqueness', 1 - duplicate_ratio, 0.2 FROM stats UNION ALL SELECT 'Freshness', avg_freshness, 0.2 FROM fresh),
health AS (SELECT sum(score * weight) / sum(weight) AS overall FROM components),
signal AS (SELECT health.overall AS health, profile.overall AS quality, profile.issues, stats.duplicate_count AS dup, stats.duplicate_ratio, checked.errors, checked.pass_rate, fresh.stale_count AS stale, fresh.expired_count AS expired, fresh.avg_freshness FROM health, profile, stats, checked, fresh),
fired AS (SELECT 1 AS seq, 'delete_duplicates' AS decision_type, CASE WHEN dup > 10 THEN 'high' ELSE 'medium' END AS severity, 0.99::DOUBLE AS confidence, dup || ' exact duplicates' AS trigger FROM signal WHERE dup > 0
  UNION ALL SELECT 2, 'delete_empty_chunks', 'high', 0.95, issues || ' quality issues' FROM signal WHERE issues > 0 AND quality < 0.7
  UNION ALL SELECT 3, 'delete_expired', 'medium', 0.9, expired || ' expired assets' FROM signal WHERE expired > 0
  UNION ALL SELECT 4, 'schedule_review', 'low', 0.8, stale || ' stale assets' FROM signal WHERE stale > 5
  UNION ALL SELECT 5, 'quarantine', CASE WHEN errors > 10 THEN 'high' ELSE 'medium' END, 0.85, errors || ' validation errors' FROM signal WHERE errors > 0),
decisions AS (SELECT * FROM fired UNION ALL SELECT 6, 'no_action', 'low', 1.0, 'Nothing to do' WHERE NOT EXISTS (SELECT * FROM fired))"""

TREND = "days AS (SELECT ts::DATE AS ts, round(avg(value), 6) / 100 AS s FROM events GROUP BY 1), newest AS (SELECT * FROM days ORDER BY ts DESC LIMIT 5), trend AS (SELECT CASE WHEN count(*) < 2 THEN 'unknown' WHEN arg_max(s, ts) - arg_min(s, ts) > 0.05 THEN 'improving' WHEN arg_max(s, ts) - arg_min(s, ts) < -0.05 THEN 'degrading' ELSE 'stable' END AS trend FROM newest)"

FILES = f"files AS (SELECT source || '/doc_' || doc_id || '.txt' AS path, text AS content, {AS_OF} - to_days((doc_id % 400)::INTEGER) AS mtime FROM documents)"
DOCS = f"""{FILES}, d0 AS MATERIALIZED (SELECT path, length(content)::INTEGER AS length, {count('content', f'[^{WS}]+')}::INTEGER AS word_count, length({strip('content')}) = 0 AS blank, {completeness('content', 20)} AS completeness, 1 - {gibberish('content')} AS validity, {fresh(age('mtime'), '180')} AS timeliness FROM files),
docs AS (SELECT *, (completeness + validity + timeliness) / 3 AS overall, (completeness < 0.8)::INTEGER + (validity < 0.8)::INTEGER + (timeliness < 0.8)::INTEGER AS issues FROM d0)"""


def consistency(names: str, sources: str) -> str:
    """names and sources: SELECTs of base names."""
    return f"na AS (SELECT DISTINCT * FROM ({names}) t(name)), sa AS (SELECT DISTINCT * FROM ({sources}) t(name)), same AS (SELECT count(*) FILTER (na.name IS NOT NULL AND sa.name IS NOT NULL) AS overlap, count(*) FILTER (sa.name IS NULL) AS orphan_files, count(*) FILTER (na.name IS NULL) AS orphan_sources, count(*) AS names FROM na FULL JOIN sa ON na.name = sa.name)"


PASSPORTS = f"""marks AS (SELECT 'doc_' || doc_id AS asset_id, min(quality) * 0.6::DOUBLE + (1 - max(toxic)) * 0.3::DOUBLE AS q, CASE WHEN max(toxic) = 0 THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END AS f FROM labels GROUP BY doc_id),
pp AS (SELECT 'doc_' || doc_id AS asset_id, 'pp_' || substring(sha256(text), 1, 16) AS passport_id, source, coalesce(q, 0.0::DOUBLE) AS quality_score, coalesce(f, 0.0::DOUBLE) AS freshness_score,
  CASE WHEN q IS NULL THEN 'unverified' WHEN q >= 0.8 AND f >= 0.5 THEN 'verified' WHEN q >= 0.6 THEN 'trusted' WHEN q >= 0.3 THEN 'suspect' ELSE 'quarantined' END AS trust_level, (q IS NOT NULL)::INTEGER AS assessment_count FROM documents LEFT JOIN marks ON marks.asset_id = 'doc_' || doc_id)"""

EMBEDDED = f"""times AS (SELECT source AS path, {AS_OF} - to_days((min(doc_id) % 400)::INTEGER) AS mtime FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0),
e0 AS MATERIALIZED (SELECT doc_id AS ordinal, text, source, length({strip('text')}) = 0 AS blank, {quality('text')} AS q, {gibberish('text')} AS g FROM documents),
embedded AS (SELECT ordinal, round(q, 3) AS quality_score, CASE WHEN NOT blank THEN round(g, 3) END AS gibberish_score, CASE WHEN NOT blank THEN length(text)::INTEGER END AS char_count, CASE WHEN NOT blank THEN md5(text) END AS content_hash, blank OR q < 0.3 AS is_quarantined,
  CASE WHEN coalesce(source, '') <> '' THEN coalesce(round({fresh(age('mtime'), '180')}, 3), 0.5::DOUBLE) END AS freshness_score FROM e0 LEFT JOIN times ON source = path),
results AS (SELECT ordinal % 50 AS query_id, ordinal, CASE WHEN ordinal % 7 <> 0 THEN quality_score END AS quality_score, is_quarantined OR ordinal % 11 = 0 AS is_quarantined FROM embedded)"""
_PASSES = "coalesce(quality_score, 1.0) >= 0.8 AND NOT coalesce(is_quarantined, false)"

LINES = """lines AS (SELECT conv_id, turn, conv_id % 7 = 0 AS bad, conv_id % 5 = 0 AS roleless, conv_id % 3 = 0 AS empty, CASE WHEN conv_id % 7 = 0 THEN '{bad ' || turn WHEN conv_id % 5 = 0 THEN '{"content":"m' || turn || '"}' WHEN conv_id % 3 = 0 THEN '{"role":"' || role || '","content":""}' ELSE '{"role":"' || role || '","text":"m' || turn || '"}' END AS line FROM conversations),
parsed AS (SELECT *, json_valid(line) AS ok, CASE WHEN json_valid(line) THEN line END AS j FROM lines)"""

FILE_NAMES, STORE_NAMES = "SELECT doc_id || '.md' FROM documents", "SELECT vec_id || '.md' FROM embeddings"

SECTIONS = "((contains(lower(text), 'license')::INTEGER + contains(lower(text), 'the')::INTEGER + contains(lower(text), 'und ')::INTEGER)::DOUBLE / 3)"

SQL: dict[str, str] = {
    "text_metrics": f"SELECT doc_id, length(text)::INTEGER AS text_length, {count('text', f'[^{WS}]+')}::INTEGER AS word_count, round({density('text')}, 6) AS char_density, round({share(count('text', f'[{CJK}]'), 'length(text)')}, 6) AS cjk_ratio FROM documents",
    "text_entropy": "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), k AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM k GROUP BY 1) SELECT doc_id, round(round(-sum(n::DOUBLE / total * log2(n::DOUBLE / total)), 9), 6) AS entropy FROM k JOIN t USING (doc_id) GROUP BY doc_id",
    "gibberish_components": f"SELECT doc_id, round({part('text', chr(92) + 'x{fffd}', 10)}, 6) AS replacement, round({part('text', f'[{CONTROL}]', 10)}, 6) AS control, round({part('text', SPECIAL, 5)}, 6) AS special, round({gibberish('text')}, 6) AS gibberish FROM documents",
    "quality_score": f"SELECT doc_id, round({quality('text')}, 6) AS quality FROM documents",
    "completeness_sections": f"SELECT doc_id, round({completeness('text', 400, SECTIONS)}, 6) AS completeness FROM documents",
    "normalized_text": f"SELECT doc_id, md5({normal('text')}) AS hash, substring(sha256(text), 1, 16) AS sha16, length({normal('text')})::INTEGER AS length FROM documents",
    "path_functions": f"SELECT page_id, {base('url')} AS name, lower(regexp_extract({base('url')}, '^.+(\\.[^.]+)$', 1)) AS suffix, CASE WHEN page_id % 4 = 1 THEN 'long_term' WHEN page_id % 4 = 3 THEN 'unknown' WHEN page_id % 3 = 0 THEN 'web_cache' ELSE 'short_term' END AS category FROM pages",
    "null_dup_ratio": "WITH v AS (SELECT 'event_type' AS \"column\", event_type AS v FROM events UNION ALL SELECT 'props', props FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR FROM events) SELECT \"column\", round(count(*) FILTER (v IS NULL OR v = '')::DOUBLE / count(*), 6) AS null_ratio, round(1 - (count(DISTINCT v) + max((v IS NULL)::INTEGER))::DOUBLE / count(*), 6) AS duplicate_ratio FROM v GROUP BY 1",
    "chunk_profile": f"WITH {CHUNKS}, {chunk_profile()} SELECT {PROFILE_COLUMNS} FROM profile",
    "chunk_profile_by_lang": f"WITH {CHUNKS}, {chunk_profile('lang,', 'GROUP BY lang')} SELECT lang, {PROFILE_COLUMNS} FROM profile",
    "chunk_profile_cube": f"WITH {CHUNKS}, {chunk_profile('lang, source AS src,', 'GROUP BY CUBE (lang, source)')} SELECT lang, src, total, unique_count, round(completeness, 6) AS completeness, round(validity, 6) AS validity FROM profile",
    "chunk_problems": f"""WITH {CHUNKS}, p AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY ordinal) AS k, first_value(chunk_id) OVER (PARTITION BY raw ORDER BY ordinal) AS first_id FROM f)
SELECT ordinal, chunk_id, 'empty' AS problem, NULL::INTEGER AS length, NULL::DOUBLE AS score, NULL::VARCHAR AS duplicate_of FROM p WHERE sn = 0
UNION ALL SELECT ordinal, chunk_id, 'too_short', sn::INTEGER, NULL, NULL FROM p WHERE sn > 0 AND sn < 20
UNION ALL SELECT ordinal, chunk_id, 'too_long', sn::INTEGER, NULL, NULL FROM p WHERE sn > 5000
UNION ALL SELECT ordinal, chunk_id, 'gibberish', NULL, round(g, 6), NULL FROM p WHERE sn > 0 AND g > 0.3
UNION ALL SELECT ordinal, chunk_id, 'duplicate', NULL, NULL, first_id FROM p WHERE sn > 0 AND k > 1""",
    "problem_counts": f"WITH {CHUNKS}, p AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY ordinal) AS k FROM f), a AS (SELECT 'empty' AS problem, count(*) FILTER (sn = 0) AS n FROM p UNION ALL SELECT 'too_short', count(*) FILTER (sn > 0 AND sn < 20) FROM p UNION ALL SELECT 'too_long', count(*) FILTER (sn > 5000) FROM p UNION ALL SELECT 'gibberish', count(*) FILTER (sn > 0 AND g > 0.3) FROM p UNION ALL SELECT 'duplicate', count(*) FILTER (sn > 0 AND k > 1) FROM p) SELECT * FROM a WHERE n > 0",
    "document_profile": f"WITH {DOCS} SELECT path, length, word_count, round(completeness, 6) AS completeness, round(validity, 6) AS validity, round(timeliness, 6) AS timeliness, round(overall, 6) AS overall, issues, concat_ws('; ', CASE WHEN completeness < 0.5 THEN 'Too short or empty' END, CASE WHEN validity < 0.7 THEN 'Encoding damage likely' END, CASE WHEN timeliness < 0.3 THEN 'Stale' END, CASE WHEN blank THEN 'Without content' END) AS recommendations FROM docs",
    "recommendations": f"WITH {DOCS}, r AS (SELECT path, 'Too short or empty' AS recommendation FROM docs WHERE completeness < 0.5 UNION ALL SELECT path, 'Encoding damage likely' FROM docs WHERE validity < 0.7 UNION ALL SELECT path, 'Stale' FROM docs WHERE timeliness < 0.3 UNION ALL SELECT path, 'Without content' FROM docs WHERE blank) SELECT recommendation, min(path) AS first, count(*) AS n FROM r GROUP BY 1",
    "kb_profile": f"""WITH {CHUNKS}, {chunk_profile()}, {DOCS}, {consistency(f'SELECT {base("path")} FROM files', f'SELECT {base("source")} FROM chunks')}
SELECT 'completeness' AS dimension, round(avg(overall), 6) AS score, count(*) AS items, sum(issues)::BIGINT AS issues FROM docs
UNION ALL SELECT 'uniqueness', round(uniqueness, 6), total, issues::BIGINT FROM profile
UNION ALL SELECT 'validity', round(validity, 6), 0, 0 FROM profile
UNION ALL SELECT 'consistency', round(overlap::DOUBLE / names, 6), 0, (overlap::DOUBLE / names < 0.8)::BIGINT FROM same
UNION ALL SELECT 'timeliness', round(avg(timeliness), 6), 0, 0 FROM docs""",
    "ingest_gate": f"WITH {DOCS} SELECT CASE WHEN overall >= 0.3 THEN 'ingest' ELSE 'reject' END AS verdict, count(*) AS n FROM docs GROUP BY 1",
    "file_store_consistency": f"WITH {consistency(FILE_NAMES, STORE_NAMES)} SELECT overlap, orphan_files, orphan_sources, round(overlap::DOUBLE / names, 6) AS score FROM same",
    "orphan_names": f"WITH a AS (SELECT DISTINCT name FROM ({FILE_NAMES}) AS x(name)), b AS (SELECT DISTINCT name FROM ({STORE_NAMES}) AS x(name)) SELECT name, 'file' AS side FROM a WHERE name NOT IN (FROM b) UNION ALL SELECT name, 'store' FROM b WHERE name NOT IN (FROM a)",
    "exact_dup_rows": f"WITH {DUPLICATES} SELECT *, count(*) OVER (PARTITION BY hash) AS group_size, row_number() OVER (PARTITION BY hash ORDER BY ordinal) = 1 AS is_keep FROM h",
    "exact_dup_groups": f"WITH {DUPLICATES} SELECT hash, arg_min(chunk_id, ordinal) AS keep_id, array_to_string(list(chunk_id ORDER BY ordinal)[2:], ',') AS remove_ids FROM h GROUP BY hash HAVING count(*) > 1",
    "exact_dup_stats": f"WITH {DUPLICATES} SELECT {STATS.replace('duplicate_ratio', 'r')} FROM h".replace("(count(*) - count(DISTINCT hash))::DOUBLE / count(*) AS r", "round((count(*) - count(DISTINCT hash))::DOUBLE / count(*), 6) AS duplicate_ratio"),
    "exact_dup_raw": f"WITH h AS (SELECT md5(html) AS hash FROM pages) SELECT {STATS} FROM h".replace("(count(*) - count(DISTINCT hash))::DOUBLE / count(*) AS", "round((count(*) - count(DISTINCT hash))::DOUBLE / count(*), 6) AS"),
    "dup_keep_by_metadata": f"WITH {DUPLICATES}, k AS (SELECT h.*, (l.doc_id IS NOT NULL)::INTEGER AS more FROM h LEFT JOIN labels l ON l.doc_id = h.ordinal), g AS (SELECT ordinal, chunk_id, hash, count(*) OVER (PARTITION BY hash) AS group_size, row_number() OVER (PARTITION BY hash ORDER BY more DESC, ordinal) = 1 AS is_keep FROM k) SELECT * FROM g WHERE group_size > 1",
    "dedup_survivors": f"WITH {DUPLICATES} SELECT min(ordinal) AS ordinal, arg_min(chunk_id, ordinal) AS chunk_id FROM h GROUP BY hash",
    "semantic_pairs": f"WITH {pairs(0.4)} SELECT a, b, round(similarity, 5) AS similarity FROM pairs",
    "semantic_groups": f'WITH RECURSIVE {pairs(0.4)}, {GROUPS} SELECT component AS "group", node AS ordinal, node = component AS is_keep FROM components',
    "two_phase_dedup": f"""WITH RECURSIVE {DUPLICATES}, c AS (SELECT * FROM h), gone AS (SELECT ordinal FROM (SELECT ordinal, row_number() OVER (PARTITION BY hash ORDER BY ordinal) AS k FROM c) WHERE k > 1),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE vec_id IN (SELECT ordinal FROM c) AND vec_id NOT IN (FROM gone)),
pairs AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.4), {GROUPS}
SELECT ordinal, 'hash' AS removed_by FROM gone UNION ALL SELECT node, 'semantic' FROM components WHERE node <> component""",
    "components": f"WITH RECURSIVE {pairs(0.35)}, {GROUPS} SELECT component, count(*) AS n FROM components GROUP BY 1",
    "validate_chunks": f"WITH {CHECKED} SELECT * FROM results",
    "validate_summary": f"WITH {CHECKED} SELECT * REPLACE (round(pass_rate, 6) AS pass_rate) FROM (SELECT {SUMMARY} FROM results)",
    "validate_failures_by_rule": f"WITH {CHECKED} SELECT rule_name, count(*) AS failures FROM results WHERE NOT passed GROUP BY 1",
    "validate_first_failures": f"WITH {CHECKED} SELECT ordinal, rule_name FROM results WHERE NOT passed ORDER BY ordinal, rule_name LIMIT 50",
    "validate_fail_fast": f"WITH r AS (SELECT doc_id AS ordinal, t AS content, source, length({strip('t')}) AS sn FROM (SELECT *, text AS t FROM documents)), {RULES} SELECT ordinal, rule_name, passed FROM results WHERE ordinal <= coalesce((SELECT min(ordinal) FROM results WHERE NOT passed AND severity = 'error'), ordinal)",
    "validate_chat": f"WITH {LINES} SELECT conv_id, turn, 'jsonl_valid' AS rule_name, ok AS passed FROM parsed UNION ALL SELECT conv_id, turn, 'message_has_role', coalesce(json_exists(j, '$.role'), false) FROM parsed UNION ALL SELECT conv_id, turn, 'message_has_content', coalesce(json_extract_string(j, '$.content'), '') <> '' OR coalesce(json_extract_string(j, '$.text'), '') <> '' FROM parsed",
    "validate_memory": f"WITH n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN E'intro\\n## ' || text ELSE text END AS c FROM documents) SELECT doc_id, 'memory_not_empty' AS rule_name, length({strip('c')}) > 0 AS passed, 'warning' AS severity FROM n UNION ALL SELECT doc_id, 'memory_has_structure', regexp_matches(c, '(?m)^#+[{WS}]'), 'info' FROM n",
    "validate_files": "WITH n AS (SELECT page_id, (['.md', '.TXT', '.html', '.pdf'])[page_id % 4 + 1] AS ext, strlen(html) AS size FROM pages) SELECT page_id, 'file_exists' AS rule_name, page_id % 9 <> 0 AS passed FROM n UNION ALL SELECT page_id, 'file_not_empty', size > 0 FROM n UNION ALL SELECT page_id, 'file_supported_format', ext <> '.html' FROM n UNION ALL SELECT page_id, 'file_size_reasonable', size < 8000 FROM n UNION ALL SELECT page_id, 'file_utf8_readable', true FROM n",
    "freshness_records": f"WITH {RECORDS} SELECT asset_id, category, round(age_days, 6) AS age_days, is_stale, is_expired, round(freshness_score, 6) AS freshness_score FROM records",
    "freshness_report": f"WITH {RECORDS} SELECT * REPLACE (round(avg_freshness, 6) AS avg_freshness) FROM (SELECT {FRESH} FROM records)",
    "expired_actions": f"WITH {RECORDS} SELECT asset_id, category, action FROM records WHERE is_expired",
    "stale_not_expired": f"WITH {RECORDS} SELECT asset_id, category FROM records WHERE is_stale AND NOT is_expired",
    "order_ages": f"WITH a AS (SELECT {age('o_orderdate::TIMESTAMP', chr(39).join(['TIMESTAMP ', '1998-08-02', '']))} AS age FROM orders) SELECT age > 180 AS is_stale, false AS is_expired, count(*) AS n, round(avg(greatest(0, 1 - age / 360)), 6) AS avg_freshness FROM a GROUP BY 1",
    "lineage_upstream": f"WITH {NODES} SELECT DISTINCT e.target AS \"of\", e.source AS id FROM edges e JOIN nodes n ON n.id = e.target AND n.node_type = 'storage' WHERE e.source IN (SELECT id FROM nodes)",
    "lineage_downstream": f"WITH {NODES} SELECT DISTINCT e.source AS \"of\", e.target AS id FROM edges e JOIN nodes n ON n.id = e.source AND n.node_type = 'source' WHERE e.target IN (SELECT id FROM nodes)",
    "lineage_chain": f"WITH RECURSIVE {NODES}, known AS (SELECT * FROM edges WHERE target IN (SELECT id FROM nodes)), seen(node) AS (SELECT * FROM (VALUES ('nation:3'), ('nation:7')) UNION SELECT target FROM seen JOIN known ON source = node) SELECT DISTINCT source AS at, target AS id FROM known WHERE source IN (FROM seen)",
    "lineage_stats": f"WITH {NODES} SELECT 'node' AS kind, node_type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', operation, count(*) FROM edges GROUP BY 2",
    "lineage_orphans": f"WITH {NODES} SELECT id, src AS source FROM nodes WHERE node_type = 'transform' AND src NOT IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey < 3)",
    "lineage_mermaid": f"""WITH {NODES} SELECT 0 AS part, 0::BIGINT AS seq, 'graph LR' AS line
UNION ALL SELECT 1, seq, format(CASE node_type WHEN 'source' THEN '    {{}}(["{{}}"])' WHEN 'storage' THEN '    {{}}[("{{}}")]' ELSE '    {{}}["{{}}"]' END, replace(id, ':', '_'), name) FROM nodes
UNION ALL SELECT 2, seq, format('    {{}} -->|{{}}| {{}}', replace(source, ':', '_'), operation, replace(target, ':', '_')) FROM edges""",
    "lineage_first_nodes": "SELECT 'source' AS node_type, count(DISTINCT source) AS n, min(doc_id) AS first_seq FROM documents UNION ALL SELECT 'storage', 1, min(doc_id) FROM documents UNION ALL SELECT 'transform', count(DISTINCT doc_id), min(doc_id) FROM documents",
    "web_cache_lineage": "SELECT 'node' AS kind, 'source' AS name, count(DISTINCT url) AS n FROM pages UNION ALL SELECT 'node', 'transform', count(*) FROM pages UNION ALL SELECT 'node', 'storage', 1 UNION ALL SELECT 'edge', 'fetch_cache', count(*) FROM pages UNION ALL SELECT 'edge', 'ingest', count(*) FROM pages",
    "health_components": f"WITH {SIGNALS} SELECT name, round(score, 6) AS score, weight FROM components",
    "health_score": f"WITH {SIGNALS} SELECT round(overall, 6) AS overall, CASE WHEN overall >= 0.8 THEN 'healthy' WHEN overall >= 0.6 THEN 'warning' ELSE 'critical' END AS status FROM health",
    "health_alerts": f"""WITH {CHUNKS}, {chunk_profile()}, {RECORDS}, c AS (SELECT 'Data Quality' AS name, overall AS score, 0.35::DOUBLE AS weight FROM profile UNION ALL SELECT 'Freshness', avg(freshness_score), 0.2 FROM records), o AS (SELECT sum(score * weight) / sum(weight) AS overall FROM c)
SELECT 'health' AS kind, CASE WHEN overall < 0.4 THEN 'critical' ELSE 'warning' END AS level, 'Health below the threshold' AS title, 'Health is ' || printf('%.1f%%', overall * 100) || ', the threshold 95.0%' AS message FROM o WHERE overall < 0.95
UNION ALL SELECT 'component_' || name, 'warning', 'Low score: ' || name, name || ' is at ' || printf('%.1f%%', score * 100) FROM c WHERE score < 0.5""",
    "freshness_alerts": f"WITH {RECORDS}, s AS (SELECT {FRESH} FROM records) SELECT 'freshness_expired' AS kind, 'warning' AS level, expired_count || ' of ' || total || ' assets have expired' AS message FROM s WHERE expired_count > 0 UNION ALL SELECT 'freshness_stale', 'warning', stale_count || ' of ' || total || ' assets are stale' FROM s WHERE stale_count > total * 0.3",
    "dedup_alerts": f"WITH h AS (SELECT md5({normal('text')}) AS hash FROM documents), s AS (SELECT {STATS} FROM h) SELECT 'dedup' AS kind, 'warning' AS level, duplicate_count || ' of ' || total_items || ' items are duplicates' AS message FROM s WHERE duplicate_ratio > 0.1",
    "alert_summary": "SELECT count(*) AS total, count(*) FILTER (event_id % 3 = 2) AS critical, count(*) FILTER (event_id % 3 = 1) AS warning, count(*) FILTER (event_id % 3 = 0) AS info FROM events WHERE event_id % 4 <> 0",
    "health_trend": f"WITH {TREND} SELECT * FROM trend",
    "decisions": f"WITH {SIGNALS} SELECT seq, decision_type, severity, confidence, trigger FROM decisions",
    "action_plan": f"WITH {SIGNALS}, safe AS (SELECT *, decision_type IN ('delete_duplicates', 'delete_empty_chunks', 'enrich_metadata', 'normalize_paths', 'no_action') AS auto FROM decisions) SELECT count(*) AS decisions, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (auto) AS auto_executable, count(*) FILTER (NOT auto) AS needs_approval, round(least(0.3::DOUBLE, count(*) FILTER (decision_type <> 'no_action') * 0.05::DOUBLE), 6) AS estimated_improvement, (SELECT health < 0.5 FROM signal) AS auto_execute FROM safe",
    "governance_state": f"WITH {SIGNALS}, {TREND} SELECT round(health, 6) AS health_score, CASE WHEN health >= 0.8 THEN 'healthy' WHEN health >= 0.6 THEN 'degraded' WHEN health >= 0.4 THEN 'unhealthy' ELSE 'critical' END AS status, trend, round(quality, 6) AS quality_score, round(1 - duplicate_ratio, 6) AS uniqueness, round(avg_freshness, 6) AS freshness_score, round(pass_rate, 6) AS validation_pass_rate, dup > 0 AS needs_dedup, expired > 0 AS needs_cleanup, stale > 5 AS needs_review, errors > 0 AS needs_repair FROM signal, trend",
    "passports": f"WITH {PASSPORTS} SELECT asset_id, passport_id, round(quality_score, 6) AS quality_score, freshness_score, trust_level, assessment_count FROM pp",
    "passport_trust": f"WITH {PASSPORTS} SELECT trust_level, count(*) AS n FROM pp GROUP BY 1",
    "passport_stats": f"WITH {PASSPORTS} SELECT count(*) AS total, round(avg(quality_score), 6) AS avg_quality, count(*) FILTER (trust_level = 'quarantined') AS quarantined, count(*) FILTER (trust_level = 'verified') AS verified, count(*) FILTER (assessment_count > 0) AS assessed FROM pp",
    "trusted_only": f"WITH {PASSPORTS} SELECT asset_id, trust_level FROM pp WHERE trust_level IN ('trusted', 'verified')",
    "passport_context": f"WITH {PASSPORTS} SELECT asset_id, printf('[%s] trust=%s quality=%.2f freshness=%.2f source=%s', asset_id, trust_level, quality_score, freshness_score, coalesce(source, 'unknown')) AS line FROM pp",
    "embed_quality": f"WITH {EMBEDDED} SELECT ordinal, quality_score, gibberish_score, char_count, content_hash, is_quarantined, freshness_score FROM embedded",
    "quality_summary": f"WITH {EMBEDDED} SELECT count(*) AS total, 1.0::DOUBLE AS coverage, round(avg(quality_score), 6) AS avg_quality, min(quality_score) AS min_quality, max(quality_score) AS max_quality, round(count(*) FILTER (is_quarantined)::DOUBLE / count(*), 6) AS quarantine_rate, count(*) FILTER (quality_score >= 0.8) AS excellent, count(*) FILTER (quality_score >= 0.6 AND quality_score < 0.8) AS good, count(*) FILTER (quality_score >= 0.3 AND quality_score < 0.6) AS fair, count(*) FILTER (quality_score < 0.3) AS poor FROM embedded",
    "retrieval_filter": f"WITH {EMBEDDED} SELECT query_id, ordinal FROM results WHERE {_PASSES}",
    "search_gate": f"WITH {EMBEDDED} SELECT query_id, count(*) AS original, count(*) FILTER ({_PASSES}) AS kept, count(*) FILTER (NOT ({_PASSES})) AS removed FROM results GROUP BY 1",
    "noise_chunks": f"SELECT doc_id AS ordinal FROM documents WHERE length({strip('text')}) < 60",
    "quarantine_set": f"SELECT doc_id AS ordinal, CASE WHEN length({strip('text')}) = 0 THEN 'empty' ELSE 'gibberish' END AS reason FROM documents WHERE length({strip('text')}) = 0 OR {gibberish('text')} > 0.3",
}
