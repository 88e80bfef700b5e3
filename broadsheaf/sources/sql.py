"""The same views as common table expressions for the DuckDB oracles."""

PLACES = "places AS (SELECT n_nationkey AS ordinal, n_name AS place_id, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey)"

_FOLD = "strip_accents(lower(text))"
for _a, _b in {"ſ": "s", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ŋ": "ng", "ħ": "h"}.items():
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"
TOKENS = f"list_filter(string_split_regex({_FOLD}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"

PAGES = f"""{PLACES}, pg0 AS (
  SELECT doc_id, text, lang, source AS lccn, (DATE '1850-01-01' + (doc_id * 37 % 18262)::INT)::DATE AS date, (doc_id % 25)::INT AS ordinal, 1 AS edition,
    (doc_id % 8 + 1)::INT AS seq, 'batch_' || (doc_id % 5) AS batch, regexp_extract(source, '(\\d+)$', 1)::BIGINT AS title_ordinal, {TOKENS} AS tokens
  FROM documents
), pg AS (
  SELECT pg0.*, date_diff('day', DATE '1700-01-01', date) AS day, year(date) * 12 + month(date) - 1 AS ym, year(date) AS year, greatest((year(date) // 10) * 10, 1820) AS decade,
    seq = 1 AS front_page, (title_ordinal << 32) | (1 << 16) | seq AS sort_key, place_id, state,
    ' ' || array_to_string(list_transform(tokens, lambda x: CASE WHEN length(x) > 40 THEN '_' ELSE x END), ' ') || ' ' AS words
  FROM pg0 JOIN places USING (ordinal)
)"""

FACTS = f"""{PLACES}, f AS (
  SELECT o_orderkey AS page_id, o_orderdate::DATE AS date, c_mktsegment AS lccn, o_orderpriority AS language_set, o_totalprice AS price, o_custkey AS title_key, place_id, state
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = ordinal
)"""

SIGNALS = """s0 AS (
  SELECT *, (l_orderkey * 31 + l_linenumber * 17) % 100 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), s AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS doc_id, 't' || (l_suppkey % 40) AS lccn, o_orderdate::DATE AS date, ((year(o_orderdate) // 2) * 2)::INT AS decade, 'b' || (l_partkey % 30) AS batch, 1 AS edition, l_linenumber AS seq,
    CASE l_returnflag WHEN 'N' THEN 'eng' WHEN 'R' THEN 'ger' ELSE 'fre' END AS lang,
    CASE WHEN h < 5 THEN 'no_text' WHEN h < 12 THEN 'und' WHEN h < 20 THEN 'mixed' ELSE 'detected' END AS decision,
    CASE WHEN h >= 12 THEN round(l_discount * 4 + l_tax / 2, 6) END AS damage_rate, CASE WHEN l_quantity > 10 THEN round(1 - l_tax * 5, 6) END AS wc_mean,
    CASE WHEN l_linenumber <= 3 THEN round(l_discount + l_linenumber / 100, 6) END AS est_cer, CASE WHEN l_linenumber = 2 THEN NULL ELSE round(l_tax * 10, 6) END AS matched,
    CASE WHEN l_linenumber % 2 = 0 THEN round(l_discount * 3, 6) END AS local_cer, CASE WHEN l_orderkey % 3 > 0 THEN round(1 - l_discount * 5, 6) END AS dice,
    (l_quantity * 40)::BIGINT AS words, (l_quantity * 3)::BIGINT AS den, (CASE WHEN l_orderkey % 7 = 0 THEN l_linenumber % 3 ELSE 0 END)::BIGINT AS ocr_runs,
    (l_orderkey + l_linenumber) % 4 = 0 AS has_image_features, round(l_tax, 6) AS garbage_share, round(l_discount, 6) AS function_share
  FROM s0
)"""
