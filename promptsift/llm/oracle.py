"""SQL of the corpus queries that DuckDB can express: op3, op5, op10 and op12.

The others need XXH64 (op1), deflate (op2), code-point positions of matches and gamma tails
(op4), a tokenizer (op6, op7, op9), a trained model (op8), eigenvectors (op11) or slices of bytes
(op13); tests hold those against brute force.
"""

from __future__ import annotations

from promptsift.llm import quality, url_rules

_SAID = "'\\### Assistant: </turn> ok'"
_HASHES = "coalesce(list_sum(list_transform(regexp_extract_all({x}, '#{{3,}}'), lambda r: length(r))), 0)"


def _written(x: str) -> str:
    """Length of an escaped text."""
    return f"(length(replace(replace({x}, '\\', '\\\\'), '</turn>', '<\\/turn>')) + {_HASHES.format(x=x)})"


OP3 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + {_written('role')} + len(regexp_extract_all(role, ': ')) + 2 + {_written('text')} + 9) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

_SPACE = r"[\x20\x09-\x0D]+"


def _repeated(n: int) -> str:
    """doc_id, and the words and characters inside n-grams that occur twice or more in their text."""
    return f"""SELECT doc_id, count(*) AS words, sum(size) AS bytes FROM (
      SELECT doc_id, k, any_value(size) AS size FROM (
        SELECT w.doc_id, w.k, w.size FROM word_rows w JOIN (
          SELECT doc_id, first FROM (SELECT doc_id, first, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (
            SELECT doc_id, first, array_to_string(words[first:first + {n - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS first FROM texts WHERE len(words) > {n}))) WHERE n > 1
        ) g ON g.doc_id = w.doc_id AND w.k BETWEEN g.first AND g.first + {n - 1}) GROUP BY doc_id, k) GROUP BY doc_id"""


def _op5() -> str:
    sizes = list(quality.COVERAGE.items())
    joins = "".join(f" LEFT JOIN ({_repeated(n)}) g{n} USING (doc_id)" for n, _ in sizes)
    worst = ", ".join(f"coalesce(g{n}.bytes, 0) / greatest(1, total) / {most}" for n, most in sizes)
    return f"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') AS words FROM documents),
word_rows AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(words) + 1)) AS k, length(unnest(words)) AS size FROM texts),
totals AS (SELECT doc_id, sum(size) AS total FROM word_rows GROUP BY doc_id),
lines AS (SELECT doc_id, k, line, regexp_replace(line, '{_SPACE}', '', 'g') AS body FROM (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM texts))),
dups AS (SELECT doc_id, count(*) AS n, sum(length(body)) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM lines WHERE body <> '') WHERE nth > 1 GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(texts.words) AS BIGINT) AS n_words, CAST(length(array_to_string(texts.words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(g.words, 0) AS BIGINT) AS n_repeat_words, coalesce(d.bytes, 0) / greatest(1, coalesce(total, 0)) AS line_coverage, greatest(0.0::DOUBLE, {worst}) AS coverage
  FROM texts LEFT JOIN totals USING (doc_id) LEFT JOIN dups d USING (doc_id) LEFT JOIN ({_repeated(quality.WINDOW)}) g USING (doc_id){joins}),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coverage <= 1 AND line_coverage <= {quality.LINE_COVERAGE} AND n_symbols <= {quality.SYMBOLS} * n_words AS kept, coverage, line_coverage
FROM judged"""


def _op10() -> str:
    ranked = sorted(url_rules.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, says) for h, p, says in ranked]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for c, name, _ in fits) + " END"
    listed = "CASE " + " ".join(f"WHEN {c} THEN '{says}'" for c, _, says in fits) + " END"
    low = f"translate(host_part, '{url_rules._UPPER}', '{url_rules._LOWER}')"
    part = "list_transform(list_filter({xs}, lambda x: NOT regexp_full_match(x, '[0-9]*')), lambda x: '{mark}' || x)"
    parts = [part.format(xs=xs, mark=mark) for mark, xs in (("h:", "string_split(host, '.')"), ("p:", "regexp_split_to_array(lower(path), '[/.]')"), ("q:", "string_split(lower(query), '&')"))]
    return f"""
WITH rests AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host_part, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '\\?([^#]*)', 1) AS query FROM rests),
seen AS MATERIALIZED (SELECT row_number() OVER () AS row, page_id, url, host, path, {rule} AS rule, {listed} AS listed, list_distinct(list_concat({', '.join(parts)})) AS own FROM (SELECT *, {low} AS host FROM split)),
by_page AS (SELECT doc_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
known AS MATERIALIZED (SELECT row, own, bad FROM seen JOIN by_page ON doc_id = page_id),
bound AS (SELECT count(*) AS n, ceil(greatest({url_rules.SUPPORT}, {url_rules.LEAST} / greatest(1, count(*))) * count(*) - 1e-9) AS least FROM known),
sets AS (SELECT list_sort(list_filter(own, lambda t, i: (mask >> (i - 1)) & 1 = 1)) AS tokens, bad FROM (SELECT own, bad, unnest(range(1, 1 << len(own))) AS mask FROM known)),
rules AS MATERIALIZED (SELECT tokens FROM sets, bound GROUP BY tokens, n, least HAVING n >= {url_rules.LEAST} AND count(*) FILTER (bad) >= least AND count(*) FILTER (bad) >= {url_rules.CONFIDENCE} * count(*)),
hits AS (SELECT DISTINCT row FROM seen JOIN rules ON list_has_all(own, tokens))
SELECT page_id, host, path, rule, coalesce(listed, CASE WHEN h.row IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM seen s LEFT JOIN hits h USING (row)"""


OP12 = """
WITH own AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM own a JOIN own b ON a.id % 50 = 0 AND a.id <> b.id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE same) WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score) WHERE rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_examples": OP3, "op5_quality_rules": _op5(), "op10_url_rules": _op10(), "op12_hard_negatives": OP12}
