"""The registered queries in DuckDB's SQL, for the engine that checks them.

RE2 has neither look-around nor Unicode word borders: where a pattern needs a border, the
neighbouring characters are captured and put back, and the replacement is made twice.
"""

from __future__ import annotations

from promptsift.functions import pinning, tools
from promptsift.plans.inputs import QUERY

BORDER = r"[^\pL\pM\pN_]"
STAMP = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"


def tok(x: str) -> str:
    return f"CAST(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END AS BIGINT)"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, 'g')"


def normalized(x: str) -> str:
    x = f"replace({sub(x, chr(92) + 'x1b' + chr(92) + '[[0-9;?]*[ -/]*[@-~]', chr(39) * 2)}, chr(13), '')"
    return sub(sub(sub(x, r"[ \t]+", "' '"), r"(?m)[ \t]+$", "''"), r"\n{3,}", "chr(10) || chr(10)")


def template(x: str) -> str:
    x = sub(x, STAMP, "'<TS>'")
    for pattern, mark in (("[0-9a-fA-F]{8,}", "<HEX>"), (r"\p{Nd}+", "<N>")):
        for _ in range(2):
            x = sub(x, f"(^|{BORDER}){pattern}({BORDER}|$)", rf"'\1{mark}\2'")
    return x


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9_]+')"


def sentences(x: str) -> str:
    marked = sub(x, r"([.!?])\s+([A-Z])", r"'\1' || chr(1) || '\2'")
    parts = f"regexp_split_to_array({marked}, '[\\x01]|\\n+')"
    return f"list_filter(list_transform({parts}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def chunk_id(source: str, x: str) -> str:
    return f"{source} || ':' || substr(sha1({x}), 1, 8)"


NOISY = "chr(27) || '[31m' || replace(text, '. ', '.   ' || chr(9) || repeat(chr(10), 4)) || chr(27) || '[0m  ' || chr(13) || chr(10) || ' tail' || chr(9) || ' ' || chr(10)"
LINES = "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
EVENT_LINE = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z svc[' || user_id || '] ' || upper(event_type)"
BY_SOURCE = "SELECT d.source AS request_id, d.doc_id AS pos, d.text, d.lang AS source, CASE WHEN t.toxic = 1 THEN 0 ELSE 1 END AS tier, CAST(NULL AS DOUBLE) AS relevance FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) t USING (doc_id)"
TURNS = "SELECT CAST(conv_id AS VARCHAR) AS request_id, turn AS pos, text, role AS source FROM conversations"
EVENT_LOGS = f"SELECT CAST(user_id AS VARCHAR) AS request_id, string_agg({EVENT_LINE}, chr(10) ORDER BY event_type, ts, event_id) AS text FROM events GROUP BY user_id"
ORDERS = "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey"


def deduplicated(rows: str) -> str:
    """Of rows (id, text): id and text, by runs of lines."""
    return f"""
    SELECT id, string_agg(CASE WHEN n = 1 THEN line ELSE line || '   (x' || n || ')' END, chr(10) ORDER BY run) AS text FROM (
      SELECT id, run, arg_min(line, line_no) AS line, count(*) AS n FROM (
        SELECT id, line_no, line, sum(fresh) OVER (PARTITION BY id ORDER BY line_no) AS run FROM (
          SELECT id, line_no, line, CASE WHEN key IS NOT DISTINCT FROM lag(key) OVER (PARTITION BY id ORDER BY line_no) AND line_no > 0 THEN 0 ELSE 1 END AS fresh FROM (
            SELECT id, line_no, line, {template('line')} AS key FROM (
              SELECT id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT id, string_split(text, chr(10)) AS l FROM ({rows}))))))
      GROUP BY id, run) GROUP BY id"""


def log_runs(lines: str) -> str:
    """Of lines (id, line_no, line): id, first, line and n of each run of one template."""
    return f"""
    SELECT id, min(line_no) AS first, arg_min(line, line_no) AS line, count(*) AS n FROM (
      SELECT id, line_no, line, sum(fresh) OVER (PARTITION BY id ORDER BY line_no) AS run FROM (
        SELECT id, line_no, line, CASE WHEN key = lag(key) OVER (PARTITION BY id ORDER BY line_no) THEN 0 ELSE 1 END AS fresh FROM (
          SELECT id, line_no, line, {template('line')} AS key FROM ({lines})))) GROUP BY id, run"""


WHOLE_LOG = f"SELECT 'all' AS id, event_id AS line_no, {EVENT_LINE} AS line FROM events"
DOCUMENT_LOGS = f"SELECT CAST(doc_id AS VARCHAR) AS id, line_no, line FROM ({LINES})"


def query_scores(docs: str, query: str) -> str:
    """Of docs (request_id, pos, text), all with the same query: request_id, pos, score."""
    return f"""
    WITH docs AS ({docs}), counts AS (
      SELECT request_id, pos, term, count(*) AS c FROM (SELECT request_id, pos, unnest({terms('text')}) AS term FROM docs) GROUP BY ALL
    ), asked AS (SELECT term, count(*) AS q FROM (SELECT unnest({terms("'" + query + "'")}) AS term) GROUP BY term),
    sizes AS (SELECT request_id, count(*) + 1 AS n FROM docs GROUP BY request_id),
    having_ AS (SELECT request_id, term, count(*) AS h FROM counts GROUP BY ALL),
    every AS (SELECT request_id, term FROM having_ UNION SELECT request_id, term FROM sizes, asked),
    weights AS (
      SELECT e.request_id, e.term, coalesce(q, 0) AS q, ln((n + 1) / (coalesce(h, 0) + CASE WHEN q IS NULL THEN 0 ELSE 1 END + 1)) + 1 AS idf
      FROM every e JOIN sizes USING (request_id) LEFT JOIN having_ USING (request_id, term) LEFT JOIN asked USING (term)),
    lengths AS (SELECT request_id, sqrt(sum(q * idf * q * idf)) AS qn FROM weights GROUP BY request_id),
    by_doc AS (SELECT request_id, pos, sqrt(sum(c * idf * c * idf)) AS dn, sum(c * idf * q * idf) AS dot FROM counts JOIN weights USING (request_id, term) GROUP BY ALL)
    SELECT request_id, pos, coalesce(CASE WHEN dn * qn > 0 THEN dot / (dn * qn) ELSE 0 END, 0) AS score FROM docs LEFT JOIN by_doc USING (request_id, pos) LEFT JOIN lengths USING (request_id)"""


def centrality(parts: str) -> str:
    """Of parts (id, pos, text): id, pos, score."""
    return f"""
    WITH parts AS ({parts}), counts AS (
      SELECT id, pos, term, count(*) AS c FROM (SELECT id, pos, unnest({terms('text')}) AS term FROM parts) GROUP BY ALL
    ), sizes AS (SELECT id, count(*) AS n FROM parts GROUP BY id),
    weighted AS (SELECT id, pos, term, n, c * (ln((n + 1) / (count(*) OVER (PARTITION BY id, term) + 1)) + 1) AS w FROM counts JOIN sizes USING (id)),
    unit AS (SELECT id, pos, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY id, pos)) AS u FROM weighted),
    dots AS (SELECT id, pos, max(n) AS n, sum(u * total) AS dot FROM (SELECT *, sum(u) OVER (PARTITION BY id, term) AS total FROM unit) GROUP BY ALL)
    SELECT id, pos, coalesce(CASE WHEN n > 1 THEN (dot - 1) / (n - 1) ELSE 0 END, 0) AS score FROM parts LEFT JOIN dots USING (id, pos)"""


def topk(scores: str, keep: int, extra: str) -> str:
    """The relevance stage: only requests with more than keep candidates are ranked."""
    return f"""
    WITH scores AS MATERIALIZED ({scores}), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, pos) AS place, count(*) OVER (PARTITION BY request_id) AS n FROM scores)
    {extra.replace('KEEP', str(keep))}"""


def filled(chunks: str, cap: int) -> str:
    """Of chunks (request_id, pos, text, tier, relevance): the budget's verdicts."""
    return f"""
    WITH RECURSIVE sized AS MATERIALIZED (SELECT request_id, pos, tier, {tok('text')} AS tokens, round(coalesce(relevance, 0), 9) AS relevance FROM ({chunks})),
    start AS (SELECT request_id, greatest(0, {cap} - sum(CASE WHEN tier = 0 THEN tokens ELSE 0 END)) AS room FROM sized GROUP BY request_id),
    ordered AS MATERIALIZED (SELECT request_id, pos, tokens, row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC, pos) AS n FROM sized WHERE tier IN (1, 2)),
    walk AS (
      SELECT request_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS pos, '' AS verdict, CAST(room AS BIGINT) AS room, CAST(room AS BIGINT) AS left_ FROM start
      UNION ALL
      SELECT w.request_id, o.n, o.pos, CASE WHEN o.tokens <= left_ THEN 'keep' WHEN left_ >= 100 THEN 'head' ELSE 'defer' END, left_,
        CASE WHEN o.tokens <= left_ THEN left_ - o.tokens WHEN left_ >= 100 THEN 0 ELSE left_ END
      FROM walk w JOIN ordered o ON o.request_id = w.request_id AND o.n = w.n + 1)
    SELECT request_id, pos, verdict, room, n - 1 AS place FROM walk WHERE n > 0"""


def assembled(chunks: str, order: str = "pos") -> str:
    """Of chunks (request_id, pos, text, source, tier): one row for each request."""
    return f"""
    WITH chunks AS MATERIALIZED ({chunks}), sections AS (
      SELECT request_id, min(pos) AS first, '### ' || source || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY pos) AS section FROM chunks WHERE tier < 3 GROUP BY request_id, source),
    bodies AS (SELECT request_id, string_agg(section, chr(10) || chr(10) ORDER BY first) AS body FROM sections GROUP BY request_id),
    outs AS (
      SELECT request_id, count(*) FILTER (tier = 3) AS deferred, string_agg(DISTINCT source, ', ' ORDER BY source) FILTER (tier = 3) AS sources,
        string_agg({chunk_id('source', 'text')}, ',' ORDER BY {order}) FILTER (tier = 3) AS ids, count(DISTINCT {chunk_id('source', 'text')}) FILTER (tier = 3) AS entries FROM chunks GROUP BY request_id)
    SELECT request_id, deferred, coalesce(ids, '') AS deferred_ids, entries, coalesce(body, '') || CASE WHEN deferred > 0 THEN
      chr(10) || chr(10) || '### deferred (' || deferred || ' chunks)' || chr(10) || 'Sources omitted: ' || sources || '.' || chr(10) || 'Retrievable on request by id.' ELSE '' END AS prompt
    FROM outs LEFT JOIN bodies USING (request_id)"""


CALLS = """SELECT event_id, CAST(user_id AS VARCHAR) AS session, epoch_us(ts) AS micros,
  CASE event_type WHEN 'view' THEN 'view' WHEN 'signup' THEN 'bash' WHEN 'error' THEN 'mcp:logs' WHEN 'click' THEN 'read_file' ELSE 'sql' END AS tool,
  CASE event_id % 5 WHEN 0 THEN '  kubectl get pods' WHEN 1 THEN 'psql -c x' WHEN 2 THEN 'ls -l' WHEN 3 THEN 'aws s3 ls | promptsift --budget 9' ELSE 'curl http://x' END AS command,
  CAST(floor(value * 10) AS BIGINT) AS tokens, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(value * 10) AS BIGINT) // 10 END AS cleaned FROM events"""


def sessions(ttl: float) -> str:
    """The gate over each session's calls in order, with a limit of 3000 for a call and 4000 together."""
    alive = f"updated_at >= o.t - {ttl}"
    return f"""
    WITH RECURSIVE ordered AS MATERIALIZED (
      SELECT session, micros / 1e6 AS t, tool, tokens, cleaned, row_number() OVER (PARTITION BY session ORDER BY micros, tool, tokens) AS n FROM ({CALLS})),
    walk AS (
      SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS t, '' AS verdict, '' AS reason, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS views, false AS nudged, false AS sent, CAST('-infinity' AS DOUBLE) AS updated_at FROM ordered
      UNION ALL
      SELECT session, n, t, verdict, reason,
        CASE WHEN verdict IN ('under-threshold', 'injection-only') THEN was + tokens WHEN verdict = 'fired' THEN was + cleaned ELSE was END,
        seen, nudge, sent_now,
        CASE WHEN verdict = 'skipped' OR (NOT is_view AND verdict IN ('funnel-empty', 'funnel-noop')) THEN updated_at ELSE t END
      FROM (
        SELECT *, CASE WHEN tool = 'sql' THEN 'skipped' WHEN reason = '' THEN CASE WHEN nudge THEN 'injection-only' ELSE 'under-threshold' END
            WHEN cleaned IS NULL THEN 'funnel-empty' WHEN cleaned >= tokens THEN 'funnel-noop' ELSE 'fired' END AS verdict
        FROM (
          SELECT *, CASE WHEN tool = 'sql' THEN 'internal-bookkeeping' WHEN tokens >= 3000 THEN 'per-call' WHEN was + tokens >= 4000 THEN 'cumulative' ELSE '' END AS reason,
            is_view AND seen >= 4 AND NOT sent_was AS nudge, sent_was OR (is_view AND seen >= 4) AS sent_now
          FROM (
            SELECT o.session, o.n, o.t, o.tool, o.tokens, o.cleaned, w.updated_at, o.tool IN ('view', 'read_file') AS is_view,
              CASE WHEN {alive} THEN w.total ELSE 0 END AS was,
              CASE WHEN {alive} THEN w.views ELSE 0 END + CASE WHEN o.tool IN ('view', 'read_file') THEN 1 ELSE 0 END AS seen,
              CASE WHEN {alive} THEN w.sent ELSE false END AS sent_was
            FROM walk w JOIN ordered o ON o.session = w.session AND o.n = w.n + 1))))
    SELECT session, round(t, 3) AS at, verdict, reason, total, views, nudged FROM walk WHERE n > 0"""


def views() -> str:
    """Views with files: their summaries come once, where event_id isn't a multiple of 3."""
    return f"""
    WITH RECURSIVE ordered AS MATERIALIZED (
      SELECT session, event_id, tokens, cleaned, CASE WHEN event_id % 4 <> 0 THEN 'f' || (event_id % 3) ELSE '' END AS path, event_id % 3 <> 0 AS worth,
        row_number() OVER (PARTITION BY session ORDER BY micros, tokens, CAST(event_id AS VARCHAR)) AS n FROM ({CALLS})),
    walk AS (
      SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, '' AS verdict, '' AS reason, CAST(0 AS BIGINT) AS total, false AS nudged, '' AS file, CAST([] AS VARCHAR[]) AS seen FROM ordered
      UNION ALL
      SELECT session, n, event_id, CASE WHEN tokens < 3000 THEN CASE WHEN nudged OR file = 'summary-computed' THEN 'injection-only' ELSE 'under-threshold' END
          WHEN cleaned IS NULL THEN 'funnel-empty' WHEN cleaned >= tokens THEN 'funnel-noop' ELSE 'fired' END,
        CASE WHEN tokens < 3000 THEN '' ELSE 'per-call' END,
        was + CASE WHEN tokens < 3000 THEN tokens WHEN cleaned < tokens THEN cleaned ELSE 0 END, nudged, file, CASE WHEN path = '' THEN seen ELSE list_append(seen, path) END
      FROM (
        SELECT o.session, o.n, o.event_id, o.tokens, o.cleaned, o.path, w.total AS was, o.n = 3 AS nudged, w.seen,
          CASE WHEN o.path = '' THEN '' WHEN list_contains(w.seen, o.path) THEN 'summary-already-shown' WHEN o.worth THEN 'summary-computed' ELSE 'summary-skipped' END AS file
        FROM walk w JOIN ordered o ON o.session = w.session AND o.n = w.n + 1))
    SELECT session, event_id, verdict, reason, total, n AS views, nudged, file FROM walk WHERE n > 0"""


def tool_answers(results: str) -> str:
    """Of results (event_id, session, turn, result, prompt): decisions with a limit of 150 tokens; every second view's session gets its tip."""
    tip = "'[promptsift tip: 2" + tools.NUDGE.replace("'", "''") + "'"
    heading = "'[promptsift: ' || tokens || ' → ' || cleaned || ' tok | tool=' || tool || ' profile=' || CASE WHEN tool = 'bash' AND turn % 2 = 1 THEN 'k8s' ELSE 'passthrough' END || ']' || chr(10) || prompt"
    gap = "chr(10) || chr(10)"
    return f"""
    WITH sized AS (
      SELECT *, CASE turn % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'bash' ELSE 'sql' END AS tool, length(result) // 4 AS tokens, length(prompt) // 4 AS cleaned, length(prompt) < length(result) AS shrinks FROM ({results})),
    told AS (
      SELECT *, tool = 'view' AND sum(CASE WHEN tool = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn) = 2 AS nudged,
        CASE WHEN tool = 'sql' THEN 'skipped' WHEN tokens >= 150 THEN CASE WHEN shrinks THEN 'fired' ELSE 'funnel-noop' END ELSE '' END AS base FROM sized),
    decided AS (
      SELECT *, CASE WHEN base <> '' THEN base WHEN nudged THEN 'injection-only' ELSE 'under-threshold' END AS verdict, CASE base WHEN 'skipped' THEN 'internal-bookkeeping' WHEN '' THEN '' ELSE 'per-call' END AS reason FROM told),
    said AS (
      SELECT *, CASE verdict WHEN 'fired' THEN CASE WHEN nudged THEN {tip} || {gap} ELSE '' END || {heading} WHEN 'injection-only' THEN {tip} || {gap} || result END AS replacement,
        sum(CASE WHEN verdict IN ('under-threshold', 'injection-only') THEN tokens WHEN verdict = 'fired' THEN cleaned ELSE 0 END) OVER (PARTITION BY session ORDER BY turn) AS total FROM decided)
    SELECT event_id, session, verdict, reason, CAST(total AS BIGINT) AS total, nudged, replacement, replacement AS answered FROM said"""


def lite_prompts(rows: str, cap: int, source: str, log: bool = True, then: str = "text") -> str:
    """Of rows (id, text), texts of one block, logs or not: what the lite funnel makes of each; tokens before the budget; then: another stage."""
    clean = f"SELECT id, {normalized('text')} AS text FROM ({rows})"
    clean = f"SELECT id, {then} AS text FROM ({deduplicated(clean) if log else clean})"
    head = "regexp_replace(substr(text, 1, CAST(room * 4 AS BIGINT)), '\\s+$', '') || chr(10) || chr(10) || '[... +' || (tokens - room) || ' tokens truncated. Full source retrievable as ' || " + chunk_id("source", "text") + " || '.]'"
    return f"""
    SELECT id, tokens, {head} AS head, CASE WHEN tokens <= {cap} THEN 0 ELSE 1 END AS deferred,
      '### {source}' || chr(10) || chr(10) || CASE WHEN tokens <= {cap} THEN text
        ELSE {head} || chr(10) || chr(10) || '### deferred (1 chunks)' || chr(10) || 'Sources omitted: {source}.' || chr(10) || 'Retrievable on request by id.' END AS prompt
    FROM (SELECT id, text, {cap} AS room, '{source}' AS source, {tok('text')} AS tokens FROM ({clean}))"""


JUDGE_QUERY = "the session and of retry then"
WORDS = "list_distinct(list_transform(list_filter(regexp_extract_all({}, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2), lambda w: lower(w)))"


def judge(contexts: str) -> str:
    """CTEs over contexts (case_id, context): lines, best (with place), answers."""
    asked = WORDS.format(f"'{JUDGE_QUERY}'")
    return f"""
    contexts AS MATERIALIZED ({contexts}),
    lines AS MATERIALIZED (SELECT case_id, unnest(range(len(l))) AS idx, unnest(l) AS line FROM (SELECT case_id, string_split(regexp_replace(context, '\\n$', ''), chr(10)) AS l FROM contexts WHERE length(context) > 0)),
    best AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, idx) AS place FROM (
        SELECT case_id, idx, CAST(len(list_intersect({asked}, {WORDS.format('line')})) AS BIGINT) AS score FROM lines) WHERE score > 0) WHERE place <= 3),
    near AS (SELECT DISTINCT l.case_id, l.idx, regexp_replace(l.line, '^\\s+|\\s+$', '', 'g') AS line FROM lines l JOIN best b ON l.case_id = b.case_id AND l.idx BETWEEN b.idx - 2 AND b.idx + 2),
    found AS (SELECT case_id, coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (line <> ''), '') AS answer FROM near GROUP BY case_id),
    firsts AS (SELECT case_id, arg_min(line, idx) AS line FROM (SELECT case_id, idx, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM lines) WHERE line <> '' GROUP BY case_id),
    answers AS (SELECT c.case_id, CASE WHEN length(context) = 0 THEN '' ELSE coalesce(f.answer, s.line, '') END AS answer FROM contexts c LEFT JOIN found f USING (case_id) LEFT JOIN firsts s USING (case_id))"""


STORE = f"""SELECT '{'w'}' AS w, request_id, {chunk_id('source', 'text')} AS chunk_id, text, 'text' AS kind, source, {tok('text')} AS tokens, 1000000.0::DOUBLE - pos * 600 AS stored_at, pos + 1 AS seq FROM ({TURNS})
  UNION ALL SELECT 'w', request_id, {chunk_id('source', 'text')}, text, 'text', source, {tok('text')}, 1000000.0::DOUBLE - 60, row_number() OVER (PARTITION BY request_id ORDER BY pos) FROM ({TURNS}) WHERE pos % 3 = 0"""
CURRENT = "SELECT request_id, chunk_id, arg_max(text, (stored_at, seq)) AS text, arg_max(kind, (stored_at, seq)) AS kind, arg_max(source, (stored_at, seq)) AS source, arg_max(tokens, (stored_at, seq)) AS tokens, max(stored_at) AS stored_at FROM ({}) GROUP BY request_id, chunk_id"
ALIVE = f"SELECT * FROM ({STORE}) WHERE 1000000.0 - stored_at <= 3600"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def oracle_sql() -> dict[str, str]:
    low = "lower(text)"
    severity = f"CASE WHEN upper(coalesce(event_type, '')) IN {_in(pinning.CRITICAL_SEVERITIES)} THEN 0 ELSE 1 END"
    left = "regexp_replace(command, '^\\s+', '')"
    noisy = f"regexp_matches({left}, '(?i)^({tools.NOISY}) ')"
    profile = "CASE " + " ".join(f"WHEN regexp_matches({left}, '^({'|'.join(v)})') THEN '{k}'" for k, v in tools.PROFILES_BY_COMMAND.items()) + " ELSE 'passthrough' END"
    head = "regexp_replace(substr(text, 1, CAST(room * 4 AS BIGINT)), '\\s+$', '') || chr(10) || chr(10) || '[... +' || (tokens - room) || ' tokens truncated. Full source retrievable as ' || " + chunk_id("source", "text") + " || '.]'"
    return f"""
    SELECT id, tokens, {head} AS head, CASE WHEN tokens <= {cap} THEN 0 ELSE 1 END AS deferred,
      '### {source}' || chr(10) || chr(10) || CASE WHEN tokens <= {cap} THEN text
        ELSE {head} || chr(10) || chr(10) || '### deferred (1 chunks)' || chr(10) || 'Sources omitted: {source}.' || chr(10) || 'Retrievable on request by id.' END AS prompt
    FROM (SELECT id, text, {cap} AS room, '{source}' AS source, {tok('text')} AS tokens FROM ({clean}))"""


JUDGE_QUERY = "the session and of retry then"
WORDS = "list_distinct(list_transform(list_filter(regexp_extract_all({}, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2), lambda w: lower(w)))"


def judge(contexts: str) -> str:
    """CTEs over contexts (case_id, context): lines, best (with place), answers."""
    asked = WORDS.format(f"'{JUDGE_QUERY}'")
    return f"""
    contexts AS MATERIALIZED ({contexts}),
    lines AS MATERIALIZED (SELECT case_id, unnest(range(len(l))) AS idx, unnest(l) AS line FROM (SELECT case_id, string_split(regexp_replace(context, '\\n$', ''), chr(10)) AS l FROM contexts WHERE length(context) > 0)),
    best AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, idx) AS place FROM (
        SELECT case_id, idx, CAST(len(list_intersect({asked}, {WORDS.format('line')})) AS BIGINT) AS score FROM lines) WHERE score > 0) WHERE place <= 3),
    near AS (SELECT DISTINCT l.case_id, l.idx, regexp_replace(l.line, '^\\s+|\\s+$', '', 'g') AS line FROM lines l JOIN best b ON l.case_id = b.case_id AND l.idx BETWEEN b.idx - 2 AND b.idx + 2),
    found AS (SELECT case_id, coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (line <> ''), '') AS answer FROM near GROUP BY case_id),
    firsts AS (SELECT case_id, arg_min(line, idx) AS line FROM (SELECT case_id, idx, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM lines) WHERE line <> '' GROUP BY case_id),
    answers AS (SELECT c.case_id, CASE WHEN length(context) = 0 THEN '' ELSE coalesce(f.answer, s.line, '') END AS answer FROM contexts c LEFT JOIN found f USING (case_id) LEFT JOIN firsts s USING (case_id))"""


STORE = f"""SELECT '{'w'}' AS w, request_id, {chunk_id('source', 'text')} AS chunk_id, text, 'text' AS kind, source, {tok('text')} AS tokens, 1000000.0::DOUBLE - pos * 600 AS stored_at, pos + 1 AS seq FROM ({TURNS})
  UNION ALL SELECT 'w', request_id, {chunk_id('source', 'text')}, text, 'text', source, {tok('text')}, 1000000.0::DOUBLE - 60, row_number() OVER (PARTITION BY request_id ORDER BY pos) FROM ({TURNS}) WHERE pos % 3 = 0"""
CURRENT = "SELECT request_id, chunk_id, arg_max(text, (stored_at, seq)) AS text, arg_max(kind, (stored_at, seq)) AS kind, arg_max(source, (stored_at, seq)) AS source, arg_max(tokens, (stored_at, seq)) AS tokens, max(stored_at) AS stored_at FROM ({}) GROUP BY request_id, chunk_id"
ALIVE = f"SELECT * FROM ({STORE}) WHERE 1000000.0 - stored_at <= 3600"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def oracle_sql() -> dict[str, str]:
    low = "lower(text)"
    severity = f"CASE WHEN upper(coalesce(event_type, '')) IN {_in(pinning.CRITICAL_SEVERITIES)} THEN 0 ELSE 1 END"
    left = "regexp_replace(command, '^\\s+', '')"
    noisy = f"regexp_matches({left}, '(?i)^({tools.NOISY}) ')"
    profile = "CASE " + " ".join(f"WHEN regexp_matches({left}, '^({'|'.join(v)})') THEN '{k}'" for k, v in tools.PROFILES_BY_COMMAND.items()) + " ELSE 'passthrough' END"
    lite = f"SELECT request_id, 0 AS pos, text, 'events' AS source, 1 AS tier FROM (SELECT id AS request_id, text FROM ({deduplicated(f'SELECT request_id AS id, {normalized("text")} AS text FROM ({EVENT_LOGS})')}))"
    head = "regexp_replace(substr(text, 1, CAST(room * 4 AS BIGINT)), '\\s+$', '') || chr(10) || chr(10) || '[... +' || (" + tok("text") + " - room) || ' tokens truncated. Full source retrievable as ' || " + chunk_id("source", "text") + " || '.]'"
    # every stage of the full funnel, on texts (neither logs nor JSON)
    cleaned = f"SELECT request_id, pos, {normalized('text')} AS text, source, tier FROM ({BY_SOURCE})"
    ranked = topk(query_scores(f"SELECT * FROM ({cleaned}) WHERE tier = 1", QUERY), 5, f"""
      SELECT c.request_id, c.pos, c.text, c.source, CASE WHEN n > KEEP AND place > KEEP THEN 3 ELSE c.tier END AS tier, CASE WHEN n > KEEP THEN score END AS relevance FROM ({cleaned}) c LEFT JOIN ranked r USING (request_id, pos)""")
    funnel = f"""
    WITH kept AS MATERIALIZED ({ranked}), long AS MATERIALIZED (SELECT request_id || '/' || pos AS id, request_id, pos, {sentences('text')} AS s FROM kept WHERE tier = 1 AND {tok('text')} >= 120),
    parts AS MATERIALIZED (SELECT id, request_id, pos AS chunk, unnest(range(len(s))) AS pos, unnest(s) AS text, len(s) AS size FROM long),
    near AS MATERIALIZED ({query_scores('SELECT id AS request_id, pos, text FROM parts', QUERY)}), central AS MATERIALIZED ({centrality('SELECT id, pos, text FROM parts')}),
    best AS (SELECT p.*, row_number() OVER (PARTITION BY p.id ORDER BY round(0.5 * n.score + 0.5 * c.score, 9) DESC, p.pos) AS place FROM parts p JOIN near n ON n.request_id = p.id AND n.pos = p.pos JOIN central c ON c.id = p.id AND c.pos = p.pos),
    summaries AS (SELECT request_id, chunk AS pos, string_agg(text, ' ' ORDER BY pos) AS summary FROM best WHERE size > 1 AND place <= greatest(1, round_even(size * 0.4, 0)) GROUP BY request_id, chunk),
    short AS MATERIALIZED (
      SELECT request_id, pos, coalesce(summary, text) AS text, source, CASE WHEN id IS NULL THEN tier ELSE 2 END AS tier, relevance
      FROM kept LEFT JOIN summaries USING (request_id, pos) LEFT JOIN (SELECT id, request_id, pos FROM long) USING (request_id, pos)),
    verdicts AS MATERIALIZED ({filled('SELECT * FROM short', 4000)}),
    done AS MATERIALIZED (
      SELECT request_id, pos, -1 AS seq, CASE WHEN verdict = 'head' THEN {head} ELSE text END AS text, source, tier FROM short LEFT JOIN verdicts USING (request_id, pos) WHERE verdict IS NULL OR verdict <> 'defer'
      UNION ALL SELECT request_id, pos, place, text, source, 3 FROM short JOIN verdicts USING (request_id, pos) WHERE verdict <> 'keep'),
    over AS (SELECT request_id, coalesce(sum({tok('text')}) FILTER (tier = 0), 0) > 4000 AS critical_overflow FROM short GROUP BY request_id)
    SELECT request_id, prompt, deferred, deferred_ids, critical_overflow FROM ({assembled('SELECT * FROM done', 'seq, pos')}) JOIN over USING (request_id)"""
    budgeted = f"""WITH chunks AS MATERIALIZED ({BY_SOURCE}), verdicts AS MATERIALIZED ({filled(BY_SOURCE, 4000)})
      SELECT request_id, pos, tier, CAST(NULL AS BIGINT) AS seq, CASE WHEN verdict = 'head' THEN {head} ELSE text END AS text, coalesce(verdict = 'head', false) AS truncated,
        CASE WHEN verdict = 'head' THEN {tok('text')} END AS original_tokens, CASE WHEN verdict = 'head' THEN room END AS kept_tokens
      FROM chunks LEFT JOIN verdicts USING (request_id, pos) WHERE verdict IS NULL OR verdict <> 'defer'
      UNION ALL SELECT request_id, pos, 3, place, text, false, NULL, NULL FROM chunks JOIN verdicts USING (request_id, pos) WHERE verdict <> 'keep'"""
    logs = lite_prompts(f"SELECT request_id AS id, text FROM ({EVENT_LOGS})", 4000, "events")
    documents = lite_prompts("SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents", 200, "in/0", False)
    crash = f"""SELECT CAST(user_id AS VARCHAR) AS id, string_agg(strftime(moment, '%Y-%m-%dT%H:%M:%S') || CASE WHEN micros % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(micros % 1000000 AS VARCHAR), 6, '0') END
        || 'Z payments[' || (1000 + i % 41) || '] ERROR connection refused: upstream postgres unreachable (req=' || lpad(lower(to_hex(i)), 8, '0') || lpad(lower(to_hex(31 * i)), 8, '0') || ') attempt=' || i, chr(10) ORDER BY i) || chr(10) AS text
      FROM (SELECT user_id, event_id AS i, 37000 * event_id AS micros, make_timestamp(1768478400000000 + 37000 * event_id) AS moment FROM events) GROUP BY user_id"""
    turns = "SELECT conv_id * 1000 + turn AS event_id, CAST(conv_id AS VARCHAR) AS session, turn, repeat('2026-01-01 00:00:00 ' || regexp_replace(text, '\\n+', chr(10), 'g') || chr(10), 5) AS result FROM conversations"
    results = f"SELECT r.*, p.prompt FROM ({turns}) r LEFT JOIN ({lite_prompts(f'SELECT event_id AS id, result AS text FROM ({turns})', 100, 'in/0')}) p ON p.id = r.event_id"
    tool = "CASE event_id % 9 WHEN 0 THEN 'web_fetch' WHEN 1 THEN 'view' WHEN 2 THEN 'powershell' ELSE 'mcp.acme.bash' END"
    wrapped = f"CASE WHEN {tool} = 'powershell' THEN '& {{ ' || command || ' }} 2>&1' ELSE '( ' || command || ' ) 2>&1' END || ' | promptsift --query ''why'' --profile ' || {profile} || ' --budget 2000 --keep 5'"
    size, ask = "[CAST(length(text) AS DOUBLE), CAST(len(string_split(text, ' ')) AS DOUBLE)]", "[10.0::DOUBLE, 3.0::DOUBLE]"
    near = f"CASE WHEN contains(text, ' ') THEN list_cosine_similarity({size}, {ask}) ELSE 0 END"
    judged = judge("SELECT CAST(doc_id AS VARCHAR) AS case_id, text AS context FROM documents")
    reduced = judge(f"SELECT id AS case_id, prompt AS context FROM ({documents})")
    right = "contains(lower(answer), 'the') AND contains(lower(answer), 'and')"
    block_text = "text || chr(10) || chr(10) || chr(10) || '{\"a\": [1, 2]}' || chr(10) || chr(10) || '2026-01-01 00:00:00 started' || chr(10) || chr(10) || '  ' || chr(10) || chr(10) || 'def run():' || chr(10) || '  pass' || chr(10) || chr(10) || '[not json' || chr(10) || chr(10) || '[12:00:00] tick'"
    stages = (("normalize", "t0", "t1"), ("dedup", "t1", "t2"), ("prune", "t2", "t2"), ("budget", "t2", "t3"), ("assemble", "t3", "t4"))
    metrics = " UNION ALL ".join(
        f"SELECT request_id, CAST({k} AS INTEGER) AS stage_no, '{name}' AS stage, {a} AS tokens_in, {b} AS tokens_out, CAST(1 AS BIGINT) AS chunks_in, CAST(1 AS BIGINT) AS chunks_out, {a} - {b} AS saved, round(CASE WHEN {a} = 0 THEN 0 ELSE ({a} - {b}) / {a} END, 6) AS ratio FROM sizes"
        for k, (name, a, b) in enumerate(stages)
    )
    pruned = f"""SELECT CAST(o_custkey AS VARCHAR) AS request_id, '{{' || chr(10) || ' "custkey": ' || o_custkey || ',' || chr(10) || ' "orders": [' || chr(10) ||
            array_to_string(list_transform(keys[1:10], lambda k: '  ' || k), ',' || chr(10)) || CASE WHEN len(keys) > 10 THEN ',' || chr(10) || '  "<+' || (len(keys) - 10) || ' more items omitted>"' ELSE '' END || chr(10) || ' ]' || chr(10) || '}}' AS text FROM ({ORDERS})"""
    return {
        "token_count": f"SELECT doc_id, {tok('text')} AS tokens FROM documents",
        "tokens_by_source": f"SELECT source, CAST(sum({tok('text')}) AS BIGINT) AS tokens, count(*) AS chunks FROM documents GROUP BY source",
        "normalize_text": f"SELECT doc_id, {normalized('(' + NOISY + ')')} AS text FROM documents",
        "normalize_idempotent": f"SELECT doc_id, {normalized('once')} = once AS same FROM (SELECT doc_id, {normalized('(' + NOISY + ')')} AS once FROM documents)",
        "template_keys": f"SELECT doc_id, line_no, {template('line')} AS key FROM ({LINES})",
        "template_keys_log": f"SELECT event_id, {template('line')} AS key FROM (SELECT event_id, {EVENT_LINE} AS line FROM events)",
        "term_list": f"SELECT doc_id, len({terms('text')}) AS n_terms, coalesce(array_to_string(list_sort(list_distinct({terms('text')})), ' '), '') AS terms FROM documents",
        "sentence_list": f"SELECT doc_id, unnest(range(len(s))) AS place, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
        "chunk_ids": f"SELECT doc_id, {chunk_id('source', 'text')} AS chunk_id FROM documents",
        "truncated_heads": f"SELECT doc_id, {head} AS head FROM (SELECT *, 100 AS room FROM documents) WHERE {tok('text')} > 100",
        "saved_ratio": f"SELECT doc_id, round(CASE WHEN t = 0 THEN 0 ELSE floor(t / 3) / t END, 6) AS ratio FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
        "graders": f"SELECT doc_id, contains({low}, 'the') AND contains({low}, 'and') AS has_all, contains(text, 'The') AS has_cased, regexp_matches(text, '(?i)th[a-z]+ the') AS matched FROM documents",
        "chunk_blocks": f"""SELECT request_id, pos, CASE WHEN block = '{{"a": [1, 2]}}' THEN 'json' WHEN regexp_matches(first, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}|^\\s*\\[?\\d{{2}}:\\d{{2}}:\\d{{2}}') THEN 'log'
            WHEN regexp_matches(first, '^\\s*(```|def |class |#include |import |function )') THEN 'code' ELSE 'text' END AS kind, 'in/' || pos AS source, {tok('block')} AS tokens
          FROM (SELECT *, coalesce(list_filter(string_split(block, chr(10)), lambda l: regexp_matches(l, '\\S'))[1], '') AS first FROM (
            SELECT request_id, unnest(range(len(b))) AS pos, unnest(b) AS block FROM (SELECT CAST(doc_id AS VARCHAR) AS request_id, regexp_split_to_array({block_text}, '\\n{{2,}}') AS b FROM documents)) WHERE regexp_matches(block, '\\S'))""",
        "pinned_severity": f"SELECT event_id, CAST({severity} AS INTEGER) AS tier FROM events",
        "pinned_query": "SELECT doc_id, CAST(CASE WHEN contains(text, 'the and') THEN 0 ELSE 1 END AS INTEGER) AS tier FROM documents",
        "pinned_patterns": "SELECT doc_id, CAST(CASE WHEN regexp_matches(text, 'tok[e]n') OR contains(text, '[unclosed') OR contains(text, '### ') THEN 0 ELSE 1 END AS INTEGER) AS tier FROM documents",
        "payload_fields": "SELECT event_id, event_type AS tool, 'success' AS result_type, 'r' || event_id AS result, CASE WHEN event_id % 2 = 0 THEN 'ls ' || event_id ELSE '' END AS command, CASE WHEN event_id % 2 = 1 THEN 'f' || user_id END AS path FROM events",
        "crash_loop_dedup": f"WITH log AS MATERIALIZED ({crash}) SELECT id AS request_id, {tok('l.text')} AS tokens, d.text FROM log l JOIN ({deduplicated('SELECT id, text FROM log')}) d USING (id)",
        "dedup_runs": f"""SELECT doc_id, CAST(run AS BIGINT) AS run, arg_min(line, line_no) AS line, count(*) AS n FROM (
            SELECT doc_id, line_no, line, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (
              SELECT *, CASE WHEN line_no > 0 AND key = lag(key) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 0 ELSE 1 END AS fresh FROM (SELECT *, {template('line')} AS key FROM ({LINES})))) GROUP BY doc_id, run""",
        "prune_by_profile": """SELECT CAST(o_custkey AS VARCHAR) AS request_id, '{' || chr(10) || ' "custkey": ' || o_custkey || ',' || chr(10) || CASE WHEN p = 1 THEN '' ELSE ' "uid": "x",' || chr(10) END || CASE WHEN p = 2 THEN '' ELSE ' "pid": 7,' || chr(10) END
            || CASE WHEN p IN (3, 5) THEN '' ELSE ' "etag": {' || chr(10) || '  "a": 1' || chr(10) || ' },' || chr(10) END || ' "orders": ' || n || chr(10) || '}' AS text FROM (SELECT o_custkey, o_custkey % 6 AS p, count(*) AS n FROM orders GROUP BY ALL)""",
        "log_runs": f"SELECT first, line, n FROM ({log_runs(WHOLE_LOG)})",
        "log_deduplicated": f"SELECT id AS request_id, first, CASE WHEN n = 1 THEN line ELSE line || '   (x' || n || ')' END AS text FROM ({log_runs(WHOLE_LOG + ' UNION ALL ' + DOCUMENT_LOGS)})",
        "file_blocks": """SELECT name, CAST(pos AS BIGINT) AS pos, CASE WHEN regexp_matches(block, '^\\s*[\\{\\[]') AND json_valid(block) THEN 'json' WHEN regexp_matches(first, '^\\s*\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}|^\\s*\\[?\\d{2}:\\d{2}:\\d{2}') THEN 'log'
            WHEN regexp_matches(first, '^\\s*(```|def |class |#include |import |function )') THEN 'code' ELSE 'text' END AS kind, 'in/' || pos AS source, length(block) AS chars, sha1(block) AS digest
          FROM (SELECT *, coalesce(list_filter(string_split(block, chr(10)), lambda l: regexp_matches(l, '\\S'))[1], '') AS first FROM (
            SELECT name, unnest(range(len(b))) AS pos, unnest(b) AS block FROM (SELECT name, regexp_split_to_array(text, '\\n{2,}') AS b FROM (
              SELECT coalesce(source, 'none') AS name, regexp_replace(string_agg(replace(coalesce(text, ''), '. ', '.' || repeat(chr(10), 2)) || chr(10), '' ORDER BY doc_id), '\\r\\n?', chr(10), 'g') AS text FROM documents GROUP BY ALL))) WHERE regexp_matches(block, '\\S'))""",
        "dedup_text": f"SELECT id AS doc_id, text FROM ({deduplicated('SELECT doc_id AS id, text FROM documents')})",
        "dedup_event_log": f"SELECT id AS request_id, text FROM ({deduplicated(f'SELECT request_id AS id, text FROM ({EVENT_LOGS})')})",
        "prune_props": "SELECT CAST(event_id AS VARCHAR) AS request_id, regexp_replace(props, '^\\{\"k\": (.*)\\}$', '{' || chr(10) || ' \"k\": \\1' || chr(10) || '}') AS text FROM events",
        "prune_orders": pruned,
        "prune_profile": pruned,
        "pod_states": "SELECT CAST(c_custkey AS VARCHAR) AS request_id, 'pod-' || c_custkey AS name, CAST(c_custkey % 50 AS BIGINT) AS restarts, 'CrashLoopBackOff' AS reason, true AS dropped, true AS small FROM customer",
        "term_frequencies": f"SELECT request_id, term, count(DISTINCT pos) AS docs, count(*) AS n FROM (SELECT request_id, pos, unnest({terms('text')}) AS term FROM ({BY_SOURCE})) GROUP BY ALL",
        "tfidf_scores": f"SELECT request_id, pos, round(score, 6) AS score FROM ({query_scores(BY_SOURCE, QUERY)})",
        "relevance_topk": topk(query_scores(f"SELECT * FROM ({BY_SOURCE}) WHERE tier = 1", QUERY), 5, f"""
            SELECT c.request_id, c.pos, CAST(CASE WHEN n > KEEP AND place > KEEP THEN 3 ELSE c.tier END AS INTEGER) AS tier, CASE WHEN n > KEEP THEN round(score, 6) END AS relevance FROM ({BY_SOURCE}) c LEFT JOIN ranked r USING (request_id, pos)"""),
        "relevance_noop": topk(query_scores(TURNS, "the and of"), 6, """
            SELECT request_id, pos, CAST(CASE WHEN n > KEEP AND place > KEEP THEN 3 ELSE 1 END AS INTEGER) AS tier, CASE WHEN n > KEEP THEN round(score, 6) END AS relevance FROM ranked"""),
        "embedding_cosine": "SELECT CAST(label AS VARCHAR) AS request_id, vec_id AS pos, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(asked AS DOUBLE[])), 6) AS score FROM embeddings JOIN (SELECT label, arg_min(embedding, vec_id) AS asked FROM embeddings GROUP BY label) USING (label)",
        "embedding_topk": "SELECT request_id, pos, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, pos) <= 5 AS kept FROM (SELECT CAST(label AS VARCHAR) AS request_id, vec_id AS pos, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(asked AS DOUBLE[])) AS score FROM embeddings JOIN (SELECT label, arg_min(embedding, vec_id) AS asked FROM embeddings GROUP BY label) USING (label))",
        "centrality": f"SELECT id AS doc_id, pos, round(score, 6) AS score FROM ({centrality(f'SELECT doc_id AS id, unnest(range(len(s))) AS pos, unnest(s) AS text FROM (SELECT doc_id, {sentences("text")} AS s FROM documents)')})",
        "extractive_summary": f"""WITH parts AS MATERIALIZED (SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS id, unnest(range(len(s))) AS pos, unnest(s) AS text, len(s) AS size FROM (SELECT conv_id, turn, {sentences('text')} AS s FROM conversations)),
            near AS MATERIALIZED ({query_scores('SELECT id AS request_id, pos, text FROM parts', 'the and of')}), central AS MATERIALIZED ({centrality('SELECT id, pos, text FROM parts')}),
            ranked AS (SELECT p.*, row_number() OVER (PARTITION BY p.id ORDER BY round(0.5 * n.score + 0.5 * c.score, 9) DESC, p.pos) AS place FROM parts p JOIN near n ON n.request_id = p.id AND n.pos = p.pos JOIN central c ON c.id = p.id AND c.pos = p.pos)
            SELECT split_part(id, '/', 1) AS request_id, CAST(split_part(id, '/', 2) AS BIGINT) AS pos, string_agg(text, ' ' ORDER BY pos) AS summary FROM ranked WHERE size > 1 AND place <= greatest(1, round_even(size * 0.4, 0)) GROUP BY id""",
        "summarize_stage": f"SELECT request_id, pos, CAST(CASE WHEN {tok('text')} >= 120 THEN 2 ELSE 1 END AS INTEGER) AS tier, {tok('text')} >= 120 AS summarized FROM ({TURNS})",
        "budget_fill": filled(BY_SOURCE, 4000),
        "budget_fill_all": filled(f"SELECT 'all' AS request_id, pos, text, tier, relevance FROM ({BY_SOURCE})", 4000),
        "budget_stage": budgeted,
        "budget_overflow": f"SELECT request_id, coalesce(sum(CASE WHEN tier = 0 THEN {tok('text')} END), 0) > 500 AS overflow FROM ({BY_SOURCE}) GROUP BY request_id",
        "assemble_prompts": f"SELECT request_id, prompt, deferred FROM ({assembled(f"SELECT *, 1 AS tier FROM ({TURNS})")})",
        "deferred_footer": f"SELECT request_id, prompt, deferred_ids, entries FROM ({assembled(f"SELECT *, CASE WHEN pos % 2 = 1 THEN 3 ELSE 1 END AS tier FROM ({TURNS})")})",
        "deferred_rows": f"SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS place, {chunk_id('source', 'text')} AS id, source, 'text' AS kind, {tok('text')} AS tokens FROM ({TURNS}) WHERE pos % 2 = 1",
        "funnel_sources": funnel,
        "funnel_custom": f"SELECT id AS request_id, prompt, CAST(deferred AS BIGINT) AS deferred FROM ({lite_prompts(f'SELECT request_id AS id, text FROM ({EVENT_LOGS})', 4000, 'events', then='upper(text)')})",
        "funnel_lite": f"SELECT id AS request_id, prompt, CAST(deferred AS BIGINT) AS deferred FROM ({logs})",
        "funnel_metrics": f"""WITH logs AS MATERIALIZED (SELECT request_id, text, {normalized('text')} AS clean FROM ({EVENT_LOGS})), p AS MATERIALIZED ({logs}),
            sizes AS (SELECT request_id, {tok('l.text')} AS t0, {tok('l.clean')} AS t1, p.tokens AS t2, CASE WHEN p.deferred = 0 THEN p.tokens ELSE {tok('p.head')} END AS t3, {tok('p.prompt')} AS t4 FROM logs l JOIN p ON p.id = l.request_id) {metrics}""",
        "live_sizes": f"SELECT request_id, CAST(tier AS INTEGER) AS tier, CAST(sum({tok('text')}) AS BIGINT) AS tokens, count(*) AS chunks FROM ({BY_SOURCE}) GROUP BY request_id, tier",
        "store_stream": f"SELECT request_id, {chunk_id('source', 'text')} AS chunk_id, 'text' AS kind, source, any_value({tok('text')}) AS tokens, max(1000000.0::DOUBLE - pos * 600) AS stored_at FROM ({TURNS}) GROUP BY request_id, source, chunk_id",
        "store_put": f"SELECT request_id, chunk_id, kind, source, tokens, stored_at FROM ({CURRENT.format(STORE)})",
        "store_alive": f"SELECT request_id, count(*) AS n FROM ({ALIVE}) GROUP BY request_id",
        "store_retrieve": f"""WITH ids AS (SELECT request_id, list(DISTINCT chunk_id ORDER BY chunk_id) AS ids FROM ({STORE}) GROUP BY request_id), wanted AS (SELECT request_id, list_concat(['none:0'], list_reverse(ids), ids[1:1]) AS ids FROM ids)
            SELECT request_id, place, chunk_id, text FROM (SELECT request_id, unnest(range(len(ids))) AS place, unnest(ids) AS chunk_id FROM wanted) JOIN ({CURRENT.format(ALIVE)}) USING (request_id, chunk_id)""",
        "store_manifest": f"SELECT request_id, count(*) AS entries, CAST(sum(tokens) AS BIGINT) AS tokens FROM ({CURRENT.format(ALIVE)}) GROUP BY request_id",
        "store_after_eviction": f"SELECT request_id, count(*) AS entries, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS last FROM ({CURRENT.format(STORE)}) WHERE 1000000.0 - stored_at <= 1800 GROUP BY request_id",
        "store_evict": f"SELECT count(*) FILTER (1000000.0 - stored_at > 1800) AS removed FROM ({CURRENT.format(STORE)})",
        "gate_thresholds": f"SELECT event_id, CAST(CASE WHEN tool IN {_in(tools.SHELL_TOOLS)} THEN 2000 WHEN tool IN {_in(tools.VIEW_TOOLS)} THEN 500 WHEN tool LIKE 'mcp:%' OR contains(tool, '__') THEN 1000 ELSE 1500 END AS BIGINT) AS threshold, tool IN {_in(tools.VIEW_TOOLS)} AS is_view, tool IN {_in((*tools.SKIPPED_TOOLS, 'bash'))} OR starts_with(tool, 'todo_') AS skipped FROM ({CALLS})",
        "gate_commands": f"SELECT event_id, {noisy} AS noisy, {profile} AS profile, {noisy} AND NOT regexp_matches(command, '\\| ?promptsift( |$)') AS rewritten, '( ' || command || ' ) 2>&1 | promptsift --profile ' || {profile} || ' --budget 2000 --keep 5' AS command FROM ({CALLS})",
        "gate_reduced": "SELECT doc_id, doc_id % 3 = 0 OR (strlen(substr(text, 1, 150)) + 12 <= 200) OR regexp_matches(left(substr(text, 1, 150), 150), '(?m)^### ') AS reduced FROM documents",
        "gate_sessions": sessions(3600.0),
        "gate_stream": sessions(3600.0),
        "gate_sessions_days": sessions(3 * 86400.0),
        "judge_lines": f"WITH {judged} SELECT case_id, idx, score, place FROM best",
        "judge_answers": f"WITH {judged} SELECT case_id, answer FROM answers",
        "judge_line_answers": f"WITH {judged} SELECT case_id, answer FROM answers",
        "gate_views": views(),
        "gate_guards": "SELECT event_id, CASE WHEN event_id % 6 = 0 OR event_id % 11 = 0 THEN 'passed' WHEN tool = 'sql' THEN 'internal-bookkeeping' WHEN tool IN ('mcp:logs', 'bash') THEN 'user-skip-list' WHEN event_id % 6 = 1 THEN 'already-funneled' ELSE '' END AS guard FROM (" + CALLS + ")",
        "tool_answers": tool_answers(results),
        "pre_tool_answers": f"""SELECT event_id, CASE WHEN {tool} = 'web_fetch' THEN '{{"permissionDecision":"allow","additionalContext":"{tools.FETCH_HINT}"}}'
            WHEN {tool} <> 'view' AND {noisy} AND NOT regexp_matches(command, '\\| ?promptsift( |$)') THEN '{{"permissionDecision":"allow","modifiedArgs":{{"timeout":' || event_id || ',"command":"' || {wrapped} || '","env":{{"A":[1,null,"x"]}}}},"additionalContext":"[promptsift:pre-bash:' || {profile} || ']"}}'
            ELSE '{{"permissionDecision":"allow"}}' END AS answer FROM ({CALLS})""",
        "ingested_specs": "SELECT source AS request_id, doc_id AS pos, CAST(CASE WHEN doc_id % 10 = 0 OR contains(text, 'of the') OR regexp_matches(text, 'tok[e]n') THEN 0 ELSE 1 END AS INTEGER) AS tier, 'text' AS kind, lang AS source FROM documents",
        "embedder_topk": topk(f"SELECT request_id, pos, {near} AS score FROM ({TURNS})", 4, """
            SELECT request_id, pos, CAST(CASE WHEN n > KEEP AND place > KEEP THEN 3 ELSE 1 END AS INTEGER) AS tier, CASE WHEN n > KEEP THEN round(score, 6) END AS relevance FROM ranked"""),
        "model_summaries": f"SELECT request_id, pos, CAST(CASE WHEN {tok('text')} >= 120 THEN 2 ELSE 1 END AS INTEGER) AS tier, CASE WHEN {tok('text')} >= 120 AND NOT ends_with(text, 'e.') THEN right(text, 40) ELSE text END AS text FROM ({TURNS})",
        "model_prompts": "SELECT doc_id, 'Compress the following text to its bare-minimum relevant facts for the query: ' || CASE WHEN doc_id % 2 = 0 THEN chr(39) || 'it' || chr(92) || chr(39) || 's' || chr(92) || 't\"quoted\"' || chr(39) ELSE '\"it' || chr(39) || 's' || chr(92) || 'ta' || chr(92) || chr(92) || 'b\"' END || '. Preserve numeric values, error codes, and identifiers verbatim.' || chr(10) || chr(10) || text AS prompt FROM documents",
        "tool_tokens": "SELECT doc_id, length(text) // 4 AS tokens FROM documents",
        "store_workspaces": f"""SELECT w.workspace_key, request_id, row_number() OVER (PARTITION BY w.workspace_key, request_id ORDER BY first, id) AS place, id, tokens
            FROM (SELECT request_id, {chunk_id('source', 'text')} AS id, min(pos) AS first, max({tok('text')}) AS tokens FROM ({TURNS}) GROUP BY request_id, id) JOIN (VALUES ('a', 1000000), ('b', 2)) w(workspace_key, most) ON first < most""",
        "eval_suite": f"""WITH raw AS (WITH {judged} SELECT case_id, {right} AS ok FROM answers), after AS (WITH {reduced} SELECT case_id, {right} AS ok FROM answers)
            SELECT count(*) AS cases, count(*) FILTER (r.ok) AS raw_correct, count(*) FILTER (a.ok) AS funneled_correct, count(*) FILTER (r.ok AND NOT coalesce(a.ok, false)) AS regressions FROM raw r LEFT JOIN after a USING (case_id)""",
        "eval_compression": f"""WITH raw AS (WITH {judged} SELECT case_id, {right} AS ok FROM answers), after AS (WITH {reduced} SELECT case_id, {right} AS ok FROM answers),
            p AS MATERIALIZED ({documents}), sizes AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, {tok('d.text')} AS raw_tokens, {tok('p.prompt')} AS funneled_tokens FROM documents d JOIN p ON p.id = CAST(doc_id AS VARCHAR))
            SELECT case_id, raw_tokens, funneled_tokens, round(1 - funneled_tokens / raw_tokens, 6) AS compression, CAST(a.ok AS BIGINT) - CAST(r.ok AS BIGINT) AS delta FROM sizes JOIN raw r USING (case_id) JOIN after a USING (case_id)""",
    }
