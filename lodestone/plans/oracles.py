"""DuckDB SQL of the registered queries, over the driver's tables."""

from __future__ import annotations

# Fixed values, written out here so that a fault in the engine's own lists shows: kinds, states, stop words and words of intent.
KINDS = "note decision lesson root_cause pending question invariant environment invalidation".split()
STATES = "user_asserted inferred verified".split()
EVIDENCE_KINDS = "user_statement user_confirmation command_output test_result file_reference document_observation tool_output error_observation".split()
STOPWORDS = "a an the to of for on in and or is are was were be been with this that it its as by at from into during not do does did".split()
INTENT_TERMS = (
    "conclude concludes concluded concluding conclusion conclusions decide decides decided deciding decision decisions "
    "evaluate evaluates evaluated evaluating evaluation evaluations result results finding findings found "
    "current currently latest recent recently definition definitions define defines defined defining"
).split()


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _found(x: str) -> str:
    return f"regexp_extract_all(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[a-z0-9]+')"


def _tokens(x: str) -> str:
    return f"list_filter(list_distinct({_found(x)}), lambda t: NOT list_contains({_list(STOPWORDS)}, t))"


def _fts(p: str, records: str) -> str:
    """CTEs of the words and full-text channels of records (id, text): {p}_pairs, {p}_ranked, {p}_lex and {p}_fts."""
    words = f"list_filter({_found('text')}, lambda t: NOT list_contains({_list(STOPWORDS)}, t))"
    return f"""{p}_rec AS ({records}),
{p}_pairs AS (SELECT q, id, qn, dn, count(*) AS shared, count(*) FILTER (WHERE list_contains({_list(INTENT_TERMS)}, token)) AS intent
  FROM (SELECT id, len(ts) AS dn, unnest(ts) AS token FROM (SELECT id, {_tokens('text')} AS ts FROM {p}_rec)) JOIN q_tok USING (token) GROUP BY ALL),
{p}_post AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS token FROM (SELECT id, {words} AS ts FROM {p}_rec)) GROUP BY ALL),
{p}_n AS (SELECT count(*) AS n, avg(len({words})) AS avgdl FROM {p}_rec),
{p}_df AS (SELECT token, count(*) AS df FROM {p}_post GROUP BY token),
{p}_bm AS (SELECT q, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {p}_post JOIN q_tok USING (token) JOIN {p}_df USING (token), {p}_n GROUP BY q, id),
{p}_ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM {p}_bm),
{p}_lex AS (SELECT q, id, shared FROM {p}_pairs WHERE shared >= qn // 2 + 1),
{p}_fts AS (SELECT q, id, shared FROM {p}_ranked JOIN {p}_pairs USING (q, id) WHERE rank <= 200 AND shared >= greatest(least(qn, dn) // 2 + 1, (qn // 2 + 1) // 2)),
"""


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    return f"round({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 9)"


def _winner(pool: str, floor: float, margin: float) -> str:
    return f"(SELECT q, id, score FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM {pool} WINDOW w AS (PARTITION BY q ORDER BY score DESC, id)) WHERE r = 1 AND score >= {floor} AND (nxt IS NULL OR round(score - nxt, 9) >= {margin}))"


def _set(pool: str, floor: float, cap: int) -> str:
    return f"(SELECT q, id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rank FROM {pool} WHERE score >= {floor} QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= {cap})"


def _of(where: str) -> str:
    return f"(SELECT m.q, m.id, m.score FROM msc m JOIN live ON id = memory_id WHERE {where})"


def _safe(x: str) -> str:
    for raw, shown in ((92, "repeat(chr(92), 2)"), (10, "chr(92) || 'n'"), (9, "chr(92) || 't'"), (13, "chr(92) || 'r'")):
        x = f"replace({x}, chr({raw}), {shown})"
    return x


BASE = f"""WITH RECURSIVE mem AS (
  SELECT md5(concat('m', conv_id, '-', turn)) AS memory_id, text AS content, ({_list(KINDS)})[(conv_id + turn) % 9 + 1] AS kind,
    ({_list(STATES)})[(conv_id + turn) % 3 + 1] AS epistemic_state, conv_id * 1000 + turn AS seq,
    CASE WHEN turn % 2 = 1 THEN md5(concat('m', conv_id, '-', turn - 1)) END AS supersedes, conv_id, turn FROM conversations),
live AS (SELECT * FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem s WHERE s.supersedes = m.memory_id)),
status AS (SELECT m.*, NOT EXISTS (SELECT 1 FROM mem s WHERE s.supersedes = m.memory_id) AS is_current FROM mem m),
conf AS (SELECT least(x.memory_id, y.memory_id) AS a, greatest(x.memory_id, y.memory_id) AS b, x.seq AS recorded_at
  FROM mem x JOIN mem y ON x.conv_id = y.conv_id AND y.turn = x.turn + 2),
open_conf AS (SELECT a, b, recorded_at FROM conf WHERE a IN (SELECT memory_id FROM live) AND b IN (SELECT memory_id FROM live)),
partner AS (SELECT memory_id, list_sort(list_distinct(list(other))) AS others FROM (SELECT a AS memory_id, b AS other FROM open_conf UNION ALL SELECT b, a FROM open_conf) GROUP BY memory_id),
mem_ev AS (SELECT memory_id, conv_id % @CITED AS evidence_id FROM mem),
evid AS (SELECT doc_id AS evidence_id, text AS content, ({_list(EVIDENCE_KINDS)})[doc_id % 8 + 1] AS kind FROM documents),
skill AS (SELECT concat('s', memory_id) AS skill_id, concat('lesson of conversation ', conv_id, ' ', content, ' turn ', turn) AS text, conv_id % @CITED AS evidence_id, seq, conv_id, turn FROM mem WHERE kind = 'lesson'),
att AS (SELECT doc_id AS attempt_id, text AS task, source AS approach, doc_id % @CITED AS evidence_id,
  CASE WHEN quality = 1 THEN 'succeeded' WHEN toxic = 1 THEN 'partial' ELSE 'failed' END AS outcome FROM documents JOIN labels USING (doc_id)),
obs AS (SELECT source AS path, doc_id AS seq, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents),
links AS (SELECT l_orderkey AS memory_id, l_partkey AS evidence_id, l_linenumber AS position,
  CASE WHEN l_returnflag = 'R' THEN 'supporting' ELSE 'related' END AS role, ({_list(EVIDENCE_KINDS)})[l_partkey % 8 + 1] AS kind FROM lineitem),
q_set AS (SELECT item_id AS q, {_tokens('text')} AS ts FROM benchmark),
q_tok AS (SELECT q, len(ts) AS qn, unnest(ts) AS token FROM q_set),
{_fts('d', 'SELECT doc_id AS id, text FROM documents')}{_fts('a', "SELECT attempt_id AS id, concat_ws(' ', task, approach) AS text FROM att")}{_fts('m', 'SELECT memory_id AS id, content AS text FROM mem')}{_fts('s', 'SELECT skill_id AS id, text FROM skill')}
sc AS (SELECT a.vec_id AS q, b.vec_id AS id, b.vec_id % 7 AS grp, {_cos('b.embedding', 'a.embedding')} AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
vs AS (SELECT item_id AS q, e.vec_id, {_cos('e.embedding', 'x.embedding')} AS score FROM benchmark JOIN embeddings x ON x.vec_id = item_id % @VECTORS, embeddings e),
msc AS (SELECT q, memory_id AS id, score FROM mem JOIN vs ON vec_id = (conv_id * 8 + turn) % @VECTORS),
asc_ AS (SELECT q, attempt_id AS id, score FROM att JOIN vs ON vec_id = attempt_id % @VECTORS),
ssc AS (SELECT q, skill_id AS id, score FROM skill JOIN vs ON vec_id = (conv_id * 8 + turn) % @VECTORS),
paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path FROM pages),
cut AS (
  SELECT doc_id AS d, CAST(0 AS BIGINT) AS i, text AS rest, CAST(NULL AS VARCHAR) AS chunk, CAST(length(text) AS BIGINT) AS total, CAST(0 AS BIGINT) AS start FROM documents WHERE length(text) <= 1200 OR regexp_matches(text, '\\S')
  UNION ALL
  SELECT d, i + 1, regexp_replace(substring(rest, length(piece) + 1), '^[ \\n]*', ''), piece, total, total - length(rest) FROM (
    SELECT d, i, rest, total, CASE WHEN length(rest) <= 1200 THEN rest
      WHEN regexp_matches(rest, '(?s)^.{{1,1000}}.{{0,199}} ') THEN regexp_extract(rest, '(?s)^(.{{1,1000}}.{{0,199}}) ', 1)
      WHEN regexp_matches(rest, '(?s)^.{{1,1000}}.{{0,199}}\\n') THEN regexp_extract(rest, '(?s)^(.{{1,1000}}.{{0,199}})\\n', 1)
      ELSE substring(rest, 1, 1200) END AS piece FROM cut WHERE rest <> '')),
chunk AS (SELECT d, i - 1 AS i, chunk, count(*) OVER (PARTITION BY d) AS n, start FROM cut WHERE i > 0),
rel AS (SELECT q, attempt_id, outcome, evidence_id FROM (SELECT q, id FROM a_lex UNION SELECT q, id FROM a_fts UNION SELECT q, id FROM {_winner('asc_', 0.50, 0.08)}) JOIN att ON id = attempt_id),
rescue AS (SELECT DISTINCT r.q, m.memory_id FROM rel r JOIN mem_ev m USING (evidence_id) WHERE r.outcome <> 'partial'),
rl AS (SELECT q, id, score, conv_id % @CITED AS c, kind = 'lesson' AS is_lesson FROM msc JOIN live ON id = memory_id WHERE kind = 'root_cause' OR (kind = 'lesson' AND epistemic_state = 'verified')),
top1 AS (SELECT * FROM rl QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) = 1),
c_won AS (SELECT q, c FROM top1 t WHERE score >= 0.20 AND (NOT is_lesson OR score >= 0.30)
  AND coalesce(round(score - (SELECT max(x.score) FROM rl x WHERE x.q = t.q AND x.c <> t.c), 9), 1) >= 0.08 AND EXISTS (SELECT 1 FROM rl x WHERE x.q = t.q AND x.c = t.c AND NOT x.is_lesson)),
c_adm AS (SELECT q, id FROM rl JOIN c_won USING (q, c)),
near_att AS (SELECT t.q, t.id AS memory_id, a.attempt_id AS id FROM top1 t JOIN att a ON a.evidence_id = t.c WHERE t.score >= 0.0),
c_snd AS (SELECT n.q, n.memory_id AS id FROM near_att n JOIN a_lex x ON x.q = n.q AND x.id = n.id UNION
  SELECT t.q, t.id FROM top1 t JOIN {_winner('(SELECT n.q, n.id, s.score FROM near_att n JOIN asc_ s ON s.q = n.q AND s.id = n.id)', 0.50, 0.08)} w ON w.q = t.q),
corro AS (SELECT q, id FROM c_adm UNION ALL SELECT q, id FROM c_snd WHERE q NOT IN (SELECT q FROM c_adm)),
mem_vec AS (SELECT q, id FROM corro UNION SELECT q, id FROM {_set(_of("kind = 'lesson' AND epistemic_state = 'verified'"), 0.30, 2)}
  UNION SELECT q, id FROM {_winner(_of("kind = 'invalidation'"), 0.20, 0.08)} UNION SELECT q, id FROM {_winner(_of("kind = 'pending'"), 0.20, 0.08)}),
inv_set AS (SELECT q, id FROM {_set(_of("kind = 'invariant'"), 0.35, 2)}),
mem_ok AS (SELECT q, memory_id FROM (SELECT q, id AS memory_id FROM m_lex UNION SELECT q, id FROM m_fts UNION SELECT q, id FROM mem_vec UNION SELECT q, memory_id FROM rescue) SEMI JOIN live USING (memory_id)),
d_set AS {_set("(SELECT q, d AS id, max(score) AS score FROM chunk JOIN vs ON vec_id = (d + 7 * i) % @VECTORS GROUP BY ALL)", 0.30, 2)},
doc_ok AS (SELECT q, id AS d FROM d_lex UNION SELECT q, id FROM d_fts UNION SELECT q, id FROM d_set),
c_tok AS (SELECT d, i, unnest({_tokens('chunk')}) AS token, chunk FROM chunk SEMI JOIN doc_ok USING (d)),
c_hit AS (SELECT q, d, i, token FROM c_tok JOIN q_tok USING (token) JOIN doc_ok USING (q, d)),
c_sum AS (SELECT q, d, i, count(*) AS shared, count(*) FILTER (WHERE list_contains({_list(INTENT_TERMS)}, token)) AS intent FROM c_hit GROUP BY ALL),
c_all AS (SELECT * FROM c_sum UNION ALL SELECT q, d, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM doc_ok ANTI JOIN c_sum USING (q, d) WHERE d IN (SELECT d FROM chunk)),
ev AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, similarity DESC, source, d, i) AS pos FROM (
  SELECT s.q, s.d, s.i, concat(s.d, '#', s.i) AS c, source, CASE WHEN shared > intent THEN shared + 2 * intent ELSE shared END AS score, coalesce(v.score, 0.0) AS similarity
  FROM c_all s JOIN documents x ON x.doc_id = s.d LEFT JOIN d_set v ON v.q = s.q AND v.id = s.d)),
first_hit AS (SELECT q, token, min(pos) AS pos FROM c_hit JOIN ev USING (q, d, i) GROUP BY ALL),
suff AS (SELECT * FROM ev WHERE pos = 1 OR EXISTS (SELECT 1 FROM first_hit f WHERE f.q = ev.q AND f.pos = ev.pos)
  OR ((q, d) IN (SELECT (q, id) FROM d_set) AND pos = (SELECT min(o.pos) FROM ev o WHERE o.q = ev.q AND o.d = ev.d))),
val AS (SELECT q, evidence_id, row_number() OVER (PARTITION BY q ORDER BY src, place, evidence_id) AS p FROM (
  SELECT q, evidence_id, src, place FROM (SELECT q, conv_id % @CITED AS evidence_id, 0 AS src, seq AS place FROM mem_ok JOIN live USING (memory_id) WHERE kind = 'lesson' AND epistemic_state = 'verified'
    UNION ALL SELECT q, evidence_id, 1, attempt_id FROM rel WHERE outcome = 'succeeded') QUALIFY row_number() OVER (PARTITION BY q, evidence_id ORDER BY src, place) = 1) WHERE evidence_id IN (SELECT evidence_id FROM evid WHERE kind IN ('test_result', 'command_output'))),
cm AS (SELECT q, m.*, CASE kind WHEN 'invariant' THEN 0 WHEN 'pending' THEN 1 WHEN 'lesson' THEN 2 WHEN 'decision' THEN 3 ELSE 5 END AS s
  FROM (SELECT q, memory_id FROM mem_ok UNION SELECT q, id FROM inv_set UNION SELECT q, id FROM {_winner(_of("kind = 'decision'"), 0.20, 0.08)}) JOIN live m USING (memory_id)
  WHERE kind IN ('invariant', 'pending', 'decision', 'root_cause') OR (kind = 'lesson' AND epistemic_state = 'verified')),
absorb AS (SELECT r.q, r.attempt_id, m.memory_id FROM rel r JOIN cm m ON m.q = r.q AND m.conv_id % @CITED = r.evidence_id WHERE r.outcome = 'failed' AND m.s = 5
  QUALIFY row_number() OVER (PARTITION BY r.q, r.attempt_id ORDER BY m.seq, m.memory_id) = 1),
cite AS (SELECT q, memory_id, string_agg(concat('[a', attempt_id, ']'), ', ' ORDER BY attempt_id) AS w FROM absorb GROUP BY ALL),
esc AS (SELECT cm.q, s, seq AS p, cm.memory_id AS entity, conv_id % @CITED AS evidence_id, concat('- [', cm.memory_id, '] (', epistemic_state, ') ', {_safe('content')}, CASE WHEN s = 5 AND w IS NOT NULL THEN concat(chr(10), '  from attempt ', w) ELSE '' END,
    CASE WHEN others IS NULL THEN '' ELSE concat(chr(10), '  CONFLICTS WITH ', list_aggregate(list_transform(others, lambda o: concat('[', o, ']')), 'string_agg', ', ')) END) AS rendered FROM cm LEFT JOIN cite USING (q, memory_id) LEFT JOIN partner USING (memory_id)
  UNION ALL SELECT q, 4, CAST(pos AS BIGINT), c, NULL, concat('- [e', d, '] (document_observation) ', {_safe('chunk.chunk')}, chr(10), '  source: ', {_safe('source')}, CASE WHEN n > 1 THEN concat(' (chunk ', i + 1, ' of ', n, ')') ELSE '' END) FROM suff JOIN chunk USING (d, i)
  UNION ALL SELECT r.q, 6, r.attempt_id, concat('a', r.attempt_id), r.evidence_id, concat('- [a', r.attempt_id, '] ', {_safe("concat(task, ' -- ', approach)")}) FROM rel r JOIN att USING (attempt_id) ANTI JOIN absorb x ON x.q = r.q AND x.attempt_id = r.attempt_id WHERE r.outcome = 'failed'),
items AS (SELECT q, (['CONSTRAINTS', 'OPEN RISKS', 'LESSONS', 'DECISIONS', 'PROJECT EVIDENCE', 'HISTORY'])[least(s, 5) + 1] AS section, entity, evidence_id, rendered,
  row_number() OVER (PARTITION BY q ORDER BY s, p, entity) AS pos FROM esc),
costs AS (SELECT *, CAST(length(rendered) + 1 + CASE WHEN row_number() OVER (PARTITION BY q, section ORDER BY pos) = 1 THEN length(section) + 1 ELSE 0 END AS BIGINT) AS cost FROM items),
budget AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY q ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM costs),
scan AS (SELECT *, used <= 4000 AS selected FROM budget),
state AS (SELECT q, bool_and(selected) AS whole, max(used) AS used, max(pos) AS pos FROM scan GROUP BY q),
pool AS (SELECT v.q, v.p, v.evidence_id, coalesce(whole, true) AS whole, coalesce(t.used, 0) AS before, coalesce(t.pos, 0) AS last, concat('- [e', v.evidence_id, '] (', kind, ') ', {_safe('content')}) AS rendered
  FROM val v JOIN evid USING (evidence_id) LEFT JOIN state t ON t.q = v.q
  WHERE NOT coalesce(whole, true) OR EXISTS (SELECT 1 FROM scan s WHERE s.q = v.q AND s.selected AND s.evidence_id = v.evidence_id)),
pool2 AS (SELECT *, row_number() OVER w AS k, CASE WHEN whole THEN CAST(length(rendered) + 1 + CASE WHEN row_number() OVER w = 1 THEN 11 ELSE 0 END AS BIGINT) END AS cost FROM pool WINDOW w AS (PARTITION BY q ORDER BY p, evidence_id)),
pool3 AS (SELECT *, CASE WHEN whole THEN CAST(before + sum(cost) OVER (PARTITION BY q ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS used FROM pool2),
chosen AS (SELECT q, CAST(pos AS INTEGER) AS pos, section, cost, used, selected, rendered, entity FROM scan
  UNION ALL SELECT q, CAST(last + k AS INTEGER), 'VALIDATION', cost, used, coalesce(used <= 4000, false), rendered, concat('e', evidence_id) FROM pool3),
excl AS (SELECT item_id AS q, (SELECT count(*) FROM live WHERE kind = 'invariant') - (SELECT count(*) FROM cm WHERE cm.q = item_id AND s = 0) AS n_excluded FROM benchmark),
tot AS (SELECT q, n_selected, n_omitted, used, concat('-- ', n_selected, ' of ', n_selected + n_omitted, ' selected; ', n_omitted, ' omitted for budget',
    CASE WHEN n_excluded > 0 THEN concat('; ', n_excluded, ' project invariant(s) not relevant to this task (see: preflight)') ELSE '' END) AS footer
  FROM (SELECT item_id AS q, count(*) FILTER (WHERE selected) AS n_selected, count(*) FILTER (WHERE NOT selected) AS n_omitted, CAST(coalesce(max(used) FILTER (WHERE selected), 0) AS BIGINT) AS used
    FROM benchmark LEFT JOIN chosen ON q = item_id GROUP BY item_id) JOIN excl USING (q))
"""

SQL = {
    "point_lookups": """SELECT 'memory' AS entity, memory_id AS id, md5(content) AS digest FROM mem WHERE memory_id = md5('m0-0') UNION ALL SELECT 'evidence', CAST(evidence_id AS VARCHAR), md5(content) FROM evid WHERE evidence_id = 7
        UNION ALL SELECT 'attempt', CAST(attempt_id AS VARCHAR), md5(task) FROM att WHERE attempt_id = 11 UNION ALL SELECT concat('skill'), skill_id, md5(content) FROM skill JOIN mem USING (seq) WHERE memory_id = md5('m2-0')""",
    "attempt_order": "SELECT attempt_id AS sequence, attempt_id, outcome, CAST(length(task) AS BIGINT) AS size FROM att ORDER BY attempt_id",
    "skill_order": "SELECT seq AS sequence, skill_id, concat('lesson of conversation ', conv_id) AS name, concat('turn ', turn) AS conditions FROM skill ORDER BY seq",
    "sources_by_path": "SELECT path, seq, digest, size_bytes, CAST(length(text) AS BIGINT) AS n_chars FROM obs JOIN documents ON doc_id = seq QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1 ORDER BY path",
    "conflicts_by_time": "SELECT a, b, recorded_at FROM conf ORDER BY recorded_at, a, b",
    "scope_union": "SELECT source AS path FROM documents UNION SELECT string_split(path, '/')[1] FROM paths",
    "evidence_documents": "SELECT q, count(*) AS n_chunks, count(DISTINCT d) AS n_documents FROM ev GROUP BY q",
    "chunk_spans": "SELECT d, i, n, start, start + length(chunk) AS stop FROM chunk",
    "embed_concepts": """, h AS (SELECT doc_id AS d, list_transform(['the', 'ing', 'tion', 'ment', 'ung'], lambda c: CAST((length(lower(text)) - length(replace(lower(text), c, ''))) // length(c) AS DOUBLE)) AS h FROM documents),
        e AS (SELECT d, list_append(h, CASE WHEN list_sum(h) = 0 THEN 1.0 ELSE 0.0 END) AS e FROM h), n AS (SELECT d, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM e)
        SELECT d, round(e[1] / n, 9) AS e0, round(e[2] / n, 9) AS e1, round(e[3] / n, 9) AS e2, round(e[4] / n, 9) AS e3, round(e[5] / n, 9) AS e4, round(e[6] / n, 9) AS e5 FROM n""",
    "memory_vectors": "SELECT q, id FROM mem_vec",
    "invariant_set": "SELECT q, id FROM inv_set",
    "relevant_memories": "SELECT q, memory_id FROM mem_ok",
    "relevant_attempts": "SELECT q, attempt_id, outcome FROM rel",
    "conflict_partners": "SELECT memory_id, array_to_string(others, ',') AS partners FROM partner",
    "trace_evidence": """SELECT q, c, CAST(pos AS INTEGER) AS pos, score, EXISTS (SELECT 1 FROM d_lex l WHERE l.q = ev.q AND l.id = ev.d) AS words, EXISTS (SELECT 1 FROM d_fts l WHERE l.q = ev.q AND l.id = ev.d) AS full_text, EXISTS (SELECT 1 FROM d_set l WHERE l.q = ev.q AND l.id = ev.d) AS semantic,
        EXISTS (SELECT 1 FROM suff x WHERE x.q = ev.q AND x.c = ev.c) AS sufficient, EXISTS (SELECT 1 FROM chosen x WHERE x.q = ev.q AND x.entity = ev.c AND x.section = 'PROJECT EVIDENCE' AND x.selected) AS selected FROM ev""",
    "cluster_admission": "SELECT q, id FROM c_adm",
    "corroboration": "SELECT q, id FROM corro",
    "admission_channels": "SELECT q, d AS id, EXISTS (SELECT 1 FROM d_lex l WHERE l.q = e.q AND l.id = e.d) AS words, EXISTS (SELECT 1 FROM d_fts f WHERE f.q = e.q AND f.id = e.d) AS full_text, EXISTS (SELECT 1 FROM d_set f WHERE f.q = e.q AND f.id = e.d) AS semantic FROM doc_ok e",
    "skill_promotion": """SELECT concat('s', memory_id) AS skill_id, CASE WHEN kind = 'lesson' AND epistemic_state = 'verified' THEN 'verified' ELSE 'candidate' END AS verification_state, CAST(conv_id % @CITED AS VARCHAR) AS cited,
        CASE WHEN seq % 5 = 0 THEN 'blank name' WHEN seq % 7 = 0 THEN 'blank step' WHEN kind <> 'lesson' THEN 'unknown lesson' END AS reason FROM mem WHERE kind IN ('lesson', 'note')""",
    "vector_upsert": "SELECT 'memory' AS entity_type, vec_id AS entity_id, CASE WHEN vec_id % 3 = 0 THEN vec_id + 1001 ELSE label END AS version FROM embeddings",
    "index_status": "SELECT 'stale' AS state, CAST(NULL AS VARCHAR) AS detail, count(*) FILTER (WHERE vec_id % 10 = 0) AS missing FROM embeddings",
    "current_state": "SELECT memory_id, kind, epistemic_state, seq FROM live",
    "state_by_kind": "SELECT memory_id, content, seq FROM live WHERE kind = 'decision'",
    "timeline_with_status": "SELECT seq, memory_id, kind, is_current FROM status",
    "timeline_events": "SELECT seq AS sequence, memory_id, kind AS memory_kind FROM mem",
    "status_counts": "SELECT kind, count(*) AS n, count(*) FILTER (WHERE is_current) AS n_current FROM status GROUP BY kind",
    "open_conflicts": "SELECT a, b, recorded_at FROM open_conf",
    "conflict_upsert": "SELECT a, b, recorded_at FROM conf c WHERE NOT EXISTS (SELECT 1 FROM conf s WHERE s.recorded_at % 3 = 0 AND s.a = c.a AND s.b = c.b)",
    "supersession_violations": """, bad AS (SELECT memory_id, CASE WHEN seq % 11 = 0 THEN memory_id WHEN seq % 7 = 0 THEN 'none' ELSE supersedes END AS supersedes FROM mem)
        SELECT memory_id, 'self' AS reason FROM bad WHERE memory_id = supersedes UNION ALL SELECT memory_id, 'missing' FROM bad WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT memory_id FROM bad)
        UNION ALL SELECT memory_id, 'taken' FROM bad WHERE supersedes IN (SELECT supersedes FROM bad WHERE supersedes IS NOT NULL GROUP BY supersedes HAVING count(*) > 1)""",
    "duplicate_suppression": "SELECT memory_id, first_value(memory_id) OVER (PARTITION BY content, kind, epistemic_state, supersedes, conv_id % @CITED, epistemic_state = 'verified' ORDER BY seq, memory_id) AS canonical_id FROM live",
    "verified_gate": "SELECT memory_id, count(*) FILTER (WHERE role = 'supporting') AS n_supporting, coalesce(bool_or(role = 'supporting' AND kind IN ('test_result', 'command_output', 'tool_output', 'user_confirmation')), false) AS qualifies FROM links GROUP BY memory_id",
    "memory_evidence_arrays": "SELECT memory_id, string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY position, evidence_id) AS children FROM links GROUP BY memory_id",
    "latest_observation": "SELECT path, seq, digest, size_bytes FROM obs QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1",
    "observation_changes": "SELECT path, seq, digest, CASE WHEN row_number() OVER w = 1 THEN 'added' WHEN lag(digest) OVER w IS DISTINCT FROM digest THEN 'changed' ELSE 'unchanged' END AS status FROM obs WINDOW w AS (PARTITION BY path ORDER BY seq)",
    "seed_report": """, cand AS (SELECT concat(path, CASE WHEN seq % 10 = 0 THEN '-new' ELSE '' END) AS path, seq, digest FROM obs), last AS (SELECT path, digest FROM cand QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1),
        stored AS (SELECT path, digest AS old FROM obs QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)
        SELECT path, CASE WHEN old IS NULL THEN 'new' WHEN old = digest THEN 'unchanged' ELSE 'changed' END AS status FROM last LEFT JOIN stored USING (path)""",
    "orphan_check": "SELECT kind, count(*) AS n FROM links WHERE evidence_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) GROUP BY kind",
    "migrate_events_backfill": "SELECT memory_id AS subject_id, 'memory_recorded' AS kind, seq AS recorded_at FROM mem UNION ALL SELECT supersedes, 'memory_superseded', seq FROM mem WHERE supersedes IS NOT NULL",
    "recall_topk": "SELECT memory_id, CAST((length(lower(content)) - length(replace(lower(content), 'th', ''))) // 2 AS BIGINT) AS hits, seq FROM live WHERE contains(lower(content), 'th') ORDER BY 2 DESC, seq DESC, memory_id LIMIT 20",
    "token_sets": f"SELECT doc_id AS d, array_to_string(list_sort({_tokens('text')}), ' ') AS tokens FROM documents",
    "postings_build": "SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM d_post GROUP BY token",
    "lexical_relevance": "SELECT q, id AS d, shared FROM d_lex",
    "weighted_overlap": "SELECT q, id AS d, CASE WHEN shared > intent THEN shared + 2 * intent ELSE shared END AS score FROM d_pairs WHERE CASE WHEN shared > intent THEN shared + 2 * intent ELSE shared END > 3",
    "bm25_topk": "SELECT q, id AS d, score, CAST(rank AS INTEGER) AS rank FROM d_ranked WHERE rank <= 20",
    "fts_threshold": "SELECT q, id AS d, shared FROM d_fts",
    "provenance_rescue": "SELECT q, memory_id FROM rescue",
    "attempt_absorption": "SELECT attempt_id, memory_id FROM (SELECT a.attempt_id, m.memory_id, row_number() OVER (PARTITION BY a.attempt_id ORDER BY m.seq, m.memory_id) AS r FROM att a JOIN mem_ev USING (evidence_id) JOIN mem m USING (memory_id) WHERE a.outcome = 'failed' AND m.kind = 'root_cause') WHERE r = 1",
    "cosine_topk": "SELECT q, id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 5",
    "semantic_winner_margin": f"SELECT q, id, score FROM {_winner('sc', 0.20, 0.08)}",
    "semantic_set_admission": f"SELECT * FROM {_set('sc', 0.30, 2)}",
    "source_max_admission": f"SELECT * FROM {_set('(SELECT q, grp AS id, max(score) AS score FROM sc GROUP BY ALL)', 0.30, 2)}",
    "evidence_cluster": """, member AS (SELECT DISTINCT conv_id AS m FROM mem), edge AS (SELECT m, m % 97 AS e FROM member UNION SELECT m, m % 13 + 1000 FROM member),
        reach AS (SELECT m, m AS r FROM member UNION SELECT e2.m, reach.r FROM reach JOIN edge e1 ON e1.m = reach.m JOIN edge e2 ON e1.e = e2.e) SELECT m AS member, min(r) AS cluster FROM reach GROUP BY m""",
    "chunk_documents": "SELECT d, i, CAST(length(chunk) AS BIGINT) AS size, md5(chunk) AS digest FROM chunk",
    "chunk_scores": "SELECT q, c, score FROM ev",
    "project_evidence_order": "SELECT q, CAST(pos AS INTEGER) AS pos, c, score, similarity FROM ev",
    "min_sufficient_set": "SELECT q, CAST(pos AS INTEGER) AS pos, c FROM suff",
    "budget_prefix": "SELECT q, pos, section, cost, used, selected FROM chosen",
    "context_sections": "SELECT q, section, count(*) FILTER (WHERE selected) AS n_selected, count(*) AS n FROM chosen GROUP BY ALL",
    "context_footer": "SELECT q, n_selected, n_omitted, used, footer FROM tot",
    "context_text": f""", lines AS (SELECT q, pos, CASE WHEN lag(section) OVER (PARTITION BY q ORDER BY pos) IS DISTINCT FROM section THEN concat(section, chr(10), rendered) ELSE rendered END AS line FROM chosen WHERE selected),
        body AS (SELECT q, string_agg(line, chr(10) ORDER BY pos) AS body FROM lines GROUP BY q)
        SELECT q, concat('Task: ', {_safe('text')}, chr(10), chr(10), coalesce(body, CASE WHEN n_omitted > 0 THEN 'No compiled items fit within the budget.' ELSE 'No compiled context for this task.' END), chr(10), chr(10), footer) AS text FROM tot JOIN benchmark ON item_id = q LEFT JOIN body USING (q)""",
    "preflight_long": """, cats AS (SELECT CAST(-1 AS BIGINT) AS q, 'constraint' AS category, memory_id AS entity, seq AS place FROM live WHERE kind = 'invariant'
        UNION ALL SELECT q, CASE kind WHEN 'root_cause' THEN 'root_cause' WHEN 'lesson' THEN 'lesson' WHEN 'pending' THEN 'pending' ELSE 'invalidation' END, memory_id, seq FROM mem_ok JOIN live USING (memory_id) WHERE kind IN ('root_cause', 'pending', 'invalidation') OR (kind = 'lesson' AND epistemic_state = 'verified')
        UNION ALL SELECT q, CASE outcome WHEN 'failed' THEN 'known_failure' ELSE 'known_success' END, CAST(attempt_id AS VARCHAR), attempt_id FROM rel WHERE outcome <> 'partial'
        UNION ALL SELECT q, 'validation', CAST(evidence_id AS VARCHAR), p FROM val
        UNION ALL SELECT q, 'conflict', concat(a, ' ', b), 0 FROM (SELECT q, a, b FROM open_conf JOIN mem_ok ON a = memory_id UNION SELECT q, a, b FROM open_conf JOIN mem_ok ON b = memory_id))
        SELECT q, category, entity, CAST(row_number() OVER (PARTITION BY q, category ORDER BY place, entity) AS INTEGER) AS pos FROM cats""",
    "guard_report": f""", sk AS (SELECT q, id, seq, evidence_id FROM (SELECT q, id FROM s_lex UNION SELECT q, id FROM s_fts UNION SELECT q, id FROM {_winner('ssc', 0.55, 0.10)}) JOIN skill ON id = skill_id),
        cats AS (SELECT q, 'skill' AS category, id AS entity, seq AS place FROM sk
        UNION ALL SELECT q, 'known_failure', CAST(attempt_id AS VARCHAR), attempt_id FROM rel WHERE outcome = 'failed' AND EXISTS (SELECT 1 FROM sk WHERE sk.q = rel.q AND sk.evidence_id = rel.evidence_id)
        UNION ALL SELECT q, 'validation', CAST(evidence_id AS VARCHAR), min(seq) FROM sk WHERE evidence_id IN (SELECT evidence_id FROM evid WHERE kind IN ('test_result', 'command_output')) GROUP BY q, evidence_id)
        SELECT q, category, entity, CAST(row_number() OVER (PARTITION BY q, category ORDER BY place, entity) AS INTEGER) AS pos FROM cats""",
    "terminal_safe": "SELECT doc_id AS d, md5(replace(replace(replace(replace(text, chr(92), repeat(chr(92), 2)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r')) AS digest FROM documents",
    "render_items": f"""SELECT m.memory_id, concat('- [', m.memory_id, '] (', epistemic_state, ') ', {_safe('content')}, CASE WHEN others IS NULL THEN '' ELSE concat(chr(10), '  CONFLICTS WITH ', list_aggregate(list_transform(others, lambda o: concat('[', o, ']')), 'string_agg', ', ')) END) AS line FROM mem m LEFT JOIN partner USING (memory_id)""",
    "ignore_filter": r"SELECT page_id, path, CASE WHEN path LIKE 'fr/%' THEN true WHEN regexp_full_match(path, 'es/1[^/]+(/.*)?') THEN true WHEN regexp_full_match(path, 'en/[^/]*\.html') THEN false ELSE regexp_full_match(path, '.*\.html(/.*)?') END AS ignored FROM paths",
    "secret_filter": "SELECT page_id, page_id % 6 IN (0, 1, 4) AS secret, page_id % 6 = 3 AS sensitive, page_id % 5 IN (1, 3, 4) AS excluded FROM paths",
    "settle_sessions": """, g AS (SELECT user_id AS path, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT path, ts, sum(far) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT path, max(ts) AS ts, count(*) AS n FROM r GROUP BY path, run""",
    "rate_limit_buckets": "SELECT user_id AS bucket, event_id AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS delay_s FROM events",
    "stream_cdc": "SELECT path, seq, digest, CASE WHEN row_number() OVER w = 1 THEN 'added' WHEN lag(digest) OVER w IS DISTINCT FROM digest THEN 'changed' ELSE 'unchanged' END AS status FROM obs WINDOW w AS (PARTITION BY path ORDER BY seq)",
}


def sql() -> dict[str, str]:
    """The moduli grow with the tables, as those of ``views`` do."""
    moduli = {"@CITED": "(SELECT greatest(1, least(count(*), greatest(97, count(*) // 16))) FROM documents)", "@VECTORS": "(SELECT count(*) FROM embeddings)"}
    return {k: (BASE + v).replace("@CITED", moduli["@CITED"]).replace("@VECTORS", moduli["@VECTORS"]) for k, v in SQL.items()}
