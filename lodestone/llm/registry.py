"""Queries of the training-corpus operators and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import codebooks, conversations, jaccard, language, lines, mixing, packing, quality, secrets, sharding, substring, urls, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """opN_<name> for each operator N, over its whole table with production parameters."""
    return {
        f.__name__: f
        for f in (
            packing.op1_mixture_packing, sharding.op2_minimax_sharding, quality.op3_quality_rules, language.op4_language_id, substring.op5_substring_dedup,
            vectors.op6_embedding_near_dedup, mixing.op7_mixing, urls.op8_url_filters, jaccard.op9_ngram_jaccard_join, lines.op10_line_dedup,
            conversations.op11_prefix_trie, secrets.op12_secret_scan, codebooks.op13_vector_codes,
        )
    }


WORDS = r"[^\x20\x09-\x0D]+"

#: A window is the text of 20 words; the first start of each in the order of documents stays.
SUBSTRING = f"""WITH ws AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM ws),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM ws WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM later),
kept AS (SELECT word.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY word.pos) FILTER (WHERE gone.pos IS NULL) AS kept FROM word LEFT JOIN gone USING (doc_id, pos) GROUP BY word.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM ws LEFT JOIN kept USING (doc_id)"""

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding AS e, sqrt({_DOT.format(a="embedding", b="embedding")}) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE x.n > 0 AND y.n > 0 AND {_DOT.format(a="x.e", b="y.e")} >= 0.98 * x.n * y.n),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT link.a, reach.r FROM reach JOIN link ON link.b = reach.vec_id)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM reach GROUP BY vec_id"""

JACCARD = f"""WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
shingles AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM ws),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shingles),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM ws UNION SELECT link.a, reach.r FROM reach JOIN link ON link.b = reach.doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id FROM shingles JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""

#: The unsigned CRC-32 of a string, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({s}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295::BIGINT)"""

#: All prefixes as lists of turns; what lies below a node is found from the prefixes of every node.
TRIE = f"""WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY i) AS w FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, w, conv_id - conv_id % 5 AS base, CAST({_CRC.format(s="CAST(conv_id AS VARCHAR)")} % 9 AS BIGINT) AS h FROM own),
conv AS (SELECT a.conv_id, list_concat(coalesce(b.w[1:a.h], []), a.w[a.h + 1:]) AS w FROM heads a LEFT JOIN own b ON b.conv_id = a.base),
prefix AS (SELECT conv_id, d, w[1:d] AS p, len(w) AS n FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM conv)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(any_value(p)[d].t), 0) AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM prefix GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
below AS (SELECT p[1:e] AS p, e AS d, sum(saved) AS saved_tokens, count(*) FILTER (WHERE childless) AS n_leaves FROM (SELECT node.p, node.d, saved, kids.n IS NULL AS childless, unnest(range(0, node.d + 1)) AS e FROM node LEFT JOIN kids ON kids.p = node.p AND kids.d = node.d) GROUP BY 1, 2)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN below ON below.p = node.p AND below.d = node.d LEFT JOIN kids ON kids.p = node.p AND kids.d = node.d LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.p = node.p[1:node.d - 1]"""

#: Spans are found again from the lengths of the matches and of the texts between them; a base-62 digit is a place of its alphabet.
_BASE62 = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'"
_DIGITS = "concat(" + ", ".join(f"substr({_BASE62}, CAST(crc // {62**k} % 62 AS INTEGER) + 1, 1)" for k in range(5, -1, -1)) + ")"
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_KINDS = (
    ("assign", f"({_WORDS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]{24,}"),
    ("github", r"\bgh[pousr]_[0-9A-Za-z]{36}\b"),
    ("npm", r"\bnpm_[0-9A-Za-z]{36}\b"),
)
_CUTS = " UNION ALL ".join(
    f"SELECT r, {i} AS k, string_split_regex(text, '{p}') AS between, regexp_extract_all(text, '{p}') AS found, {f"regexp_extract_all(text, '{p}', 2)" if k == "assign" else "NULL"} AS value FROM docs WHERE regexp_matches(text, '{p}')"
    for i, (k, p) in enumerate(_KINDS)
)
SECRETS = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
kind AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}')" for i,(k,_) in enumerate(_KINDS))}) AS k(k, kind)),
cut AS ({_CUTS}),
each AS (SELECT r, k, found[i] AS found, value[i] AS value, CAST(list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM cut)),
checked AS (SELECT *, CASE WHEN k >= 3 THEN {_CRC.format(s="substr(found, 5, 30)")} END AS crc FROM each),
span AS (SELECT r, k, kind, concat(kind, ':', start, ':', start + length(found)) AS shown, start FROM checked JOIN kind USING (k)
  WHERE CASE k WHEN 0 THEN length(value) >= 6 WHEN 1 THEN length(found) >= 20 WHEN 2 THEN length(found) >= 24 ELSE right(found, 6) = {_DIGITS} END),
row AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE k = 3) AS n_github, count(*) FILTER (WHERE k = 4) AS n_npm,
  string_agg(shown, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base, string_agg(shown, ',' ORDER BY start, k) AS spans FROM span GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_github, 0) AS n_github, coalesce(n_npm, 0) AS n_npm FROM docs LEFT JOIN row USING (r)"""

#: Assignments to the codebooks after k rounds, and the codebooks that follow.
_ASSIGN = """at{k} AS MATERIALIZED (SELECT r, p, e, d FROM (SELECT piece.r, piece.p, book{k}.e, list_sum(list_transform(list_zip(piece.v, book{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM piece JOIN book{k} USING (p)) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)"""
_MOVE = """mean{n} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM piece JOIN at{k} USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
book{n} AS MATERIALIZED (SELECT p, e, coalesce(mean{n}.v, book{k}.v) AS v FROM book{k} LEFT JOIN mean{n} USING (p, e))"""
CODES = (
    """WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
piece AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS v FROM (SELECT r, v, unnest(range(0, 8)) AS p FROM kept)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM piece WHERE r <= 16),
"""
    + ",\n".join(_ASSIGN.format(k=k)+(",\n"+_MOVE.format(k=k,n=k+1) if k<6 else "") for k in range(7))
    + """,
code AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM at6 GROUP BY r),
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS s FROM book6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM kept JOIN code USING (r), sha"""
)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose result is exact whatever the method. The others follow from hashes, raking, trees or tokenizers, and are tested against brute force."""
    return {"op5_substring_dedup": SUBSTRING, "op6_embedding_near_dedup": VECTORS, "op9_ngram_jaccard_join": JACCARD, "op11_prefix_trie": TRIE, "op12_secret_scan": SECRETS, "op13_vector_codes": CODES}
