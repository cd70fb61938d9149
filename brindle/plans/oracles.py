"""DuckDB SQL of the registered queries, built from common table expressions."""

from __future__ import annotations

from brindle.functions.text import STOPWORDS
from brindle.operators.answer import LISTING, NOTHING, PROMPT
from brindle.operators.chunking import SEPARATORS
from brindle.plans.queries import ASKED, RELEVANT


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_SPACE}|{_SPACE}\z', '', 'g')"


_STOP = "[" + ", ".join(map(_q, STOPWORDS)) + "]"


_DOCS = f"docs AS (SELECT doc_id::VARCHAR AS doc_id, {_strip('coalesce(text, chr(32))')} AS t FROM documents)"
_CHUNKS = _DOCS + """,
 chunks AS (SELECT doc_id || '#' || (s // 350) AS chunk_id, doc_id, (s // 350)::INT AS position, substr(t, s + 1, 400) AS text
  FROM docs, unnest(range(0, length(t), 350)) AS u(s))"""


def _index(source: str = "chunks", name: str = "posted") -> str:
    return f"{name} AS MATERIALIZED (SELECT DISTINCT chunk_id, doc_id, term FROM (SELECT chunk_id, doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS term FROM {source}) WHERE length(term) >= 2 AND NOT list_contains({_STOP}, term))"


#: The chunks when every third document comes again with the text of the document three ids on.
_REPLACED = f"""{_DOCS}, put AS (SELECT d.doc_id, CASE WHEN d.doc_id::BIGINT % 3 = 0 THEN coalesce(o.t, d.t) ELSE d.t END AS t FROM docs d LEFT JOIN docs o ON o.doc_id::BIGINT = d.doc_id::BIGINT + 3),
 chunks AS (SELECT doc_id || '#' || (s // 350) AS chunk_id, doc_id, substr(t, s + 1, 400) AS text FROM put, unnest(range(0, length(t), 350)) AS u(s))"""
_ASKED = "asked(query_id, query) AS (VALUES " + ", ".join(f"('q{i}', {_q(q)})" for i, q in enumerate(ASKED, 1)) + ")"
_QTERMS = f"""{_ASKED},
 qwords AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-zA-Z0-9_]+')) AS term, generate_subscripts(regexp_extract_all(lower(query), '[a-zA-Z0-9_]+'), 1) AS nth FROM asked),
 qterms AS (SELECT query_id, term, min(nth) AS nth FROM qwords WHERE length(term) >= 2 AND NOT list_contains({_STOP}, term) GROUP BY ALL)"""
_BASE = f"{_CHUNKS},\n {_index()},\n {_QTERMS}"
_NEAR = f"""{_BASE},
 wanted AS MATERIALIZED (SELECT chunk_id, term FROM posted WHERE term IN (SELECT term FROM qterms)),
 near AS MATERIALIZED (SELECT a.term, b.term AS neighbour, count(*)::DOUBLE AS weight FROM wanted a JOIN posted b USING (chunk_id)
  WHERE a.term <> b.term GROUP BY ALL),
 allowed AS (SELECT q.query_id, q.nth, q.term, n.neighbour, n.weight FROM qterms q JOIN near n USING (term)
  WHERE NOT EXISTS (SELECT 1 FROM qterms x WHERE x.query_id = q.query_id AND x.term = n.neighbour))"""
_RANKED = f"""{_NEAR},
 best AS (SELECT * FROM allowed QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY weight DESC, neighbour) <= 2),
 once AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id, neighbour ORDER BY term) = 1),
 expanded AS (SELECT query_id, term AS query_term, neighbour AS expanded_term, weight FROM once
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY term, weight DESC, neighbour) <= 10)"""
# greedy: a step for each term in query order, which takes its two best that aren't taken yet
_GREEDY = f"""{_NEAR},
 steps AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY nth) AS step FROM qterms),
 sorted AS (SELECT a.query_id, s.step, list({{'query_term': a.term, 'expanded_term': neighbour, 'weight': weight}} ORDER BY weight DESC, neighbour) AS items
  FROM (SELECT * FROM allowed QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY weight DESC, neighbour) <= 11) a JOIN steps s ON s.query_id = a.query_id AND s.term = a.term GROUP BY ALL),
 walk AS (WITH RECURSIVE w(query_id, step, taken) AS (
   SELECT query_id, 0::BIGINT, []::STRUCT(query_term VARCHAR, expanded_term VARCHAR, weight DOUBLE)[] FROM asked
   UNION ALL
   SELECT w.query_id, w.step + 1, CASE WHEN len(taken) >= 10 THEN taken ELSE list_concat(taken,
     list_filter(coalesce(s.items, []), lambda x: NOT list_contains(list_transform(taken, lambda y: y.expanded_term), x.expanded_term))[1:2]) END
   FROM w LEFT JOIN sorted s ON s.query_id = w.query_id AND s.step = w.step + 1
   WHERE w.step < (SELECT max(step) FROM steps))
  SELECT * FROM w WHERE step = (SELECT max(step) FROM steps)),
 expanded AS (SELECT query_id, x.query_term, x.expanded_term, x.weight FROM (SELECT query_id, unnest(taken) AS x FROM walk)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY x.weight DESC, x.expanded_term, x.query_term) <= 10)"""


def _scored(base: str, cap: str) -> str:
    return f"""{base},
 found AS (SELECT query_id, chunk_id, doc_id, term, true AS direct, NULL::DOUBLE AS weight FROM qterms JOIN posted USING (term)
  UNION ALL SELECT query_id, chunk_id, doc_id, expanded_term, false, weight FROM expanded JOIN posted ON term = expanded_term),
 sums AS (SELECT query_id, chunk_id, doc_id, count(*) FILTER (direct) AS direct_hit_count, count(*) FILTER (NOT direct) AS expanded_hit_count,
   coalesce(sum(weight * 0.5), 0.0)::DOUBLE AS expanded_score FROM found GROUP BY ALL),
 scored AS (SELECT *, least(expanded_score, {cap})::DOUBLE AS capped_expanded_score, coalesce(expanded_score > {cap}, false) AS expansion_capped,
   (direct_hit_count + least(expanded_score, {cap}))::DOUBLE AS score FROM sums)"""


def _graph(base: str, cap: str, k: int = 10) -> str:
    return f"WITH {_scored(base, cap)} SELECT query_id, doc_id, chunk_id, direct_hit_count, expanded_hit_count, expanded_score, expansion_capped, score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {k}"


def _edges(chunks: str) -> str:
    return f"WITH {chunks}, {_index()}, e AS (SELECT a.term AS source, b.term AS target, count(*)::DOUBLE AS weight FROM posted a JOIN posted b ON a.chunk_id = b.chunk_id AND a.term < b.term GROUP BY ALL) SELECT source, count(*) AS edges, sum(weight) AS weight, max(weight) AS heaviest FROM e GROUP BY source"


def _hash(x: str) -> str:
    return f"list_transform(range(0, 32), lambda i: ('0x' || substr(sha256({x}), i * 2 + 1, 2))::INT / 255.0::DOUBLE)"


# the products are added up in order, as in the plan
_DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda x, y: x + y)"


def _cosine(a: str, b: str) -> str:
    dot = _DOT.format(a=a, b=b)
    return f"({dot}) / (sqrt({_DOT.format(a=a, b=a)}) * sqrt({_DOT.format(a=b, b=b)}))"


def _fused(alpha: str, beta: str, normal: bool) -> str:
    eff = lambda s: f"CASE WHEN max({s}) OVER w = min({s}) OVER w THEN CASE WHEN {s} > 0 THEN 1.0 ELSE 0.0 END ELSE ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) END" if normal else s
    return f"""{_scored(_RANKED, "2.0")},
 ce AS (SELECT chunk_id, doc_id, {_hash("text")} AS e FROM chunks),
 qe AS (SELECT query_id, {_hash("query")} AS e FROM asked),
 v AS (SELECT query_id, doc_id, chunk_id, {_cosine("ce.e", "qe.e")} AS v FROM ce, qe QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, doc_id, chunk_id) <= 5),
 g AS (SELECT query_id, doc_id, chunk_id, score AS g FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5),
 merged AS (SELECT query_id, doc_id, chunk_id, v IS NOT NULL AS vector_hit, g IS NOT NULL AS graph_hit, coalesce(v, 0.0)::DOUBLE AS raw_vector_score, coalesce(g, 0.0)::DOUBLE AS raw_graph_score FROM v FULL JOIN g USING (query_id, doc_id, chunk_id)),
 sides AS (SELECT *, ({eff("raw_vector_score")})::DOUBLE AS vector_score, ({eff("raw_graph_score")})::DOUBLE AS graph_score FROM merged WINDOW w AS (PARTITION BY query_id)),
 fused AS (SELECT *, {alpha} * vector_score + {beta} * graph_score AS score, CASE WHEN vector_hit AND graph_hit THEN 'hybrid' WHEN vector_hit THEN 'vector' ELSE 'graph' END AS source FROM sides)"""


def _final(fused: str, k: int, least: str | None = None) -> str:
    return f"""{fused},
 final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, doc_id)::INT AS rank FROM fused {f"WHERE score >= {least}" if least else ""}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, doc_id) <= {k})"""


_RAW, _NORMAL = _fused("1.0", "1.0", False), _fused("0.5", "0.5", True)
_FUSED_COLUMNS = "query_id, doc_id, chunk_id, vector_hit, graph_hit, round(raw_vector_score, 6) AS raw_vector_score, round(raw_graph_score, 6) AS raw_graph_score, round(vector_score, 6) AS vector_score, round(graph_score, 6) AS graph_score, round(score, 6) AS score, source"

_VQ = "WITH vq AS (SELECT 'v' || vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, label::VARCHAR AS doc_id, vec_id::VARCHAR AS chunk_id, " + _cosine("embedding::DOUBLE[]", "q") + " AS score FROM embeddings, vq)"


def _vector_top(k: int, where: str = "true") -> str:
    return f"{_VQ} SELECT query_id, doc_id, chunk_id, round(score, 6) AS score, 'vector' AS source FROM s WHERE {where} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, doc_id, chunk_id) <= {k}"


def _recursive() -> str:
    part = "CASE WHEN t = '' THEN [] ELSE [t] END"
    sql = f"WITH {_DOCS},\n p0 AS (SELECT doc_id, {part} AS p FROM docs)"
    for n, sep in enumerate(SEPARATORS, 1):
        s = " || ".join("chr(10)" if c == "\n" else _q(c) for c in sep)
        cut = f"list_filter(list_transform(string_split(x, {s}), lambda y, i: CASE WHEN y = '' THEN NULL WHEN i < len(string_split(x, {s})) THEN y || {s} ELSE y END), lambda z: z IS NOT NULL)"
        sql += f",\n p{n} AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= 400 THEN [x] ELSE {cut} END)) AS p FROM p{n - 1})"
    return f"""{sql},
 small AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= 400 THEN [x] ELSE list_transform(range(0, length(x), 400), lambda s: substr(x, s + 1, 400)) END)) AS p FROM p{len(SEPARATORS)}),
 packed AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) <= 400 THEN list_concat(a[1:-2], [a[-1] || x[1]]) ELSE list_concat(a, x) END) AS c FROM small WHERE len(p) > 0)
SELECT doc_id || '#' || (i - 1) AS chunk_id, c[i] AS text, (i - 1)::INT AS position, doc_id AS parent_id, length(c[i])::INT AS length FROM packed, unnest(range(1, len(c) + 1)) AS u(i)"""


_SNIPPET = f"{_strip('replace(text, chr(10), chr(32))')}"
_EVAL_SAMPLES = "samples(query_id, query, relevant) AS (VALUES " + ", ".join(f"({_q(q)}, {_q(ASKED[int(q[1:]) - 1])}, [{', '.join(map(_q, ids))}])" for q, ids in RELEVANT.items()) + ")"
_EVAL = f"""{_NORMAL}, {_EVAL_SAMPLES},
 vonly AS (SELECT query_id, doc_id, chunk_id, CASE WHEN max(v) OVER w = min(v) OVER w THEN (v > 0)::INT::DOUBLE ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS n, 0.5 * n AS score FROM v WINDOW w AS (PARTITION BY query_id)),
 gonly AS (SELECT query_id, doc_id, chunk_id, CASE WHEN max(g) OVER w = min(g) OVER w THEN (g > 0)::INT::DOUBLE ELSE (g - min(g) OVER w) / (max(g) OVER w - min(g) OVER w) END AS n, 0.5 * n AS score FROM g WINDOW w AS (PARTITION BY query_id)),
 every AS (SELECT 'hybrid' AS mode, query_id, chunk_id, doc_id, score FROM fused UNION ALL SELECT 'vector', query_id, chunk_id, doc_id, score FROM vonly UNION ALL SELECT 'graph', query_id, chunk_id, doc_id, score FROM gonly),
 ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, chunk_id, doc_id) AS rank FROM every) WHERE rank <= 5),
 lists AS (SELECT m.mode, s.query, s.relevant, coalesce((SELECT list(chunk_id ORDER BY rank) FROM ranked r WHERE r.mode = m.mode AND r.query_id = s.query_id), []) AS got FROM samples s, (VALUES ('hybrid'), ('vector'), ('graph')) m(mode)),
 measured AS (SELECT *, len(list_intersect(got, relevant)) / len(relevant) AS recall, coalesce(1.0 / list_min(list_filter(list_transform(got, lambda x, i: CASE WHEN list_contains(relevant, x) THEN i END), lambda z: z IS NOT NULL)), 0.0)::DOUBLE AS mrr FROM lists)"""

_TERMS_OF_DOC = f"""
WITH words AS (SELECT doc_id::VARCHAR AS doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_]+') AS w FROM documents),
 each AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words),
 firsts AS (SELECT doc_id, t, min(i) AS i FROM each WHERE length(t) >= 2 AND NOT list_contains({_STOP}, t) GROUP BY ALL)
SELECT w.doc_id, count(t) AS n_terms, coalesce(string_agg(t, ' ' ORDER BY i), '') AS terms FROM words w LEFT JOIN firsts f ON f.doc_id = w.doc_id GROUP BY w.doc_id"""

ORACLE_SQL = {
    "extract_terms": _TERMS_OF_DOC,
    "term_doc_freq": f"WITH {_CHUNKS}, {_index()} SELECT term, count(*) AS chunk_count, count(DISTINCT doc_id) AS doc_count FROM posted GROUP BY term",
    "chunk_fixed": f"WITH {_CHUNKS} SELECT chunk_id, text, position, doc_id AS parent_id, length(text)::INT AS length FROM chunks",
    "chunk_recursive": _recursive(),
    "chunk_quality": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS chunk_count, min(length(text))::INT AS min_length, max(length(text))::INT AS max_length, round(avg(length(text)), 6) AS avg_length, string_agg(length(text), ',' ORDER BY position) FILTER (position < 10) AS first_lengths FROM chunks GROUP BY doc_id",
    "ingest_result": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY doc_id",
    "hash_embedding": f"WITH h AS (SELECT doc_id::VARCHAR AS doc_id, {_hash('text')} AS e FROM documents) SELECT doc_id, (k - 1)::INT AS i, round(e[k], 6) AS value FROM h, unnest(range(1, 33)) AS u(k)",
    "cosine_scores": f"{_VQ} SELECT query_id, doc_id, chunk_id, round(score, 6) AS score FROM s",
    "vector_topk": _vector_top(10),
    "vector_topk_filtered": _vector_top(10, "doc_id = '3'"),
    "vector_topk_minscore": _vector_top(50, "s.score >= 0.2"),
    "cooccurrence_edges": _edges(_CHUNKS),
    "edges_after_upserts": _edges(_REPLACED),
    "neighbours": f"WITH {_NEAR} SELECT term, neighbour, weight FROM near",
    "direct_hits": f"WITH {_BASE} SELECT query_id, chunk_id, count(*) AS hits, string_agg(term, ' ' ORDER BY term) AS terms FROM qterms JOIN posted USING (term) GROUP BY ALL",
    "expand_ranked": f"WITH {_RANKED} SELECT * FROM expanded",
    "expand_greedy": f"WITH {_GREEDY} SELECT * FROM expanded",
    "expanded_hits": f"WITH {_RANKED} SELECT query_id, chunk_id, count(*) AS hits, string_agg(expanded_term, ' ' ORDER BY expanded_term) AS terms, sum(weight * 0.5) AS contribution FROM expanded JOIN posted ON term = expanded_term GROUP BY ALL",
    "graph_topk": _graph(_RANKED, "2.0"),
    "graph_topk_capped": _graph(_RANKED, "0.5"),
    "graph_topk_nocap": _graph(_RANKED, "NULL::DOUBLE"),
    "graph_topk_greedy": _graph(_GREEDY, "2.0"),
    "graph_topk_by_key": _graph(_GREEDY, "2.0"),
    "graph_explain": f"""WITH {_scored(_RANKED, "2.0")},
 top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10),
 d AS (SELECT query_id, string_agg(term, ' ' ORDER BY term) AS direct_terms FROM qterms GROUP BY query_id),
 n AS (SELECT query_id, count(*)::INT AS expanded_terms FROM expanded GROUP BY query_id),
 c AS (SELECT query_id, chunk_id, coalesce(string_agg(f.term, ' ' ORDER BY f.term) FILTER (direct), '') AS chunk_terms, coalesce(string_agg(f.term, ' ' ORDER BY f.weight DESC, f.term) FILTER (NOT direct), '') AS chunk_expanded FROM found f GROUP BY ALL)
SELECT a.query_id, coalesce(direct_terms, '') AS direct_terms, coalesce(expanded_terms, 0) AS expanded_terms, t.chunk_id, chunk_terms, chunk_expanded, t.direct_hit_count::DOUBLE AS direct_score, capped_expanded_score, score
FROM asked a LEFT JOIN d USING (query_id) LEFT JOIN n USING (query_id) LEFT JOIN top t USING (query_id) LEFT JOIN c ON c.query_id = a.query_id AND c.chunk_id = t.chunk_id""",
    "fuse_raw": f"WITH {_RAW} SELECT {_FUSED_COLUMNS} FROM fused",
    "fuse_minmax": f"WITH {_NORMAL} SELECT {_FUSED_COLUMNS} FROM fused",
    "postprocess_topk": f"WITH {_final(_RAW, 4, '1.0')} SELECT query_id, rank, doc_id, chunk_id, source, round(score, 6) AS score FROM final",
    "hybrid_search": f"WITH {_final(_NORMAL, 5)} SELECT query_id, rank, f.doc_id, f.chunk_id, source, round(score, 6) AS score, text FROM final f JOIN chunks c ON c.chunk_id = f.chunk_id",
    "citations": f"WITH {_final(_NORMAL, 5, '0.2')} SELECT query_id, doc_id, chunk_id, source, round(score, 6) AS score, rank FROM final",
    "ranking_preview": f"WITH {_final(_NORMAL, 5)} SELECT query_id, rank, doc_id, chunk_id, source, CASE source WHEN 'hybrid' THEN 'vector,graph' ELSE source END AS matched_by, vector_hit, graph_hit, round(raw_vector_score, 6) AS raw_vector_score, round(raw_graph_score, 6) AS raw_graph_score, round(vector_score, 6) AS effective_vector_score, round(graph_score, 6) AS effective_graph_score, round(score, 6) AS final_score FROM final",
    "retrieval_debug": f"""WITH {_final(_NORMAL, 5)},
 gtop AS (SELECT query_id, count(*) AS n, bool_or(expansion_capped) AS capped FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5) GROUP BY query_id),
 n AS (SELECT query_id, (SELECT count(*) FROM v WHERE v.query_id = a.query_id) AS vector_count, (SELECT count(*) FROM fused f WHERE f.query_id = a.query_id) AS fused_count, (SELECT count(*) FROM final f WHERE f.query_id = a.query_id) AS final_count FROM asked a)
SELECT query_id, 'hybrid' AS mode, vector_count, coalesce(gtop.n, 0) AS graph_count, fused_count, final_count, greatest(fused_count - final_count, 0) AS postprocess_removed_count, coalesce(capped, false) AS has_expansion_capped_result FROM n LEFT JOIN gtop USING (query_id)""",
    "simple_answer": f"""WITH {_final(_NORMAL, 5)},
 lines AS (SELECT query_id, rank, printf('- [%s] %s/%s score=%.3f: ', source, f.doc_id, f.chunk_id, score) || CASE WHEN length({_SNIPPET}) > 160 THEN left({_SNIPPET}, 160) || '...' ELSE {_SNIPPET} END AS line FROM final f JOIN chunks c ON c.chunk_id = f.chunk_id WHERE rank <= 3),
 body AS (SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS b FROM lines GROUP BY query_id)
SELECT query_id, coalesce({_q(LISTING)} || b, {_q(NOTHING)} || query) AS answer FROM asked LEFT JOIN body USING (query_id)""",
    "rag_prompt": f"""WITH {_final(_NORMAL, 5)},
 body AS (SELECT query_id, string_agg(printf('[%s:%s|%s|score=%.4f]', f.doc_id, f.chunk_id, source, score) || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS b FROM final f JOIN chunks c ON c.chunk_id = f.chunk_id GROUP BY query_id)
SELECT query_id, {_q(PROMPT[0])} || query || {_q(PROMPT[1])} || coalesce(b, '') || {_q(PROMPT[2])} AS prompt FROM asked LEFT JOIN body USING (query_id)""",
    "eval_case": f"WITH {_EVAL} SELECT mode, query, round(recall, 6) AS recall_at_k, round(mrr, 6) AS mrr, array_to_string(list_filter(relevant, lambda x: NOT list_contains(got, x)), ' ') AS false_negatives, array_to_string(list_filter(got, lambda x: NOT list_contains(relevant, x)), ' ') AS false_positives, array_to_string(list_sort(list_transform(list_distinct(relevant), lambda x: x || ':' || coalesce(nullif(list_position(got, x), 0)::VARCHAR, '-'))), ' ') AS relevant_ranks FROM measured",
    "eval_recall_mrr": f"WITH {_EVAL} SELECT mode, 5 AS k, count(*)::INT AS sample_count, round(avg(recall), 6) AS avg_recall_at_k, round(avg(mrr), 6) AS avg_mrr FROM measured GROUP BY mode",
    "fusion_weight_sweep": f"WITH {_NORMAL}, w(alpha, beta) AS (VALUES (1.0::DOUBLE, 0.0::DOUBLE), (0.7, 0.3), (0.5, 0.5), (0.0, 1.0)), x AS (SELECT alpha, beta, query_id, chunk_id, doc_id, alpha * vector_score + beta * graph_score AS s FROM fused, w), r AS (SELECT *, row_number() OVER (PARTITION BY alpha, beta, query_id ORDER BY s DESC, chunk_id, doc_id)::INT AS rank FROM x) SELECT alpha, beta, query_id, rank, chunk_id, round(s, 6) AS score FROM r WHERE rank <= 3",
    "replace_docs": f"""WITH {_REPLACED}, {_index()},
 n AS (SELECT doc_id, count(*) AS terms FROM posted GROUP BY doc_id)
SELECT c.doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars, coalesce(any_value(terms), 0) AS terms FROM chunks c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id""",
    "index_build": f"""WITH {_CHUNKS}, {_index()}, n AS (SELECT chunk_id, count(*)::INT AS terms FROM posted GROUP BY chunk_id),
 e AS (SELECT chunk_id, {_hash("text")} AS v FROM chunks)
SELECT c.chunk_id, c.doc_id, c.position, length(c.text)::INT AS length, coalesce(terms, 0) AS terms, round(sqrt({_DOT.format(a="v", b="v")}), 6) AS norm FROM chunks c JOIN e ON e.chunk_id = c.chunk_id LEFT JOIN n ON n.chunk_id = c.chunk_id""",
    "fusion_debug": f"""WITH {_final(_NORMAL, 5)},
 counts AS (SELECT query_id, count(*) FILTER (vector_hit) AS vector_count, count(*) FILTER (graph_hit) AS graph_count, count(*) FILTER (vector_hit AND graph_hit) AS overlap_count, string_agg(chunk_id, ' ' ORDER BY score DESC, chunk_id, doc_id) AS every FROM fused GROUP BY query_id),
 firsts AS (SELECT query_id, string_agg(chunk_id, ' ' ORDER BY score DESC, chunk_id, doc_id) AS final_hits FROM final GROUP BY query_id)
SELECT f.query_id, 0.5 AS alpha, 0.5 AS beta, 'minmax' AS method, vector_count, graph_count, overlap_count, every AS fused_hits, final_hits, f.chunk_id, round(raw_vector_score, 6) AS raw_vector_score, round(raw_graph_score, 6) AS raw_graph_score, round(vector_score, 6) AS vector_score, round(graph_score, 6) AS graph_score, round(score, 6) AS score
FROM fused f JOIN counts c ON c.query_id = f.query_id JOIN firsts d ON d.query_id = f.query_id""",
}
