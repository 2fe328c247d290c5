"""DuckDB SQL of the registered queries, written from the same definitions."""

from __future__ import annotations

from lexweave.operators.memory import SYSTEM


def norm(x: str) -> str:
    kept = rf"regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}}_\x09-\x0D\x20\x1c-\x1f\x85\p{{Z}}]', '', 'g')"
    return rf"lower(trim(regexp_replace({kept}, '[\x09-\x0D\x20\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')))"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^[\x09-\x0D\x20\x1c-\x1f\x85\p{{Z}}]+|[\x09-\x0D\x20\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"


def feature_tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[A-Za-z0-9가-힣_]+'))"


def overlap(a: str, b: str) -> str:
    """Jaccard of two columns of feature tokens."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def hit(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) THEN 1.0 ELSE 0.0 END"


LANGUAGE = "CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END"

DOCS = f"""
tok AS (SELECT doc_id AS example_id, lang, list_filter(string_split({norm('text')}, ' '), lambda w: w <> '') AS t FROM documents),
sp AS (SELECT DISTINCT example_id, lang, n, array_to_string(t[i : i + n - 1], ' ') AS surface
       FROM (SELECT example_id, lang, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM tok, (SELECT unnest([3, 4, 5]) AS n) WHERE len(t) >= n)),
spans AS (SELECT * FROM sp WHERE length(surface) >= 2 AND regexp_matches(surface, '\\p{{L}}')),
item AS (SELECT 'Q' || item_id AS qid, list_filter(string_split({norm('text')}, ' '), lambda w: w <> '') AS t FROM benchmark),
surf AS (SELECT DISTINCT qid, array_to_string(t[i : i + n - 1], ' ') AS surface
         FROM (SELECT qid, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM item, (SELECT unnest([3, 4, 5]) AS n) WHERE len(t) >= n))
"""

PARTS = f"""
ex AS (SELECT l_orderkey AS example_id, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey) AS source, 'P' || arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS gold_qid
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
kb AS (SELECT 'P' || p_partkey AS qid, p_name AS label, p_brand AS alias, p_type AS etype, p_type || ' ' || p_name AS description, p_retailprice AS pop, p_size >= 10 AS ok, {norm('p_name')} AS surface FROM part),
tok AS (SELECT example_id, list_filter(string_split({norm('source')}, ' '), lambda w: w <> '') AS t FROM ex),
sp AS (SELECT DISTINCT example_id, n, array_to_string(t[i : i + n - 1], ' ') AS surface
       FROM (SELECT example_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM tok, (SELECT unnest([1, 2, 3, 4, 5]) AS n) WHERE len(t) >= n)),
amb AS (SELECT surface, count(DISTINCT qid) AS a FROM kb GROUP BY surface),
best AS (SELECT kb.*, a, row_number() OVER (PARTITION BY kb.surface ORDER BY pop DESC, qid) AS r FROM kb JOIN amb USING (surface) WHERE ok QUALIFY r <= 5),
surf AS (SELECT example_id, qid, 1 AS stage, 'surface_search' AS candidate_source, surface AS source_span, n AS nt, length(surface) AS nc, r, a AS ambiguity_count, label, alias, etype, description, pop
         FROM sp JOIN best USING (surface) WHERE length(surface) >= 2 AND regexp_matches(surface, '\\p{{L}}')),
anch AS (SELECT example_id, qid, 0 AS stage, 'anchored_qid' AS candidate_source, NULL::VARCHAR AS source_span, 0 AS nt, 0 AS nc, 1 AS r, 1 AS ambiguity_count, label, alias, etype, description, pop
         FROM ex JOIN kb ON qid = gold_qid WHERE ok)
"""


def ranked(parts: str, k: int = 10) -> str:
    return f"""
every AS ({parts}),
uniq AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY example_id, qid ORDER BY stage, nt DESC, nc DESC, source_span, r) = 1),
cand AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY stage, nt DESC, nc DESC, source_span, r) AS rank FROM uniq QUALIFY rank <= {k})
"""


BOTH, ONLY_SURFACE, ONLY_ANCHORED = "SELECT * FROM surf UNION ALL SELECT * FROM anch", "SELECT * FROM surf", "SELECT * FROM anch"

#: Sources are names parted by single blanks, so a span's place shows between blanks.
SPANS = """
al AS (SELECT cand.*, ex.source, ex.gold_qid, coalesce(source_span, label) AS aligned, strpos(' ' || source || ' ', ' ' || coalesce(source_span, label) || ' ') - 1 AS span_start FROM cand JOIN ex USING (example_id))
"""

FEATURED = f"""
w0 AS (SELECT al.*, aligned AS span_text, first_value(aligned) OVER (PARTITION BY example_id ORDER BY rank) AS passed FROM al),
w1 AS (SELECT *, {feature_tokens('passed')} AS tp, {feature_tokens('label')} AS tl, {feature_tokens('span_text')} AS ts, {feature_tokens('alias')} AS ta, {feature_tokens('source')} AS tsrc, {feature_tokens('description')} AS td FROM w0),
w2 AS (SELECT *, greatest({overlap('tp', 'tl')}, {hit('passed', 'label')}, {overlap('tp', 'ts')}, {hit('passed', 'span_text')}, {overlap('tp', 'ta')}, {hit('passed', 'alias')}) AS so, {overlap('tsrc', 'td')} AS dso FROM w1),
feat AS (SELECT *, round(0.5 * so + 0.2 * dso + 0.3 * 1.0, 6) AS ctx, CASE WHEN qid = gold_qid THEN 1.0 ELSE 0.0 END AS prior FROM w2),
scored AS (SELECT *, round(0.45 * ctx + 0.2 * so + 0.1 * dso + 0.15 + 0.1, 6) AS score FROM feat),
rr AS (SELECT *, score + 0.1 * prior AS final_score, row_number() OVER (PARTITION BY example_id ORDER BY score + 0.1 * prior DESC, rank) AS final_rank,
              lead(score + 0.1 * prior) OVER (PARTITION BY example_id ORDER BY score + 0.1 * prior DESC, rank) AS next_score FROM scored)
"""

MEMORIES = """
mem AS (SELECT ex.example_id, ex.source, a.qid, a.label, a.alias, a.etype, a.description FROM ex LEFT JOIN anch a USING (example_id)),
txt AS (SELECT *, '[ENTITY MEMORY]' || chr(10) || '- Source Sentence: ' || source || chr(10) || '- Source Span: ' || label || chr(10) || '  QID: ' || qid || chr(10) || '  Target (en): ' || label AS head,
               chr(10) || '  Aliases: ' || alias AS line_alias, chr(10) || '  Type: ' || etype AS line_type, chr(10) || '  Description: ' || description AS line_text FROM mem)
"""

TASK = "'[TASK]' || chr(10) || 'Translate the following sentence into English naturally and accurately.' || chr(10) || chr(10)"
PROMPT = f"{TASK} || CASE WHEN qid IS NULL THEN '' ELSE head || line_alias || line_type || line_text || chr(10) || chr(10) END || '[SOURCE]' || chr(10) || source"


def parts_query(select: str, *ctes: str, cand: str = BOTH, k: int = 10) -> str:
    return "WITH " + ",".join([PARTS, ranked(cand, k), *ctes]) + select


FEATURED_OWN = FEATURED.replace("first_value(aligned) OVER (PARTITION BY example_id ORDER BY rank)", "aligned")

#: The rows to train on: the gold candidate and the eight hardest others, with their places.
HARD = """
hard AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY y DESC, nth) - 1 AS place FROM (
  SELECT *, coalesce(qid = gold_qid, false)::INT AS y, row_number() OVER (PARTITION BY example_id, coalesce(qid = gold_qid, false) ORDER BY round(so, 6) DESC, pop DESC, ambiguity_count DESC, rank) AS nth FROM feat
) WHERE y = 1 OR nth <= 8)
"""

VECTOR = "[ctx, 1.0, 1.0, round(so, 6), round(dso, 6), round(ln(1 + length(label)), 6), round(ln(2), 6), 1.0, 1.0, round(pop, 6), round(ln(1 + ambiguity_count), 6)]"

MENTIONS = f"""
it AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS nth, count(*) OVER () AS n_items, list_filter(string_split({norm('text')}, ' '), lambda w: w <> '') AS w FROM benchmark),
ment AS (SELECT l.doc_id, [w[1], array_to_string(w[1:2], ' ')] AS m FROM labels l JOIN it ON nth = l.doc_id % n_items),
ok AS (SELECT coalesce(len(list_filter(m, lambda x: x <> '' AND contains(lower(coalesce(text, '')), lower(x)))) > 0, false)::INT AS hit, (d.doc_id IS NULL)::INT AS gone FROM ment LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id)),
eta AS (SELECT coalesce(sum(hit), 0)::BIGINT AS correct, count(*) AS total, coalesce(sum(gone), 0)::BIGINT AS missing_predictions, coalesce(avg(hit), 0.0) AS m_eta FROM ok)
"""

MEANS = """
sc AS (SELECT l_orderkey AS id, max(1.0 - l_discount) AS best FROM lineitem GROUP BY 1),
ag AS (SELECT count(best) AS matched, count(*) - count(best) AS missing, coalesce(sum(best) / count(*), 0.0) AS mean_score FROM (SELECT DISTINCT o_orderkey AS id FROM orders) LEFT JOIN sc USING (id))
"""

NAMES = """
rec AS (SELECT d.doc_id AS id, d.lang, max(l.quality) AS q, any_value(d.text) AS text, any_value(d.source) AS site FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2),
nam AS (SELECT *, list_sort(list_distinct(list_filter([coalesce(list_filter(string_split({norm}, ' '), lambda w: w <> '')[1], 'none'), {strip}], lambda w: w <> ''))) AS m FROM rec)
""".format(norm=norm("text"), strip=strip("site"))


def mode_query(mode: str, chosen: str, *ctes: str, cand: str = BOTH) -> str:
    """What a mode remembers of each order; chosen: the candidates of one each."""
    return "(" + parts_query(f"SELECT ex.example_id, '{mode}' AS mode, c.qid, coalesce(c.source_span, c.label) AS source_span, c.label AS canonical_target FROM ex LEFT JOIN ({chosen}) c USING (example_id)", *ctes, cand=cand) + ")"


RECALLS = ", ".join(f"round(coalesce(avg(coalesce(gr <= {k}, false)::INT), 0.0), 9) AS recall_at_{k}" for k in (1, 3, 5, 10))
_IDS = "list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: length(w))"

TURN_IDS = f"""
s AS (SELECT conv_id, turn, role, {_IDS.format(norm('text'))} AS ids FROM conversations WHERE role IN ('user', 'assistant')),
i AS (SELECT *, coalesce(flatten(list(ids) OVER (PARTITION BY conv_id ORDER BY turn, role DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS p FROM s)
"""

ASSEMBLY = """WITH l AS (SELECT l_orderkey AS example_id, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_partkey, l_returnflag || l_linestatus) AS targets,
        list('P' || l_partkey ORDER BY l_linenumber, 'P' || l_partkey) AS qids FROM lineitem GROUP BY 1),
      t AS (SELECT l_orderkey AS example_id, list_filter(list(p_type ORDER BY l_linenumber, p_type), lambda x: true) AS ty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
      m AS (SELECT l_orderkey AS example_id, list(term ORDER BY l_linenumber, f, id, term) AS names FROM lineitem JOIN (
          SELECT p_partkey, p_name AS term, 0 AS f, p_partkey * 4 AS id FROM part UNION ALL SELECT p_partkey, p_brand, 1, p_partkey * 4 + 1 FROM part) ON l_partkey = p_partkey GROUP BY 1),
      d AS (SELECT example_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(names, lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS names FROM m),
      e AS (SELECT example_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(ty, lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS ty FROM t)
      SELECT o_orderkey AS example_id, targets[1] AS target, qids[1] AS gold_qid, coalesce(len(targets), 0)::INT AS n_targets, names[1] AS mention, coalesce(array_to_string(qids, ','), '') AS qids,
        coalesce(array_to_string(ty, ','), '') AS types, array_to_string(names, ',') AS mention_candidates
      FROM orders LEFT JOIN l ON l.example_id = o_orderkey LEFT JOIN d ON d.example_id = o_orderkey LEFT JOIN e ON e.example_id = o_orderkey {where}"""

SQL = {
    "normalize_surface": f"SELECT doc_id, surface, len(list_filter(string_split(surface, ' '), lambda w: w <> ''))::INT AS n_tokens FROM (SELECT doc_id, {norm('text')} AS surface FROM documents)",
    "span_ngrams": f"WITH {DOCS} SELECT example_id, n::INT AS n, count(*) AS n_spans, sum(length(surface))::BIGINT AS n_chars FROM spans GROUP BY example_id, n",
    "surface_index": f"WITH {DOCS} SELECT surface, qid, target_lang, 0.0::DOUBLE AS popularity FROM surf, (SELECT unnest(['en', 'de', 'fr', 'es']) AS target_lang)",
    "ambiguity_count": f"WITH {PARTS} SELECT surface, a AS ambiguity_count FROM amb",
    "surface_topk": f"""WITH {DOCS}, amb AS (SELECT surface, count(DISTINCT qid) AS a FROM surf GROUP BY surface),
      best AS (SELECT surface, qid, a, row_number() OVER (PARTITION BY surface ORDER BY qid) AS r FROM surf JOIN amb USING (surface) QUALIFY r <= 5),
      hits AS (SELECT example_id, qid, surface, n, length(surface) AS nc, r, a FROM spans JOIN best USING (surface) WHERE lang IN ('en', 'de', 'fr', 'es')),
      uniq AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY example_id, qid ORDER BY n DESC, nc DESC, surface, r) = 1)
      SELECT example_id, (row_number() OVER (PARTITION BY example_id ORDER BY n DESC, nc DESC, surface, r))::INT AS rank, qid, surface, a AS ambiguity_count FROM uniq QUALIFY rank <= 10""",
    "surface_topk_ambiguous": parts_query("SELECT example_id, rank::INT AS rank, qid, source_span, ambiguity_count FROM cand", cand=ONLY_SURFACE),
    "anchored_lookup": parts_query("SELECT example_id, qid, label AS target_label, etype AS entity_type, pop AS popularity FROM cand", cand=ONLY_ANCHORED),
    "retrieve_top1": parts_query("SELECT example_id, qid, candidate_source FROM cand", k=1),
    "candidate_list": parts_query("SELECT example_id, rank::INT AS rank, qid, candidate_source, source_span FROM cand"),
    "align_spans": parts_query(
        "SELECT example_id, qid, span_start::INT AS span_start, (span_start + length(aligned))::INT AS span_end, aligned AS matched_text, 'boundary_exact' AS match_kind, 1.0::DOUBLE AS match_score FROM al", SPANS
    ),
    "rerank_features": parts_query(
        """SELECT example_id, qid, ctx AS context_suitability, 1.0::DOUBLE AS has_source_span, 1.0::DOUBLE AS span_match_score, round(so, 6) AS surface_overlap_score, round(dso, 6) AS description_overlap_score,
        round(ln(1 + length(label)), 6) AS target_label_len, round(ln(2), 6) AS alias_count, 1.0::DOUBLE AS has_entity_type, 1.0::DOUBLE AS has_description, round(pop, 6) AS popularity_score,
        round(ln(1 + ambiguity_count), 6) AS ambiguity_count FROM feat""", SPANS, FEATURED
    ),
    "rerank_heuristic": parts_query("SELECT example_id, qid, score AS reranker_score, round(final_score, 6) AS final_score, final_rank::INT AS final_rank FROM rr", SPANS, FEATURED),
    "margin_to_next": parts_query("SELECT example_id, qid, round(final_score - next_score, 6) AS margin_to_next FROM rr WHERE final_rank = 1", SPANS, FEATURED),
    "entity_memory_text": f"WITH {PARTS}, {MEMORIES} SELECT example_id, CASE WHEN qid IS NULL THEN '[ENTITY MEMORY]' || chr(10) || '- None' ELSE head || line_alias || line_type || line_text END AS memory_text FROM txt",
    "translation_prompt": f"WITH {PARTS}, {MEMORIES} SELECT example_id, {PROMPT} AS prompt FROM txt",
    "plain_prompt": f"SELECT doc_id, '[TASK]' || chr(10) || 'Translate the following sentence into ' || {LANGUAGE} || ' naturally and accurately.' || chr(10) || chr(10) || '[SOURCE]' || chr(10) || {strip('text')} AS prompt FROM documents",
    "noisy_memory": f"""WITH {PARTS}, {MEMORIES} SELECT example_id, head || line_type || line_text AS drop_alias, head || line_alias || line_type AS drop_description,
      replace(head, '  Target (en): ' || label, '  Target (en): ' || alias) || line_alias || line_type || line_text AS replace_canonical_with_alias FROM txt WHERE qid IS NOT NULL""",
    "sft_samples": f"WITH {PARTS}, {MEMORIES} SELECT example_id, {PROMPT} AS prompt, label AS target, 'entity-memory' AS mode FROM txt WHERE qid IS NOT NULL",
    "chat_messages": f"""SELECT conv_id, '[SYSTEM]' || chr(10) || '{SYSTEM}' || string_agg(chr(10) || chr(10) || '[' || upper(role) || ']' || chr(10) || {strip('text')}, '' ORDER BY turn, role DESC) AS chat
      FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""",
    "completion_labels": f"""WITH {TURN_IDS},
      l AS (SELECT conv_id, turn, list_concat(list_concat(list_transform(p, lambda x: -100), ids), [0])[1:2048] AS labels FROM i WHERE role = 'assistant')
      SELECT conv_id, turn, len(labels)::INT AS n_labels, len(list_filter(labels, lambda x: x = -100))::INT AS n_masked, array_to_string(labels, ',') AS labels FROM l WHERE len(list_filter(labels, lambda x: x <> -100)) > 0""",
    "hard_negatives": parts_query(
        """SELECT example_id, (row_number() OVER (PARTITION BY example_id ORDER BY label DESC, nth) - 1)::INT AS candidate_rank_in_group, qid, label FROM (
          SELECT cand.example_id, qid, coalesce(qid = gold_qid, false)::INT AS label,
            row_number() OVER (PARTITION BY cand.example_id, coalesce(qid = gold_qid, false) ORDER BY pop DESC, ambiguity_count DESC, rank) AS nth
          FROM cand JOIN ex USING (example_id)) WHERE label = 1 OR nth <= 8"""
    ),
    "retrieval_recall": f"WITH {PARTS}, {ranked(BOTH)}, every2 AS ({ONLY_SURFACE}), "
    + "uniq2 AS (SELECT * FROM every2 QUALIFY row_number() OVER (PARTITION BY example_id, qid ORDER BY stage, nt DESC, nc DESC, source_span, r) = 1), "
    + "cand2 AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY stage, nt DESC, nc DESC, source_span, r) AS rank FROM uniq2 QUALIFY rank <= 10) "
    + f"SELECT 'anchored_and_surface' AS candidates, {RECALLS} FROM (SELECT ex.example_id, min(rank) AS gr FROM ex LEFT JOIN cand ON cand.example_id = ex.example_id AND qid = gold_qid GROUP BY 1) "
    + f"UNION ALL SELECT 'surface_only', {RECALLS} FROM (SELECT ex.example_id, min(rank) AS gr FROM ex LEFT JOIN cand2 ON cand2.example_id = ex.example_id AND qid = gold_qid GROUP BY 1)",
    "reranker_mrr": parts_query(
        "SELECT count(*) AS n_groups, round(coalesce(avg((final_rank = 1)::INT), 0.0), 9) AS top1_accuracy, round(coalesce(avg(1.0 / final_rank), 0.0), 9) AS mrr, "
        + ", ".join(f"round(coalesce(avg((final_rank <= {k})::INT), 0.0), 9) AS recall_at_{k}" for k in (1, 3, 5)) + " FROM rr WHERE qid = gold_qid", SPANS, FEATURED
    ),
    "m_eta": f"WITH {MENTIONS} SELECT correct, total, missing_predictions, round(m_eta, 9) AS m_eta FROM eta",
    "comet_aggregate": f"WITH {MEANS} SELECT matched, missing, round(mean_score, 9) AS mean_score FROM ag",
    "harmonic_final": f"WITH {MENTIONS}, {MEANS} SELECT round(CASE WHEN m_eta <= 0 OR mean_score <= 0 THEN 0.0 ELSE 2 * m_eta * mean_score / (m_eta + mean_score) END, 9) AS harmonic_mean FROM eta, ag",
    "prediction_records": f"""SELECT doc_id::VARCHAR AS id, 'en_US' AS source_language, CASE lang WHEN 'en' THEN 'en_US' WHEN 'de' THEN 'de_DE' WHEN 'fr' THEN 'fr_FR' WHEN 'es' THEN 'es_ES' ELSE lang END AS target_language,
      {strip('text')} AS text, {strip('text')} AS prediction FROM documents""",
    "dataset_assembly": ASSEMBLY.format(where=""),
    "dataset_load": ASSEMBLY.format(where="WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "dataset_load_first": ASSEMBLY.format(where="WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100)"),
    # RE2 has no lookbehind: what is before a match at boundaries is empty or ends in a character that is no word's.
    "align_variants": rf"""WITH d AS (SELECT doc_id, {strip('text')} AS source, string_split(coalesce(text, ''), ' ') AS w FROM documents),
      v AS (SELECT doc_id, source, unnest([0, 1]) AS nth, unnest([substr(coalesce(w[2], ''), 2, 3), translate(coalesce(w[5], ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')]) AS raw FROM d),
      n AS (SELECT doc_id, source, nth, {strip('raw')} AS variant, {norm('raw')} AS surface FROM v),
      ok AS (SELECT * FROM n WHERE length(surface) >= 2 AND regexp_matches(surface, '\p{{L}}') QUALIFY row_number() OVER (PARTITION BY doc_id, surface ORDER BY nth) = 1),
      p AS (SELECT *, '(?s)^((?:.*?[^\p{{L}}\p{{N}}_])??)' || regexp_escape(lower(variant)) || '(?:$|[^\p{{L}}\p{{N}}_])' AS pattern FROM ok),
      m AS (SELECT *, regexp_matches(lower(source), pattern) AS bounded, length(regexp_extract(lower(source), pattern, 1)) AS pos, strpos(lower(source), lower(variant)) - 1 AS loose FROM p),
      f AS (SELECT doc_id, source, length(variant) AS len, CASE WHEN bounded THEN pos WHEN loose >= 0 THEN loose END AS start, bounded FROM m WHERE bounded OR loose >= 0),
      b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY bounded DESC, len DESC, start) = 1)
      SELECT doc_id, start::INT AS span_start, (start + len)::INT AS span_end, substr(b.source, (start + 1)::BIGINT, len) AS matched_text, CASE WHEN bounded THEN 'boundary_exact' WHEN start IS NOT NULL THEN 'substring' END AS match_kind,
        CASE WHEN bounded THEN 1.0 WHEN start IS NOT NULL THEN 0.85 END::DOUBLE AS match_score FROM d LEFT JOIN (SELECT doc_id, source, len, start, bounded FROM b) b USING (doc_id)""",
    "pipeline_modes": " UNION ALL ".join([
        mode_query("anchored", "SELECT * FROM cand WHERE rank = 1", cand=ONLY_ANCHORED), mode_query("surface", "SELECT * FROM cand WHERE rank = 1", cand=ONLY_SURFACE),
        mode_query("retrieve", "SELECT * FROM cand WHERE rank = 1"), mode_query("rerank", "SELECT * FROM rr WHERE final_rank = 1", SPANS, FEATURED),
    ]),
    "gold_memories": f"""WITH {PARTS}, g AS (SELECT ex.example_id, source, gold_qid, p_size < 20 AS known, kb.* FROM ex JOIN kb ON qid = gold_qid JOIN part ON 'P' || p_partkey = qid)
      SELECT example_id, CASE WHEN known THEN 'gold_qid_lookup' ELSE 'fallback_qid_only' END AS candidate_source,
        '[ENTITY MEMORY]' || chr(10) || '- Source Sentence: ' || source || CASE WHEN known THEN chr(10) || '- Source Span: ' || label ELSE '' END || chr(10) || '  QID: ' || gold_qid ||
        CASE WHEN known THEN chr(10) || '  Target (en): ' || label || chr(10) || '  Aliases: ' || alias || chr(10) || '  Type: ' || etype || chr(10) || '  Description: ' || description ELSE '' END AS memory_text FROM g""",
    "plain_samples": f"""SELECT doc_id AS example_id, '[TASK]' || chr(10) || 'Translate the following sentence into ' || {LANGUAGE} || ' naturally and accurately.' || chr(10) || chr(10) || '[SOURCE]' || chr(10) || {strip('text')} AS prompt,
      {strip('source')} AS target, 'plain' AS mode FROM documents WHERE {strip('text')} <> '' AND {strip('source')} <> ''""",
    "noisy_samples": f"WITH {PARTS}, {MEMORIES} SELECT example_id, {PROMPT.replace(' || line_text', '')} AS prompt, label AS target, 'noisy-memory' AS mode FROM txt WHERE qid IS NOT NULL",
    "feature_records": parts_query(
        """SELECT example_id, source AS source_text, passed AS source_span_text, passed AS comparison_source_text, 'source_span' AS comparison_source_origin, label AS target_label, etype AS entity_type, description, qid,
        candidate_source, 'boundary_exact' AS span_match_kind, ctx AS context_suitability, 1::INT AS has_source_span, 1.0::DOUBLE AS span_match_score, round(so, 6) AS surface_overlap_score, round(dso, 6) AS description_overlap_score,
        round(ln(1 + length(label)), 6) AS target_label_len, round(ln(2), 6) AS alias_count, 1::INT AS has_entity_type, 1::INT AS has_description, round(pop, 6) AS popularity_score, round(ln(1 + ambiguity_count), 6) AS ambiguity_count,
        prior::INT AS is_canonical_prior, prior::DOUBLE AS prior_bonus, length(label)::INT AS raw_target_label_len, 1::INT AS raw_alias_count, ambiguity_count::BIGINT AS raw_ambiguity_count FROM feat""", SPANS, FEATURED
    ),
    "fixed_scorer": parts_query(
        f"""SELECT example_id, qid, round(0.125 + greatest(0, 0.25 + 0.5 * v[1] + 0.125 * (v[2] + v[3] + v[4] + v[5]) + 0.0625 * (v[6] + v[7] + v[8] + v[9]) + 0.001 * v[10] - 0.5 * v[11])
          - 2 * greatest(0, -0.5 - 0.25 * v[1] + 0.25 * (v[2] + v[3] + v[4] + v[5]) - 0.125 * (v[6] + v[7] + v[8] + v[9]) + 0.25 * v[11]), 11) AS score FROM (SELECT *, {VECTOR}::DOUBLE[] AS v FROM hard)""", SPANS, FEATURED_OWN, HARD
    ),
    "grouped_training_rows": parts_query(
        f"""SELECT example_id, string_agg(array_to_string(list_transform({VECTOR}::DOUBLE[], lambda x: printf('%.6f', x)), ','), '|' ORDER BY place) AS numeric_features,
        string_agg(y::VARCHAR, ',' ORDER BY place) AS labels, string_agg(qid, ',' ORDER BY place) AS qids FROM hard GROUP BY example_id""", SPANS, FEATURED_OWN, HARD
    ),
    "legacy_spans": f"""WITH {PARTS} SELECT example_id, coalesce(upper(list_sort(list_transform(list_filter([split_part(label, ' ', 1), alias, split_part(label, ' ', 2)], lambda n: n <> '' AND contains(lower(source), lower(n))),
      lambda n: {{'l': -length(n), 'n': n}}))[1].n), '') AS span FROM ex JOIN kb ON qid = gold_qid""",
    "evaluation_summary": f"""WITH {NAMES},
      ok AS (SELECT id, lang = 'de' AS gone, coalesce(lang <> 'de' AND len(list_filter(m, lambda x: contains(lower(coalesce(text, '')), lower(x)))) > 0, false)::INT AS hit FROM nam WHERE q = 1),
      a AS (SELECT sum(hit)::BIGINT AS correct, count(*) AS total, count_if(gone)::BIGINT AS missing_predictions, sum(hit) / count(*) AS e FROM ok),
      c AS (SELECT sum(CASE WHEN lang = 'de' THEN 0.0 WHEN lang = 'en' THEN 0.75 ELSE 0.5 END)::DOUBLE / count(*) AS comet FROM rec WHERE q = 1)
      SELECT correct, total, missing_predictions, round(e, 6) AS m_eta, round(100 * e, 6) AS m_eta_percent, round(comet, 6) AS comet, round(100 * comet, 6) AS comet_percent,
        round(CASE WHEN e <= 0 OR comet <= 0 THEN 0.0 ELSE 2 * e * comet / (e + comet) END, 6) AS final_score, round(100 * CASE WHEN e <= 0 OR comet <= 0 THEN 0.0 ELSE 2 * e * comet / (e + comet) END, 6) AS final_score_percent FROM a, c""",
    "mention_sets": f"WITH {NAMES} SELECT id, array_to_string(m, '|') AS mentions FROM nam",
    "ordered_distinct": """WITH t AS (SELECT l_orderkey, list(p_type ORDER BY l_linenumber, l_partkey) AS ty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
      SELECT l_orderkey, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(ty, lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ',') AS types FROM t""",
    "kb_build": f"""SELECT 'P' || p_partkey AS qid, p_name AS label_en, p_brand AS aliases_en, CASE WHEN p_size >= 10 THEN p_name END AS target_label, p_brand AS entity_type, p_type AS description,
      p_size >= 10 AS language_available, greatest(p_retailprice, 0.0) AS popularity, {norm('p_name')} || CASE WHEN {norm('p_brand')} = {norm('p_name')} THEN '' ELSE '|' || {norm('p_brand')} END AS surfaces FROM part""",
    "upsert_antijoin": "SELECT DISTINCT user_id, event_type FROM events ANTI JOIN (SELECT c_custkey AS user_id, 'click' AS event_type FROM customer) c USING (user_id, event_type)",
    "custom_term_order": "SELECT 'P' || p_partkey AS qid, p_name || '|' || p_brand AS terms FROM part",
    "explode_entities": """SELECT l_orderkey || '::' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) AS example_id, 'P' || l_partkey AS gold_qid FROM lineitem""",
    "event_keys": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total FROM (SELECT event_type, (props::JSON ->> 'k')::BIGINT AS k FROM events) GROUP BY event_type",
    "filtered_orders": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'",
    "nation_regions": "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) ON n_nationkey = c_nationkey",
}
