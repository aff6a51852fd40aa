"""The registered queries as SQL for DuckDB over the same tables, written from the queries' definitions."""

from __future__ import annotations

DOCS = "docs AS (SELECT read_id AS doc_id, max(text) AS text FROM reads WHERE text IS NOT NULL GROUP BY read_id)"
EVID = "ev AS (SELECT doc_id, id, e.* FROM (SELECT doc_id, id, max(struct_pack(extracted_at := extracted_at, claim := claim, kind := kind, excerpt := excerpt, source_location := source_location, confidence := confidence, feed_id := feed_id)) AS e FROM evidence GROUP BY doc_id, id))"
PAPERS = "pa AS (SELECT doc_id, arg_max(struct_pack(title := title, authors := authors, \"year\" := \"year\", source_url := source_url, abstract := abstract), added_at) AS p FROM papers GROUP BY doc_id), pp AS (SELECT doc_id, p.title AS title, p.authors AS authors, p.\"year\" AS \"year\", p.source_url AS source_url, p.abstract AS abstract FROM pa)"
STOP = r"(?i)^\s*(?:\d+(?:\.\d+)*[\s.)-]+)?(?:references|bibliography|works cited|acknowledg(?:e)?ments|funding|author contributions|data availability|conflict of interest|supplement(?:ary|al)(?: material)?|appendix|appendices)\s*:?[\s.]*$"
PAGE = r"(?i)^(?:page\s+)?\d+(?:\s*(?:of|/|-)\s*\d+)?$"
NOTICE = r"(?i)^(?:downloaded from|this content is|all rights reserved|copyright\s|©|licensed under|published by|available at\s+https?://)"
SECTION = r"(?i)^\s*(?:\d+(?:\.\d+)*[\s.)-]+)?(abstract|introduction|background|related work|literature review|method|methods|methodology|approach|materials and methods|experiments?|evaluation|results?|findings?|discussion|conclusion|limitations?)\s*:?[\s.]*$"
CUES = "propose|present|introduce|develop|design|use|apply|adopt|employ"


BLANKS = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sq(x: str) -> str:
    """White space squeezed."""
    return rf"trim(regexp_replace({x}, '{BLANKS}+', ' ', 'g'))"


def lines(x: str) -> str:
    """The lines of a text, whatever ends them."""
    return rf"string_split_regex({x}, '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"


def low(x: str) -> str:
    return f"lower(replace(replace(replace(replace({x}, 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'))"


def compact(x: str, n: int) -> str:
    return rf"(CASE WHEN length({sq(x)}) <= {n} THEN {sq(x)} ELSE regexp_replace(regexp_replace(substr({sq(x)}, 1, {n - 1}), ' [^ ]*$', ''), '[ ,;:]+$', '') || '…' END)"


def parts(x: str) -> str:
    """Sentences of a squeezed line."""
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 0)"


def score(cues: str) -> str:
    return " + ".join(rf"CAST(regexp_matches(lo, '\b{c}\w*\b') AS INT)" for c in cues.split("|"))


PAGES = """pages AS (SELECT read_id AS doc_id, p.page_no AS page_no, string_agg(p.text, chr(10) ORDER BY p.idx, id) AS text FROM
 (SELECT read_id, id, max(struct_pack(page_no := coalesce(page_number, 0), idx := "index", text := text)) AS p FROM paragraphs GROUP BY read_id, id) GROUP BY read_id, p.page_no)"""
BODY = f"""{PAGES}, raw AS (SELECT doc_id, page_no, unnest({lines('text')}) AS l, generate_subscripts({lines('text')}, 1) AS k FROM pages),
 clean AS (SELECT doc_id, page_no, k, {sq('l')} AS line FROM raw),
 placed AS (SELECT doc_id, page_no, line, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY doc_id, page_no) - row_number() OVER w AS rest,
   trim(regexp_replace({low('line')}, '\\b\\d+\\b', '#', 'g')) AS key FROM clean WHERE length(line) > 0 WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY k)),
 again AS (SELECT doc_id, key FROM placed WHERE (pos < 4 OR rest < 4) AND length(key) >= 3 GROUP BY doc_id, key HAVING count(DISTINCT page_no) >= 2),
 stops AS (SELECT doc_id, min(page_no * 1000000 + pos) AS at FROM placed WHERE regexp_matches(line, '{STOP}') GROUP BY doc_id),
 body AS (SELECT doc_id, page_no, pos, line FROM placed p LEFT JOIN stops s USING (doc_id) WHERE (s.at IS NULL OR page_no * 1000000 + pos < s.at)
   AND NOT regexp_matches(line, '{NOTICE}') AND NOT (regexp_matches(line, '{PAGE}') AND (pos < 2 OR rest < 2))
   AND NOT ((pos < 4 OR rest < 4) AND EXISTS (SELECT 1 FROM again a WHERE a.doc_id = p.doc_id AND a.key = p.key)))"""
SENTENCES = f"""{DOCS}, raw AS (SELECT doc_id, unnest({lines('text')}) AS l, generate_subscripts({lines('text')}, 1) AS k FROM docs),
 clean AS (SELECT doc_id, k, regexp_replace({sq('l')}, '^[ \\-]+|[ \\-]+$', '', 'g') AS line FROM raw),
 head AS (SELECT doc_id, k, line, nullif(lower(regexp_extract(line, '{SECTION}', 1)), '') AS h FROM clean WHERE length(line) > 0),
 tagged AS (SELECT doc_id, k, line, h, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING), 'opening') AS section FROM head),
 cut AS (SELECT doc_id, k, section, {parts('line')} AS ss FROM tagged WHERE h IS NULL),
 own AS (SELECT * FROM (SELECT doc_id, k, section, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS n FROM cut) WHERE len(regexp_extract_all(sentence, '[A-Za-z0-9]+')) >= 5),
 alone AS (SELECT doc_id, 0 AS k, 'opening' AS section, unnest({parts(sq('text'))}) AS sentence, generate_subscripts({parts(sq('text'))}, 1) AS n FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM own)),
 sents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, n) - 1 AS INT) AS idx, sentence, section FROM (SELECT * FROM own UNION ALL SELECT * FROM alone))"""
ROLES = {
    "thesis": ("propose|present|introduce|develop|investigate|aim|show|demonstrate", "abstract|introduction|conclusion|discussion"),
    "method": (CUES, "method|approach|experiment|evaluation"),
    "finding": ("show|find|demonstrat|achiev|improv|outperform|increase|decrease|reduce|result", "result|finding|discussion|conclusion|abstract"),
    "experiment": ("evaluat|experiment|benchmark|dataset|corpus|participants|test|trained on|measured on", "experiment|evaluation|method"),
    "metric": ("accuracy|precision|recall|f1|auc|bleu|rouge|score|error|loss|latency|runtime|reduction|improvement|significant", "result|finding|evaluation|experiment"),
}


def best(role: str) -> str:
    cues, sections = ROLES[role]
    fits = f"length(sentence) >= 25 AND ({score(cues)}) > 0"
    total = f"({score(cues)} + CASE WHEN regexp_matches(section, '{sections}') THEN 2 ELSE 0 END)"
    return f"arg_max({compact('sentence', 280)}, CASE WHEN {fits} THEN {total} * 1000000 - idx END) FILTER (WHERE {fits}) AS {role}"


RUNS = "latest AS (SELECT run_id, r.created_at AS created_at, r.response_json AS response_json FROM (SELECT run_id, max(struct_pack(created_at := created_at, response_json := response_json)) AS r FROM analysis_runs WHERE run_id IS NOT NULL GROUP BY run_id))"
STAGE_LIST = "['queued', 'validate_input', 'ingest_document', 'extract_structure', 'validate_output', 'explain_concepts', 'summarise_paper', 'compare_papers', 'complete']"
STATUS = "CASE node WHEN 'complete' THEN 'completed' WHEN 'queued' THEN 'queued' ELSE 'running' END"
STAGES = f"stages AS (SELECT run_id, CAST(seq - 1 AS INT) AS seq, node, {STATUS} AS status FROM (SELECT run_id, unnest({STAGE_LIST}) AS node, generate_subscripts({STAGE_LIST}, 1) AS seq FROM (SELECT DISTINCT run_id FROM analysis_runs)))"
STOPWORDS = "['about','after','against','also','been','being','between','from','have','into','more','most','only','over','paper','propose','proposed','research','shows','that','their','there','these','they','this','using','with','which','will']"


def terms(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({low(x)}, '[a-z][a-z0-9-]{{3,}}')), lambda t: NOT list_contains({STOPWORDS}, t))"


def relationship(x: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({low(x)}, '\b(?:contradict|challenge|disagree|fails? to|cannot|worse than)\b') THEN 'contradicts' "
        rf"WHEN regexp_matches({low(x)}, '\b(?:extend|extends|build(?:s)? on|adapt(?:s)?|improve(?:s)? on)\b') THEN 'extends' "
        rf"WHEN regexp_matches({low(x)}, '\b(?:support(?:s)?|confirm(?:s)?|consistent with|agree(?:s)? with)\b') THEN 'supports' ELSE 'similar' END"
    )


def matchable(x: str) -> str:
    return sq(f"replace({low(x)}, '…', '')")


#: The object in a response, whatever envelope it is in; null if it can't be read.
JSON_RUNS = f"""{RUNS}, t0 AS (SELECT run_id, trim(ltrim(trim(response_json), chr(65279))) AS t FROM latest WHERE response_json IS NOT NULL),
 t1 AS (SELECT run_id, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN t ->> '$' ELSE t END END AS t FROM t0),
 t2 AS (SELECT run_id, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN CASE WHEN json_type(t, '$.response') = 'OBJECT' THEN t -> '$.response' ELSE CAST(t AS JSON) END END AS o FROM t1 WHERE t IS NOT NULL),
 runs AS (SELECT run_id, o FROM t2 WHERE o IS NOT NULL)"""


def elements(of: str, keep: str, source: str, path: str) -> str:
    """The elements of a list at a path, with their positions; what stands alone is the only one."""
    value = f"json_extract({of}, '{path}')"
    array = f"CASE WHEN {value} IS NULL OR json_type({value}) = 'NULL' THEN CAST([] AS JSON[]) WHEN json_type({value}) = 'ARRAY' THEN CAST({value} AS JSON[]) ELSE [{value}] END"
    return f"(SELECT * FROM (SELECT {keep}, unnest({array}) AS x, generate_subscripts({array}, 1) - 1 AS n FROM {source}) WHERE x IS NOT NULL AND json_type(x) <> 'NULL')"


CONCEPTS = f"""{JSON_RUNS}, cs AS {elements('o', 'run_id', 'runs', '$.concepts')}, es AS {elements('o', 'run_id', 'runs', '$.evidence')},
 c AS (SELECT run_id AS doc_id, x ->> '$.id' AS id, x ->> '$.label' AS label, x ->> '$.kind' AS kind, CAST(x ->> '$.confidence' AS DOUBLE) AS confidence, x, n FROM cs),
 e AS (SELECT run_id AS doc_id, x ->> '$.id' AS id, x ->> '$.kind' AS kind, x ->> '$.excerpt' AS excerpt, x ->> '$.source_location' AS source_location, CAST(x ->> '$.confidence' AS DOUBLE) AS confidence FROM es),
 ce0 AS {elements('x0', 'doc_id, id', '(SELECT doc_id, id, x AS x0 FROM c)', '$.evidence_ids')},
 ce AS (SELECT doc_id, id AS concept_id, x ->> '$' AS evidence_id, n FROM ce0),
 li AS (SELECT ce.doc_id, concept_id, evidence_id, e.id IS NOT NULL AS there, e.kind AS evidence_kind, e.confidence AS ec, e.source_location AS el FROM ce LEFT JOIN e ON e.doc_id = ce.doc_id AND e.id = ce.evidence_id)"""

P5 = f"""WITH {JSON_RUNS}, cs AS {elements('o', 'run_id', 'runs', '$.concepts')}, es AS {elements('o', 'run_id', 'runs', '$.evidence')},
 xs AS {elements('o', 'run_id', 'runs', '$.concept_explanations')}, rs AS {elements('o', 'run_id', 'runs', '$.relationships')},
 ws AS {elements('o', 'run_id', 'runs', '$.warnings')}, ts AS {elements('o', 'run_id', 'runs', '$.trace')},
 ce AS {elements('x0', 'run_id, p', "(SELECT run_id, x AS x0, x ->> '$.id' AS p FROM cs)", '$.evidence_ids')},
 cu AS {elements('x0', 'run_id, p', "(SELECT run_id, x AS x0, x ->> '$.id' AS p FROM cs)", '$.source_urls')},
 xe AS {elements('x0', 'run_id, p', "(SELECT run_id, x AS x0, x ->> '$.concept_id' AS p FROM xs)", '$.supporting_evidence')},
 xl AS {elements('x0', 'run_id, p', "(SELECT run_id, x AS x0, x ->> '$.concept_id' AS p FROM xs)", '$.reliability.limitations')},
 rp AS {elements('x0', 'run_id, p', "(SELECT run_id, x AS x0, CAST(n AS VARCHAR) AS p FROM rs)", '$.paper_ids')}
 SELECT DISTINCT run_id, entity, parent_id, item_id FROM (
  SELECT run_id, 'concepts' AS entity, run_id AS parent_id, x ->> '$.id' AS item_id FROM cs UNION ALL SELECT run_id, 'evidence', run_id, x ->> '$.id' FROM es
  UNION ALL SELECT run_id, 'explanations', run_id, x ->> '$.concept_id' FROM xs UNION ALL SELECT run_id, 'relationships', run_id, CAST(n AS VARCHAR) FROM rs
  UNION ALL SELECT run_id, 'warnings', run_id, CAST(n AS VARCHAR) FROM ws UNION ALL SELECT run_id, 'trace', run_id, CAST(n AS VARCHAR) FROM ts
  UNION ALL SELECT run_id, 'concept_evidence', p, x ->> '$' FROM ce UNION ALL SELECT run_id, 'concept_urls', p, CAST(n AS VARCHAR) FROM cu
  UNION ALL SELECT run_id, 'explanation_evidence', p, CASE WHEN json_type(x) = 'OBJECT' THEN x ->> '$.evidence_id' ELSE x ->> '$' END FROM xe
  UNION ALL SELECT run_id, 'explanation_limitations', p, CAST(n AS VARCHAR) FROM xl UNION ALL SELECT run_id, 'relationship_papers', p, x ->> '$' FROM rp)"""

PHRASE = rf"regexp_replace({compact(chr(123) + 'x' + chr(125), 64)}, '^[ .,]+|[ .,]+$', '', 'g')"


def phrase(sentence: str) -> str:
    inner = rf"regexp_replace(regexp_extract({sentence}, '(?i)\b(?:{CUES})\w*\b\s+(?:(?:a|an|the|our|this|their)\b)?\s*([^.;,:]+)', 1), '(?i)\s+(?:to|for|on|across|from|that|which|while|using|with|and|compared|versus|against|relative)\s+.*$', '')"
    return rf"regexp_replace({compact(inner, 64)}, '^[ .,]+|[ .,]+$', '', 'g')"


METRIC = r"(?i)\b(?:accuracy|precision|recall|F1(?:-score)?|AUC|BLEU|ROUGE|score|error|loss|latency|runtime|reduction|improvement)\b"
NUMBER = r"[+-]?\d+(?:\.\d+)?\s*(?:%|percent|percentage points)?"
HOST = r"lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))"
DOMAINS = "acm.org annualreviews.org aps.org arxiv.org britannica.com cambridge.org cern.ch doi.org ieee.org jstor.org nature.com ncbi.nlm.nih.gov nih.gov nasa.gov oup.com plos.org royalsocietypublishing.org science.org sciencedirect.com sciencemag.org springer.com wiley.com".split()
AUTHORITY = f"(regexp_matches({HOST}, '\\.(edu|gov|ac\\.uk)$') OR " + " OR ".join(f"{HOST} = '{d}' OR ends_with({HOST}, '.{d}')" for d in DOMAINS) + ")"

def label(sentence: str, cues: str, default: str) -> str:
    ph = phrase(sentence).replace(CUES, cues)
    words = f"string_split({sq(sentence)}, ' ')"
    first = compact(f"array_to_string({words}[1:8], ' ')", 58)
    return rf"""CASE WHEN length({ph}) >= 4 THEN upper(substr({ph}, 1, 1)) || substr({ph}, 2) WHEN len({words}) > 8 THEN regexp_replace({first}, '[.,]+$', '') || '…'
      ELSE coalesce(nullif(regexp_replace({sentence}, '\.+$', ''), ''), '{default}') END"""


def subject(sentence: str) -> str:
    raw = rf"regexp_replace(regexp_extract({sentence}, '(?i)\b(?:on|using|across|with)\s+(?:the\s+)?([^.;,:]+)', 1), '(?i)\s+(?:to|for|that|which|and|compared|versus|against)\s+.*$', '')"
    sub = rf"regexp_replace({compact(raw, 58)}, '^[ .,]+|[ .,]+$', '', 'g')"
    return f"CASE WHEN length({sub}) >= 4 THEN upper(substr({sub}, 1, 1)) || substr({sub}, 2) ELSE {label(sentence, 'evaluate|experiment|benchmark|test|measure', 'Evaluation described in the paper')} END"


def measure(sentence: str) -> str:
    word = f"nullif(regexp_extract({sentence}, '{METRIC}', 0), '')"
    number = f"nullif(trim(regexp_extract({sentence}, '{NUMBER}', 0)), '')"
    return f"coalesce({word} || ' (' || {number} || ')', {word}, {label(sentence, 'report|measure|achieve|improv|reduce', 'Result reported by the paper')})"


ROLES["approach"] = ("method|architecture|model|framework|approach", ROLES["method"][1])
BEST = f"""{SENTENCES}, l AS (SELECT *, {low('sentence')} AS lo FROM sents), b AS (SELECT doc_id, {', '.join(best(r) for r in ROLES)},
      arg_min(CASE WHEN length(sentence) >= 35 THEN {compact('sentence', 280)} ELSE sentence END, CASE WHEN length(sentence) >= 35 THEN 0 ELSE 1000000 END + idx) AS opening FROM l GROUP BY doc_id)"""
TITLE = rf"coalesce(list_filter(list_transform({lines('text')}, lambda x: regexp_replace(x, '^[ #\t]+|[ #\t]+$', '', 'g')), lambda x: length(x) BETWEEN 4 AND 140)[1], 'Imported research paper')"
#: One row a document: title, and the sentence of each role after its fallbacks.
WIDE = f"""{BEST}, w AS (SELECT d.doc_id, {TITLE} AS title, coalesce(thesis, opening) AS t, coalesce(method, approach) AS m, coalesce(finding, thesis, opening) AS f,
      coalesce(experiment, method, approach) AS e, coalesce(metric, finding, thesis, opening) AS r FROM docs d LEFT JOIN b USING (doc_id)),
      k AS (SELECT doc_id, title, m, f, e, r, coalesce(t, 'The paper studies ' || title || '.') AS thesis,
       CASE WHEN m IS NULL THEN 'Method described in the paper' ELSE {label('m', CUES, 'Method described in the paper')} END AS ml,
       CASE WHEN f IS NULL THEN 'Finding reported by the paper' ELSE {label('f', ROLES['finding'][0], 'Finding reported by the paper')} END AS fl,
       CASE WHEN e IS NULL THEN 'Evaluation described in the paper' ELSE {subject('e')} END AS el,
       CASE WHEN r IS NULL THEN 'Result reported by the paper' ELSE {measure('r')} END AS rl FROM w)"""
MISSING = "'The paper does not expose a clear {} in the extracted text.'"

ONE_BREAK = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
WORD, TAB, NL, BACK = r"\p{L}\p{N}_", r"\t", r"\n", "\\"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


SQL: dict[str, str] = {
    "t9_paragraphs": rf"""WITH {DOCS}, p AS (SELECT doc_id, string_split_regex({ONE_BREAK}, '\n[ \t]*\n+') AS ps, regexp_extract_all({ONE_BREAK}, '\n[ \t]*\n+') AS gs FROM docs),
      x AS (SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS k, ps, gs FROM p),
      y AS (SELECT doc_id, k, part, coalesce(list_sum(list_transform(ps[1:k - 1], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(gs[1:k - 1], lambda z: length(z))), 0) AS start_char,
       {strip(f"regexp_replace(regexp_replace(part, '([{WORD}])-[ {TAB}]*{NL}[ {TAB}]*([{WORD}])', '{BACK}1{BACK}2', 'g'), '[ {TAB}{NL}]+', ' ', 'g')")} AS text FROM x),
      z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM y WHERE length(text) > 0)
      SELECT doc_id, 'paragraph-' || printf('%04d', n) AS id, CAST(n AS INT) AS "index", text, CAST(start_char AS INT) AS start_char, CAST(start_char + length(part) AS INT) AS end_char FROM z""",
    "t10_chunks": f"""WITH RECURSIVE {DOCS}, n AS (SELECT doc_id, text, length(text) AS len FROM docs WHERE length(trim(text)) > 0),
      cuts AS (SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS a, CASE WHEN len <= 4000 THEN len ELSE {{0}} END AS b, len FROM n
       UNION ALL SELECT c.doc_id, k + 1, greatest(b - 350, a + 1), CASE WHEN greatest(b - 350, a + 1) + 4000 >= c.len THEN c.len ELSE greatest(b - 350, a + 1) + {{1}} END, c.len FROM cuts c JOIN n USING (doc_id) WHERE b < c.len)
      SELECT doc_id, 'chunk-' || printf('%03d', k) AS id, CAST(k AS INT) AS "index", CAST(a AS INT) AS start_char, CAST(b AS INT) AS end_char,
       CAST(CASE WHEN len <= 4000 THEN len ELSE length({strip("substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))")}) END AS INT) AS n_chars FROM cuts JOIN n USING (doc_id, len)""",
    "ox1_concepts": f"""WITH {WIDE} SELECT doc_id, 0 AS pos, 'thesis' AS id, substr(title, 1, 72) AS label, thesis AS description, 0.84::DOUBLE AS confidence FROM k
      UNION ALL SELECT doc_id, 1, 'method', ml, coalesce(m, {MISSING.format('method section')}), 0.80::DOUBLE FROM k UNION ALL SELECT doc_id, 2, 'finding', fl, coalesce(f, {MISSING.format('findings section')}), 0.78::DOUBLE FROM k
      UNION ALL SELECT doc_id, 3, 'experiment', el, coalesce(e, {MISSING.format('evaluation description')}), 0.76::DOUBLE FROM k UNION ALL SELECT doc_id, 4, 'metric', rl, coalesce(r, {MISSING.format('measurable result')}), 0.73::DOUBLE FROM k""",
    "os1_summaries": f"WITH {WIDE} SELECT doc_id, thesis || ' The strongest next check is the evidence behind ' || lower(fl) || '.' AS summary FROM k",
    "ov2_violations": f"""WITH {CONCEPTS}, texts AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(excerpt))), ' ') AS text FROM e GROUP BY doc_id),
      lo AS (SELECT doc_id, id, {matchable('excerpt')} AS w, {matchable('text')} AS s FROM e JOIN texts USING (doc_id)),
      v AS (SELECT doc_id, 1 AS rule, id AS detail FROM e GROUP BY doc_id, id HAVING count(*) > 1 UNION ALL SELECT doc_id, 2, evidence_id FROM li WHERE NOT there
       UNION ALL SELECT doc_id, 3, id FROM c WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.doc_id = c.doc_id AND ce.concept_id = c.id)
       UNION ALL SELECT doc_id, 4, id FROM lo WHERE NOT coalesce(length(w) > 0 AND contains(s, w), false)),
      f AS (SELECT doc_id, min(struct_pack(rule := rule, detail := detail)) AS v FROM v GROUP BY doc_id) SELECT doc_id, v.rule AS rule, v.detail AS detail FROM f""",
    "g1_nodes": f"""WITH {CONCEPTS}, nd AS (SELECT DISTINCT doc_id, id, kind FROM c) SELECT doc_id, id AS node_id, kind, CAST(220 * CASE kind WHEN 'method' THEN 1 WHEN 'finding' THEN 2 WHEN 'experiment' THEN 3 WHEN 'metric' THEN 4 WHEN 'concept' THEN 5 ELSE 0 END AS INT) AS x,
      CAST(120 * (row_number() OVER (PARTITION BY doc_id, kind ORDER BY id) - 1) AS INT) AS y FROM nd""",
    "t1_body_lines": f"WITH {BODY} SELECT doc_id, page_no, CAST(pos AS INT) AS pos, line FROM body",
    "t1_body_text": f"""WITH {BODY}, step AS (SELECT *, ends_with(line, '-') AND coalesce(regexp_matches(lead(line) OVER (PARTITION BY doc_id ORDER BY page_no, pos), '^[a-z]'), false) AS on FROM body)
      SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM (SELECT doc_id, trim(regexp_replace(string_agg(CASE WHEN "on" THEN regexp_replace(line, '-$', '') ELSE line || chr(10) END, '' ORDER BY page_no, pos), '\\n+$', '')) AS text FROM step GROUP BY doc_id)""".replace("AS on FROM", 'AS "on" FROM'),
    "t3_edge_keys": f"""WITH {DOCS}, l AS (SELECT {sq('line')} AS line FROM (SELECT unnest({lines('text')}) AS line FROM docs))
      SELECT trim(regexp_replace({low('line')}, '\\b\\d+\\b', '#', 'g')) AS key, count(*) AS n FROM l WHERE length(line) > 0 GROUP BY 1""",
    "t4_t8_flags": f"""WITH {DOCS} SELECT doc_id, length(trim(text)) >= 240 OR length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 120 AS meaningful,
      regexp_matches({low('text')}, 'a required part of this site couldn|a required part of this site could not load|this may be due to a browser|enable javascript to continue|please enable javascript|access denied|verify you are human|checking your browser|cf-chl-') AS browser_error,
      CAST(len(list_filter({lines('text')}, lambda x: regexp_matches(x, '{STOP}'))) AS INT) AS stop_headings, CAST(len(list_filter({lines('text')}, lambda x: regexp_matches(x, '{PAGE}'))) AS INT) AS page_numbers,
      CAST(len(list_filter({lines('text')}, lambda x: regexp_matches(x, '{NOTICE}'))) AS INT) AS notices FROM docs""",
    "t11_compact": f"WITH {EVID} SELECT doc_id, id, {compact('excerpt', 60)} AS short FROM ev WHERE excerpt IS NOT NULL",
    "t13_sentences": f"WITH {SENTENCES} SELECT doc_id, idx, sentence, section FROM sents",
    "t14_t15_titles": rf"""WITH {DOCS} SELECT doc_id, coalesce(list_filter(list_transform({lines('text')}, lambda x: regexp_replace(x, '^[ #\t]+|[ #\t]+$', '', 'g')), lambda x: length(x) BETWEEN 4 AND 140)[1], 'Imported research paper') AS title,
      CAST(nullif(regexp_extract(text, '\b(?:19|20)\d{{2}}\b', 0), '') AS INT) AS "year" FROM docs""",
    "t16_search": f"""WITH {DOCS}, f AS (SELECT doc_id, text, unnest(['mixed-effects model', 'mixed-effects', 'model']) AS term, unnest([1, 2, 3]) AS k FROM docs),
      x AS (SELECT doc_id, k, {sq('substr(text, greatest(pos - 121, 0) + 1, pos + 239 - greatest(pos - 121, 0))')} AS excerpt FROM (SELECT *, instr(lower(text), term) AS pos FROM f) WHERE pos > 0),
      d AS (SELECT doc_id, excerpt, min(k) AS k FROM x WHERE length(excerpt) > 0 GROUP BY doc_id, excerpt)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS n, excerpt FROM d QUALIFY n < 3""",
    "t17_t20_labels": rf"""WITH {EVID}, b AS (SELECT doc_id, id, excerpt, {phrase('excerpt')} AS ph, nullif(regexp_extract(excerpt, '{METRIC}', 0), '') AS w, nullif(trim(regexp_extract(excerpt, '{NUMBER}', 0)), '') AS num,
      regexp_replace({compact(r"regexp_replace(regexp_extract(excerpt, '(?i)\b(?:on|using|across|with)\s+(?:the\s+)?([^.;,:]+)', 1), '(?i)\s+(?:to|for|that|which|and|compared|versus|against)\s+.*$', '')", 58)}, '^[ .,]+|[ .,]+$', '', 'g') AS sub,
      {phrase('excerpt').replace(CUES, 'evaluate|experiment|benchmark|test|measure')} AS ph2, string_split({sq('excerpt')}, ' ') AS ws FROM ev WHERE excerpt IS NOT NULL)
      SELECT doc_id, id, CASE WHEN length(ph) >= 4 THEN ph END AS phrase, coalesce(w || ' (' || num || ')', w) AS metric,
      CASE WHEN length(sub) >= 4 THEN upper(substr(sub, 1, 1)) || substr(sub, 2) WHEN length(ph2) >= 4 THEN upper(substr(ph2, 1, 1)) || substr(ph2, 2)
       WHEN len(ws) > 8 THEN regexp_replace({compact("array_to_string(ws[1:8], ' ')", 58)}, '[.,]+$', '') || '…' ELSE coalesce(nullif(regexp_replace(excerpt, '\.+$', ''), ''), 'Evaluation described in the paper') END AS experiment FROM b""",
    "t23_terms": f"WITH {PAPERS}, t AS (SELECT doc_id, unnest({terms('abstract')}) AS term FROM pp WHERE abstract IS NOT NULL) SELECT term, count(*) AS n_docs FROM t GROUP BY term",
    "t24_relationship": f"WITH {EVID} SELECT {relationship('excerpt')} AS relationship_type, count(*) AS n FROM ev WHERE excerpt IS NOT NULL GROUP BY 1",
    "t26_anchored": f"""WITH {EVID}, {PAPERS}, j AS (SELECT ev.doc_id, {matchable('excerpt')} AS w, {matchable("concat_ws(chr(10), title, abstract)")} AS s FROM ev JOIN pp USING (doc_id)),
      k AS (SELECT *, trim(regexp_replace(substr(w, 1, 180), ' [^ ]*$', '')) AS pre FROM j)
      SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(w) > 0 AND (contains(s, w) OR (length(pre) >= 40 AND contains(s, pre)))) AS n_anchored FROM k GROUP BY doc_id""",
    "t27_t33_addresses": f"""WITH {PAPERS} SELECT doc_id, coalesce(regexp_matches(source_url, '^https?://[^/?#]+'), false) AS web,
      CASE WHEN regexp_matches(coalesce(source_url, ''), '(?i)^https?://') THEN 'url' ELSE 'text' END AS source_type, coalesce({AUTHORITY}, false) AS authority FROM pp""",
    "t29_terms": rf"""WITH {PAPERS}, t AS (SELECT doc_id, unnest(string_split(title, ',')) AS part FROM pp WHERE title IS NOT NULL)
      SELECT DISTINCT doc_id, regexp_replace(regexp_replace(regexp_replace(part, '\s+', ' ', 'g'), '^[ \t\r\n,.;:()\[\]{{}}]+|[ \t\r\n,.;:()\[\]{{}}]+$', '', 'g'), '(?i)^(?:the|a|an)\s+', '') AS term FROM t""",
    "w1_best": f"""WITH {SENTENCES}, l AS (SELECT *, {low('sentence')} AS lo FROM sents) SELECT doc_id, {', '.join(best(r) for r in ROLES if r != "approach")},
      arg_min(CASE WHEN length(sentence) >= 35 THEN {compact('sentence', 280)} ELSE sentence END, CASE WHEN length(sentence) >= 35 THEN 0 ELSE 1000000 END + idx) AS opening FROM l GROUP BY doc_id""",
    "j1_links": f"WITH {CONCEPTS} SELECT doc_id, concept_id, evidence_id, there, evidence_kind FROM li",
    "j2_dangling": f"WITH {CONCEPTS} SELECT doc_id, concept_id, evidence_id FROM li WHERE NOT there",
    "oe1_explanations": f"""WITH {CONCEPTS}, g AS (SELECT doc_id, concept_id, count(*) AS n, min(ec) AS least, bool_or(evidence_kind IN ('statistic', 'experiment', 'dataset')) AS d, bool_or(evidence_kind NOT IN ('statistic', 'experiment', 'dataset')) AS o FROM li WHERE there GROUP BY 1, 2),
      s AS (SELECT c.doc_id, c.id AS concept_id, coalesce(g.n, 0) AS n, CASE WHEN g.n IS NULL THEN 'unsupported' WHEN d AND o THEN 'partial' WHEN d THEN 'direct' ELSE 'contextual' END AS support_status, CASE WHEN g.n IS NULL THEN 0.0 ELSE least(c.confidence, g.least) END AS score FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.concept_id = c.id)
      SELECT doc_id, concept_id, support_status, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'moderate' ELSE 'low' END AS reliability,
      'The explanation has ' || support_status || ' support from ' || n || ' linked evidence item(s) with a limiting confidence of ' || CAST(round_even(score * 100, 0) AS INT) || '%.' AS rationale FROM s""",
    "a5_quality": f"""WITH {CONCEPTS}, a AS (SELECT c.doc_id, count(*) AS n_concepts, avg(CASE WHEN EXISTS (SELECT 1 FROM ce WHERE ce.doc_id = c.doc_id AND ce.concept_id = c.id) THEN 1.0 ELSE 0.0 END) AS citation_coverage FROM c GROUP BY 1),
      b AS (SELECT doc_id, count(*) AS n_evidence, avg(CASE WHEN length(source_location) > 0 THEN 1.0 ELSE 0.0 END) AS location_coverage FROM e GROUP BY 1)
      SELECT doc_id, coalesce(n_concepts, 0) AS n_concepts, coalesce(n_evidence, 0) AS n_evidence, coalesce(citation_coverage, 0.0) AS citation_coverage, coalesce(location_coverage, 0.0) AS location_coverage FROM a FULL JOIN b USING (doc_id)""",
    "oc1_compare": f"""WITH {PAPERS}, cur AS (SELECT doc_id, concat_ws(' ', title, abstract) AS text FROM pp WHERE abstract IS NOT NULL),
      l AS (SELECT doc_id, {relationship('text')} AS relationship_type, {terms('text')} AS a FROM cur), r AS (SELECT ref_id AS paper_id, {terms('text')} AS b FROM reading_refs),
      lt AS (SELECT doc_id, relationship_type, len(a) AS na, unnest(a) AS term FROM l), rt AS (SELECT paper_id, len(b) AS nb, unnest(b) AS term FROM r),
      p AS (SELECT doc_id, paper_id, relationship_type, na, nb, count(*) AS n, list_sort(list(term)) AS ts FROM lt JOIN rt USING (term) GROUP BY ALL)
      SELECT doc_id, paper_id, relationship_type, CAST(n AS INT) AS n_shared, round(least(0.95::DOUBLE, 0.48::DOUBLE + n::DOUBLE / greatest(1, na + nb - n) * 0.9::DOUBLE + least(n, 4) * 0.04::DOUBLE), 6) AS confidence, array_to_string(ts[1:6], ', ') AS shared FROM p""",
    "g3_cards": f"WITH {PAPERS} SELECT doc_id, title, CASE WHEN len(authors) > 0 THEN array_to_string(authors, ', ') ELSE 'Unknown authors' END AS authors, coalesce(CAST(\"year\" AS VARCHAR), '—') AS \"year\" FROM pp",
    "g2_edges": f"""WITH {CONCEPTS}, nd AS (SELECT DISTINCT doc_id, id, kind FROM c) SELECT a.doc_id, a.id AS source_id, b.id AS target_id,
      CASE b.kind WHEN 'method' THEN 'uses' WHEN 'finding' THEN 'leads to' WHEN 'experiment' THEN 'tested by' WHEN 'metric' THEN 'measured by' WHEN 'concept' THEN 'mentions' END AS relation
      FROM nd a JOIN nd b ON a.doc_id = b.doc_id AND a.kind = 'thesis' AND b.kind IN ('method', 'finding', 'experiment', 'metric', 'concept')""",
    "k1_current": f"WITH {RUNS} SELECT run_id, epoch_us(created_at) AS created_us, md5(coalesce(response_json, '')) AS digest FROM latest",
    "k3_recent": f"WITH {RUNS} SELECT run_id, epoch_us(created_at) AS created_us FROM latest ORDER BY created_at DESC, run_id LIMIT 20",
    "k5_events": f"WITH {STAGES} SELECT 'data: ' || '{{\"run_id\":\"' || run_id || '\",\"node\":\"' || node || '\",\"status\":\"' || status || '\"}}' || chr(10) || chr(10) AS line FROM stages",
    "st1_stages": f"WITH {STAGES} SELECT run_id, seq, node, status FROM stages",
    "st2_states": "SELECT DISTINCT run_id, 'complete' AS node, 'completed' AS status, CAST(9 AS INT) AS n_trace FROM analysis_runs",
    "st_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "p5_found": P5,
}


def _window(a: str) -> str:
    """Where a window from ``a`` is cut: after the last blank line or sentence end of its second half, else at 4000."""
    w = f"substr(text, CAST({a} + 1 AS BIGINT), 4000)"
    blank = f"(CASE WHEN contains({w}, chr(10) || chr(10)) THEN length({w}) - instr(reverse({w}), chr(10) || chr(10)) - 1 ELSE -1 END)"
    stop = f"(CASE WHEN contains({w}, '. ') THEN length({w}) - instr(reverse({w}), ' .') - 1 ELSE -1 END)"
    return f"(CASE WHEN {blank} >= 2000 AND {blank} >= {stop} THEN {blank} WHEN {stop} >= 2000 THEN {stop} + 2 ELSE 4000 END)"


SQL["t10_chunks"] = SQL["t10_chunks"].replace("{0}", _window("0")).replace("{1}", _window("greatest(b - 350, a + 1)"))
