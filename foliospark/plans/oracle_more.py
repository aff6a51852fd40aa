"""SQL of the sources, sinks, entities and map queries; see ``oracle``."""

from __future__ import annotations

from .oracle import BODY, CONCEPTS, DOCS, EVID, JSON_RUNS, NL, ONE_BREAK, PAGES, PAPERS, RUNS, SQL, TAB, BACK, WORD, AUTHORITY, elements, low, relationship, sq, strip

ONE_PAGE = "pages AS (SELECT read_id AS doc_id, 1 AS page_no, max(text) AS text FROM reads WHERE text IS NOT NULL GROUP BY read_id)"


def body_text(pages: str) -> str:
    """CTEs up to ``bt``: doc_id and the text of its body."""
    return f"""{BODY.replace(PAGES, pages)}, step AS (SELECT *, ends_with(line, '-') AND coalesce(regexp_matches(lead(line) OVER (PARTITION BY doc_id ORDER BY page_no, pos), '^[a-z]'), false) AS joins FROM body),
      bt AS (SELECT doc_id, trim(regexp_replace(string_agg(CASE WHEN joins THEN regexp_replace(line, '-$', '') ELSE line || chr(10) END, '' ORDER BY page_no, pos), '\\n+$', '')) AS text FROM step GROUP BY doc_id)"""


def paragraphs(source: str) -> str:
    """CTEs up to ``z``: the paragraphs of ``source`` (doc_id, page_no, text), with k, text, start_char and size of the part."""
    clean = strip(f"regexp_replace(regexp_replace(part, '([{WORD}])-[ {TAB}]*{NL}[ {TAB}]*([{WORD}])', '{BACK}1{BACK}2', 'g'), '[ {TAB}{NL}]+', ' ', 'g')")
    return f"""p AS (SELECT doc_id, page_no, string_split_regex({ONE_BREAK}, '\\n[ \\t]*\\n+') AS ps, regexp_extract_all({ONE_BREAK}, '\\n[ \\t]*\\n+') AS gs FROM {source}),
      x AS (SELECT doc_id, page_no, unnest(ps) AS part, generate_subscripts(ps, 1) AS k, ps, gs FROM p),
      y AS (SELECT doc_id, page_no, k, length(part) AS size, coalesce(list_sum(list_transform(ps[1:k - 1], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(gs[1:k - 1], lambda z: length(z))), 0) AS start_char, {clean} AS text FROM x),
      z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, k) - 1 AS n FROM y WHERE length(text) > 0)"""


MEANINGFUL = "length(trim({0})) >= 240 OR length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')) >= 120"
WORDS = f"{PAPERS}, tw AS (SELECT doc_id, unnest(string_split(title, ' ')) AS term, generate_subscripts(string_split(title, ' '), 1) - 1 AS start_char FROM pp WHERE title IS NOT NULL)"
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(term, '\s+', ' ', 'g'), '^[ \t\r\n,.;:()\[\]{}]+|[ \t\r\n,.;:()\[\]{}]+$', '', 'g'), '(?i)^(?:the|a|an)\s+', '')"
#: Ranked candidates from the words of titles.
RANKED = f"""{WORDS}, m AS (SELECT doc_id, start_char, start_char + length(term) AS end_char, CASE length(term) % 3 WHEN 0 THEN 'ner' WHEN 1 THEN 'noun_phrase' ELSE 'pattern' END AS signal, {CLEAN} AS term FROM tw),
 g AS (SELECT *, lower(term) AS key, CASE signal WHEN 'ner' THEN 0 WHEN 'noun_phrase' THEN 1 ELSE 2 END AS w FROM m WHERE length(term) >= 2 AND regexp_matches(term, '[A-Za-z]') AND lower(term) NOT IN ('abstract', 'article', 'paper', 'study', 'the authors')),
 c AS (SELECT doc_id, key, arg_min(struct_pack(term := term, entity_type := upper(signal), start_char := start_char), struct_pack(w := w, s := start_char, e := end_char)) AS f, count(DISTINCT struct_pack(s := start_char, e := end_char)) AS mentions,
  list_sort(list_distinct(list(signal))) AS signals FROM g GROUP BY doc_id, key),
 rk AS (SELECT doc_id, key, f.term AS term, f.entity_type AS entity_type, f.start_char AS start_char, mentions, signals, row_number() OVER (PARTITION BY doc_id ORDER BY
  CASE WHEN list_contains(signals, 'pattern') THEN 3 ELSE 0 END + CASE WHEN list_contains(signals, 'ner') THEN 2 ELSE 0 END + CASE WHEN list_contains(signals, 'noun_phrase') THEN 1 ELSE 0 END DESC, mentions DESC, f.start_char, key) AS rank FROM c)"""
#: The knowledge base made by rule.
KNOWLEDGE = f"""kw AS (SELECT DISTINCT lower(term) AS term FROM (SELECT {CLEAN} AS term FROM tw) WHERE length(term) >= 4),
 kp AS (SELECT term, rank, CASE rank WHEN 1 THEN 'The ' || term ELSE term END AS title, 'https://en.wikipedia.org/wiki/' || term AS url, 'Q' || (length(term) * 10 + ascii(term) % 7) AS wikidata_id, length(term) % 5 = 0 AND rank = 2 AS dis
  FROM kw, (VALUES (1), (2)) r(rank)),
 ki AS (SELECT DISTINCT wikidata_id, CASE WHEN ends_with(wikidata_id, '1') THEN ['https://doi.org/10/' || wikidata_id] ELSE CAST([] AS VARCHAR[]) END AS refs FROM kp)"""
SPOILED = f"""{CONCEPTS}, sc AS (SELECT doc_id, CASE WHEN kind = 'method' THEN 'experiment' ELSE id END AS id, id AS own, kind, label, confidence FROM c),
 se AS (SELECT sc.doc_id, sc.id AS concept_id, ce.evidence_id FROM sc JOIN ce ON ce.doc_id = sc.doc_id AND ce.concept_id = sc.own WHERE sc.kind <> 'metric' UNION ALL SELECT doc_id, id, 'evidence-none' FROM sc WHERE kind = 'finding')"""
HREFS = "regexp_extract_all(text, 'href=[\"''](https?://[^\"'']+)[\"'']', 1)"

MORE: dict[str, str] = {
    "s1_texts": f"""WITH {body_text(ONE_PAGE)} SELECT p.doc_id, length(substr(coalesce(bt.text, ''), 1, 120000)) AS n_chars, md5(substr(coalesce(bt.text, ''), 1, 120000)) AS digest, 'text' AS format,
      CASE WHEN length(bt.text) > 0 THEN 'read' ELSE 'empty' END AS status FROM pages p LEFT JOIN bt USING (doc_id)""",
    "s4_pdf_reads": f"""WITH {body_text(PAGES)}, layer AS (SELECT doc_id, text FROM bt), docs0 AS (SELECT DISTINCT doc_id FROM pages)
      SELECT d.doc_id, length(t) AS n_chars, md5(t) AS digest, scanned AS ocr_used, CASE WHEN good OR scanned THEN 'read' WHEN length(layer) > 0 THEN 'poor' ELSE 'empty' END AS status FROM (
       SELECT d.doc_id, l.text AS layer, coalesce({MEANINGFUL.format('l.text')}, false) AS good, coalesce(NOT coalesce({MEANINGFUL.format('l.text')}, false) AND length(o.text) > 0, false) AS scanned,
        substr(CASE WHEN coalesce({MEANINGFUL.format('l.text')}, false) THEN l.text WHEN length(o.text) > 0 THEN o.text ELSE coalesce(l.text, '') END, 1, 120000) AS t
       FROM docs0 d LEFT JOIN layer l USING (doc_id) LEFT JOIN (WITH {body_text(PAGES.replace('pages AS (SELECT', 'full_pages AS (SELECT') + ", pages AS (SELECT doc_id, page_no, string_split(text, chr(10))[1] AS text FROM full_pages)")} SELECT doc_id, text FROM bt) o USING (doc_id)) d""",
    "s6_uploads": """SELECT CAST(read_id AS VARCHAR) || CASE format WHEN 'pdf' THEN '.PDF' WHEN 'text' THEN '.md' ELSE '.html' END AS path,
      CASE WHEN format = 'pdf' OR starts_with(max(text), '%PDF') THEN 'pdf' WHEN format = 'text' THEN 'text' ELSE 'rejected' END AS route,
      CASE WHEN format = 'text' AND NOT starts_with(max(text), '%PDF') THEN md5(max(text)) END AS digest FROM reads WHERE text IS NOT NULL GROUP BY read_id, format""",
    "s7_page_paragraphs": f"""WITH {PAGES}, own AS (SELECT doc_id, page_no, {strip('text')} AS text FROM pages), {paragraphs('own')}
      SELECT doc_id, 'paragraph-' || printf('%04d', n) AS id, CAST(page_no AS INT) AS page_number, text, CAST(start_char AS INT) AS start_char, CAST(start_char + size AS INT) AS end_char FROM z""",
    "s8_scans": f"""WITH every AS (SELECT read_id AS doc_id, 1 AS page_no, coalesce(max(text), '') AS text FROM reads GROUP BY read_id), {paragraphs('every')}
      SELECT e.doc_id, CAST(count(z.n) AS INT) AS n_paragraphs, md5(string_agg(z.text, chr(10) || chr(10) ORDER BY z.n)) AS digest, count(z.n) = 0 AS failed FROM every e LEFT JOIN z USING (doc_id) GROUP BY e.doc_id""",
    "s10_run": f"WITH {RUNS} SELECT run_id, md5(coalesce(response_json, '')) AS digest FROM latest WHERE run_id = (SELECT min(run_id) FROM analysis_runs)",
    "k2_upsert": f"WITH {RUNS} SELECT run_id, md5(CASE WHEN length(response_json) > 5000 THEN '{{}}' ELSE coalesce(response_json, '') END) AS digest FROM latest",
    "t21_locations": f"""WITH {EVID}, {PAPERS}, s AS (SELECT ev.doc_id, ev.id, ev.kind, ev.excerpt, string_split(concat_ws(chr(10), title, replace(abstract, '. ', '.' || chr(10))), chr(10)) AS ls FROM ev JOIN pp USING (doc_id) WHERE excerpt IS NOT NULL),
      w AS (SELECT *, string_split({low(sq('excerpt'))}, ' ') AS ws FROM s), n AS (SELECT *, list_position(list_transform(ls, lambda x: contains({low(sq('x'))}, array_to_string(ws[1:8], ' ')) OR contains({low(sq('x'))}, array_to_string(ws[1:4], ' '))), true) AS line FROM w)
      SELECT doc_id, id, upper(substr(kind, 1, 1)) || substr(kind, 2) || ' section' || CASE WHEN line > 0 THEN ', line ' || line ELSE ', filtered paper text' END AS location FROM n""",
    "t22_offsets": f"""WITH {DOCS}, c AS (SELECT DISTINCT read_id, id, start_char, end_char FROM chunks WHERE start_char IS NOT NULL), o AS (SELECT read_id, c.id, start_char, text, greatest(0, least(start_char, length(text))) AS safe FROM c JOIN docs ON doc_id = read_id)
      SELECT read_id, id, CAST(start_char AS INT) AS start_char, 'line ' || len(string_split(substr(text, 1, safe), chr(10))) || ' (character ' || safe || ')' AS location,
      {sq("substr(text, greatest(start_char - 180, 0) + 1, start_char + 260 - greatest(start_char - 180, 0))")} AS excerpt FROM o""",
    "t24_relationship": f"WITH {DOCS} SELECT doc_id, {relationship('text')} AS relationship_type FROM docs",
    "t34_links": f"""WITH {PAPERS}, t AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE text IS NOT NULL
       UNION ALL SELECT doc_id, '<a href="' || replace(source_url, '&', '&amp;') || '">x</a><a href="https://dl.acm.org/?a=1&amp;b=2">' FROM pp WHERE source_url IS NOT NULL),
      u AS (SELECT doc_id, unnest({HREFS}) AS raw, generate_subscripts({HREFS}, 1) AS k FROM t), v AS (SELECT doc_id, k, replace(raw, '&amp;', '&') AS source_url FROM u),
      d AS (SELECT doc_id, source_url, min(k) AS k FROM v WHERE {AUTHORITY} GROUP BY doc_id, source_url) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS n, source_url AS url FROM d QUALIFY n < 3""",
    "c2_phrases": f"""WITH {PAPERS}, pt AS (SELECT doc_id, concat_ws('. ', title, abstract) AS text, unnest(string_split_regex(title, '[:,]')) AS raw, generate_subscripts(string_split_regex(title, '[:,]'), 1) - 1 AS start_char FROM pp WHERE title IS NOT NULL),
      q AS (SELECT doc_id, text, start_char, start_char + length(raw) AS end_char, raw AS term FROM pt), r AS (SELECT doc_id, text, start_char, end_char, {CLEAN} AS term FROM q), s AS (SELECT *, string_split_regex(term, '\\s+') AS ws FROM r)
      SELECT doc_id, term, CAST(start_char AS INT) AS start_char, CAST(end_char AS INT) AS end_char, 'noun_phrase' AS signal FROM s WHERE len(ws) >= 2 AND ((length(lower(text)) - length(replace(lower(text), lower(term), ''))) / length(term) >= 2
       OR len(list_filter(ws, lambda w: length(w) >= 2 AND w = upper(w) AND regexp_matches(w, '\\p{{L}}'))) > 0 OR regexp_matches(term, '[-–]')
       OR len(list_filter(ws, lambda w: lower(w) IN ('algorithm', 'architecture', 'benchmark', 'database', 'dataset', 'effect', 'equation', 'framework', 'hypothesis', 'law', 'method', 'methods', 'model', 'models', 'metric', 'measurement', 'organism', 'paradox', 'phenomenon', 'principle', 'protocol', 'software', 'technology', 'theorem', 'theorems', 'theory', 'theories'))) > 0)""",
    "c4_ranked": f"WITH {RANKED} SELECT doc_id, CAST(rank AS INT) AS rank, term, entity_type, CAST(mentions AS INT) AS mentions, CAST(start_char AS INT) AS start_char, array_to_string(signals, ',') AS signals FROM rk WHERE rank <= 5",
    "j6_types": f"""WITH {WORDS}, {KNOWLEDGE}, cl(last, item_id) AS (VALUES ('1', 'Q8366'), ('1', 'Q999'), ('2', 'Q5'), ('3', 'Q777'), ('4', 'Q65943'), ('5', 'Q778')),
      lb(item_id, label) AS (VALUES ('Q777', 'physical effect'), ('Q778', 'town'), ('Q5', 'human'), ('Q999', 'a theorem of sorts'), ('Q8366', 'algorithm'), ('Q65943', 'theorem')),
      t AS (SELECT wikidata_id, item_id, label FROM ki JOIN cl ON cl.last = right(wikidata_id, 1) JOIN lb USING (item_id) WHERE label NOT IN ('town', 'human')) SELECT wikidata_id, arg_min(label, item_id) AS concept_type FROM t GROUP BY wikidata_id""",
    "j5_named": f"""WITH {RANKED}, {KNOWLEDGE}, hit AS (SELECT * FROM kp WHERE NOT dis QUALIFY row_number() OVER (PARTITION BY term ORDER BY title = term DESC, rank) = 1),
      au AS (SELECT term AS title, ['https://www.nature.com/b', 'https://arxiv.org/a'] AS urls FROM kp WHERE rank = 2 AND length(title) % 2 = 0),
      jo AS (SELECT rk.doc_id, rk.rank, rk.term, rk.signals, hit.wikidata_id, list_filter([hit.url, 'https://www.wikidata.org/wiki/' || hit.wikidata_id] || ki.refs || coalesce(au.urls, []), lambda x: x IS NOT NULL)[1:6] AS src, len(ki.refs) > 0 OR au.urls IS NOT NULL AS strong
       FROM rk JOIN hit ON hit.term = rk.key JOIN ki ON ki.wikidata_id = hit.wikidata_id LEFT JOIN au ON au.title = hit.title WHERE rk.rank <= 24),
      onc AS (SELECT * FROM jo QUALIFY row_number() OVER (PARTITION BY doc_id, wikidata_id ORDER BY rank) = 1), nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS n FROM onc)
      SELECT doc_id, CAST(n AS INT) AS n, term, wikidata_id, 'a word' AS description, array_to_string(src, ' ') AS sources, CASE WHEN strong THEN 'source_supported' ELSE 'classified' END AS recognition_status,
       round(least(0.92::DOUBLE, 0.72::DOUBLE + len(signals) * 0.05::DOUBLE + CASE WHEN strong THEN 0.08::DOUBLE ELSE 0::DOUBLE END), 6) AS confidence FROM nn WHERE n <= 8""",
    "ov1_requests": f"""WITH {PAPERS}, r AS (SELECT doc_id, trim(coalesce(source_url, '')) AS s, length(doc_id) % 2 = 0 AS url FROM pp)
      SELECT doc_id, CASE WHEN bad THEN 'failed' ELSE 'validated' END AS status, bad AS failed FROM (SELECT doc_id, length(s) = 0 OR (url AND NOT regexp_matches(s, '^https?://[^/?#]+')) AS bad FROM r)""",
    "j2_injected": f"WITH {SPOILED} SELECT se.doc_id, concept_id, evidence_id FROM se WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = se.doc_id AND e.id = se.evidence_id)",
    "od1_texts": f"""WITH o AS (SELECT doc_id, read_id AS n, coalesce(nullif({strip('max(text)')}, ''), max(source_url) || chr(10) || chr(10) || 'second') AS t FROM reads WHERE doc_id IS NOT NULL GROUP BY doc_id, read_id)
      SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY n) AS text FROM o WHERE t IS NOT NULL GROUP BY doc_id)""",
    "a8_evidence_count": f"WITH {CONCEPTS} SELECT c.doc_id, count(DISTINCT ce.evidence_id) AS n_evidence_named FROM c LEFT JOIN ce ON ce.doc_id = c.doc_id AND ce.concept_id = c.id GROUP BY c.doc_id",
    "js2_text": f"WITH {EVID} SELECT doc_id, id, nullif(excerpt, '') AS text FROM ev WHERE excerpt IS NOT NULL",
    "js5_forms": f"""WITH {PAPERS}, f AS (SELECT pa.p.feed_id AS feed_id, doc_id, pp.title AS title, pp.abstract AS abstract FROM (SELECT doc_id, arg_max(struct_pack(feed_id := feed_id), added_at) AS p FROM papers GROUP BY doc_id) pa JOIN pp USING (doc_id))
      SELECT feed_id AS request_id, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY doc_id) - 1 AS INT) AS n, doc_id AS id, title, length(abstract) AS n_chars, false AS failed FROM f WHERE feed_id IS NOT NULL
      UNION ALL SELECT 'odd-' || feed_id, 0, NULL, NULL, NULL, true FROM feeds WHERE since_year < 2000""",
    "g4_references": f"""WITH {JSON_RUNS}, cs AS {elements('o', 'run_id', 'runs', '$.concepts')}, u AS {elements('x0', 'run_id, id, own', "(SELECT run_id, x AS x0, (x ->> '$.id') || '#' || n AS id, x ->> '$.wikipedia_url' AS own FROM cs)", '$.source_urls')},
      w AS (SELECT run_id, id, x ->> '$' AS url, n, (own IS NULL OR x ->> '$' <> own) AND NOT contains(x ->> '$', 'wikidata.org/wiki/') AS good FROM u), k AS (SELECT run_id, id, list(url ORDER BY n) FILTER (WHERE good) AS us FROM w GROUP BY run_id, id)
      SELECT run_id, id, coalesce(array_to_string(us[1:3], ' '), '') AS links FROM k""",
    "g5_fallback": f"""WITH {CONCEPTS}, told AS (SELECT DISTINCT doc_id FROM e WHERE kind = 'statistic' AND confidence > 0.8),
      lk AS (SELECT li.doc_id, li.concept_id, li.n, e2.claim, li.evidence_kind, li.el FROM (SELECT ce.doc_id, ce.concept_id, ce.evidence_id, ce.n, e.kind AS evidence_kind, e.source_location AS el FROM ce JOIN e ON e.doc_id = ce.doc_id AND e.id = ce.evidence_id) li
        JOIN (SELECT run_id AS doc_id, x ->> '$.id' AS id, x ->> '$.claim' AS claim FROM es) e2 ON e2.doc_id = li.doc_id AND e2.id = li.evidence_id),
      g AS (SELECT doc_id, concept_id, string_agg(claim, ' ' ORDER BY n) AS claims, bool_or(evidence_kind IN ('statistic', 'experiment', 'dataset')) AS d, bool_or(evidence_kind NOT IN ('statistic', 'experiment', 'dataset')) AS o, bool_and(coalesce(length(el) > 0, false)) AS located FROM lk GROUP BY 1, 2)
      SELECT c.doc_id, c.id AS "conceptId", CASE WHEN g.d IS NULL THEN 'unsupported' WHEN d AND o THEN 'partial' WHEN d THEN 'direct' ELSE 'contextual' END AS "supportStatus", coalesce(g.claims, 'No supporting evidence was extracted for this concept.') AS "paperContext",
       CASE WHEN g.d IS NULL THEN 'No evidence was linked; verify this concept against the paper or cited literature.' WHEN located THEN 'Source locations are recorded for the linked evidence.' ELSE 'One or more linked evidence items lack a precise source location.' END
       || ' This assesses evidence support, not whether the paper''s claim is universally true.' AS limits FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.concept_id = c.id WHERE c.doc_id IN (SELECT doc_id FROM told)
      UNION ALL SELECT doc_id, id, 'unsupported', 'No supporting evidence was extracted for this concept.', 'Verify this concept against the paper or cited literature.' FROM c WHERE doc_id NOT IN (SELECT doc_id FROM told)""",
    "w12_shown": f"""WITH {CONCEPTS}, rs AS {elements('o', 'run_id', 'runs', '$.relationships')}, f AS (SELECT doc_id, arg_min(id, n) AS selected FROM c GROUP BY doc_id),
      r AS (SELECT run_id AS doc_id, arg_min(x ->> '$.explanation', n) AS told FROM rs GROUP BY run_id), g AS (SELECT doc_id, concept_id, bool_and(coalesce(length(el) > 0, false)) AS located FROM li WHERE there GROUP BY 1, 2)
      SELECT f.doc_id, coalesce(selected, 'thesis') AS selected, coalesce(nullif(told, ''), 'No strong overlap found yet. Add another paper to discover a connection.') AS relationship,
      CASE WHEN located IS NULL THEN 'No evidence was linked; verify this concept against the paper or cited literature.' WHEN located THEN 'Source locations are recorded for the linked evidence.' ELSE 'One or more linked evidence items lack a precise source location.' END AS limitation
      FROM f LEFT JOIN r ON r.doc_id = f.doc_id LEFT JOIN g ON g.doc_id = f.doc_id AND g.concept_id = f.selected""",
    "st2_traces": f"""WITH {JSON_RUNS}, ts AS {elements('o', 'run_id', 'runs', '$.trace')} SELECT run_id, 'step ' || max(n) AS node, CAST(count(*) AS INT) AS n_trace, md5(string_agg(x ->> '$', '|' ORDER BY n)) AS digest FROM ts GROUP BY run_id""",
    "g3_cards": f"WITH {PAPERS} SELECT doc_id, title, CASE WHEN len(authors) > 0 THEN array_to_string(authors, ', ') ELSE 'Imported document' END AS authors, coalesce(CAST(\"year\" AS VARCHAR), '—') AS \"year\" FROM pp",
    "g1_nodes": f"""WITH {CONCEPTS}, nd AS (SELECT DISTINCT doc_id, id, kind FROM c), nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS i, row_number() OVER (PARTITION BY doc_id, kind = 'concept' ORDER BY id) - 1 AS k FROM nd)
      SELECT doc_id, id AS node_id, kind, round(CASE id WHEN 'thesis' THEN 500::DOUBLE WHEN 'method' THEN 200 WHEN 'finding' THEN 800 WHEN 'experiment' THEN 250 WHEN 'metric' THEN 750 ELSE CASE WHEN kind = 'concept' THEN 1000 * (0.12::DOUBLE + (k % 4) * 0.25::DOUBLE) ELSE 500 + ((i % 3) - 1) * 100 END END, 4) AS x,
      round(CASE id WHEN 'thesis' THEN 300::DOUBLE WHEN 'method' THEN 138 WHEN 'finding' THEN 138 WHEN 'experiment' THEN 462 WHEN 'metric' THEN 462 ELSE CASE WHEN kind = 'concept' THEN 600 * CASE WHEN k % 2 = 0 THEN 0.08::DOUBLE ELSE 0.92::DOUBLE END ELSE 300 + (i // 3 - 1) * 90 END END, 4) AS y FROM nn""",
}
for _name in ("ov2_violations",):  # the text is the claims now, and rules 0 and 2 are new
    MORE[_name] = f"""WITH {CONCEPTS}, ec AS (SELECT run_id AS doc_id, x ->> '$.id' AS id, x ->> '$.claim' AS claim, x ->> '$.kind' AS kind, CAST(x ->> '$.confidence' AS DOUBLE) AS confidence FROM es),
      texts AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(claim))), ' ') AS text FROM ec GROUP BY doc_id),
      lo AS (SELECT e.doc_id, e.id, {sq(f"replace({low('excerpt')}, '…', '')")} AS w, {sq(f"replace({low('text')}, '…', '')")} AS s FROM e JOIN texts USING (doc_id)),
      pr AS (SELECT *, trim(regexp_replace(substr(w, 1, 180), ' [^ ]*$', '')) AS pre FROM lo),
      v AS (SELECT doc_id, 0 AS rule, coalesce(id, '') AS detail FROM c WHERE NOT coalesce(kind IN ('thesis', 'method', 'finding', 'experiment', 'metric', 'concept'), false) OR NOT coalesce(confidence BETWEEN 0 AND 1, false) OR id IS NULL OR label IS NULL
       UNION ALL SELECT doc_id, 0, coalesce(id, '') FROM ec WHERE NOT coalesce(kind IN ('statistic', 'experiment', 'dataset', 'quote', 'context'), false) OR NOT coalesce(confidence BETWEEN 0 AND 1, false) OR id IS NULL OR claim IS NULL
       UNION ALL SELECT doc_id, 1, id FROM e GROUP BY doc_id, id HAVING count(*) > 1 UNION ALL SELECT doc_id, 2, id FROM c GROUP BY doc_id, id HAVING count(*) > 1 UNION ALL SELECT doc_id, 3, evidence_id FROM li WHERE NOT there
       UNION ALL SELECT doc_id, 4, id FROM c WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.doc_id = c.doc_id AND ce.concept_id = c.id)
       UNION ALL SELECT doc_id, 5, id FROM pr WHERE NOT coalesce(length(w) > 0 AND (contains(s, w) OR (length(pre) >= 40 AND contains(s, pre))), false)),
      f AS (SELECT doc_id, min(struct_pack(rule := rule, detail := detail)) AS v FROM v GROUP BY doc_id) SELECT doc_id, v.rule AS rule, v.detail AS detail FROM f"""

SQL.update(MORE)
