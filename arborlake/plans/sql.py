"""DuckDB SQL of the expressions and tables that the catalogue's queries share."""

from __future__ import annotations

import re

from ..functions import fixed


def quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def cut(x: str, n) -> str:
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE coalesce({', '.join(f'try(decode(encode({x})[1:({n}) - {k}]))' for k in range(4))}) END"


def preview(x: str, n: int) -> str:
    return f"CASE WHEN strlen({x}) > {n} THEN ({cut(x, n)}) || '...' ELSE {x} END"


def any_of(phrases) -> str:
    return "|".join(re.escape(p).replace("\\ ", " ") for p in phrases)


def intent(q: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({q}), '{any_of(p)}') THEN '{k}'" for k, p in fixed.INTENT_PHRASES.items())
    return f"CASE {cases} WHEN regexp_matches(lower({q}), '^(?:{any_of(fixed.FACTUAL_PREFIXES)})') THEN 'factual' ELSE 'specific' END"


def terms(q: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({q}, '[^\p{{L}}\p{{N}}_-]'), lambda w: lower(w)), lambda w: strlen(w) > 2 AND w NOT IN ({quoted(fixed.QUERY_STOP_WORDS)}))"


def fetch_terms(q: str) -> str:
    fallback = f"list_transform(list_slice(list_filter({words(q)}, lambda w: strlen(w) > 3), 1, 3), lambda w: lower(w))"
    return f"list_slice(CASE WHEN len({terms(q)}) > 0 THEN {terms(q)} ELSE {fallback} END, 1, {fixed.TERMS_PER_QUERY})"


def by_intent(kind: str, values: dict) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def heading_level(t: str) -> str:
    n, low = f"strlen({t})", f"lower({t})"
    bare = trim(f"regexp_replace({low}, ':+$', '')")
    number = rf"regexp_replace(regexp_extract({t}, '^\S+'), '\.+$', '')"
    ends = f"regexp_matches({t}, '[.,;]$')"
    count = rf"(len(regexp_split_to_array({t}, '\s+')))"
    keywords = quoted(fixed.SECTION_KEYWORDS)
    return rf"""CASE WHEN {n} = 0 OR {n} > 120 OR ({ends} AND {n} > 40) THEN NULL
        WHEN {low} IN ({keywords}) OR {bare} IN ({keywords}) THEN 2
        WHEN regexp_matches({low}, '^(?:chapter|part) ') THEN 1 WHEN regexp_matches({low}, '^(?:section|appendix) ') THEN 2
        WHEN regexp_matches({number}, '^[0-9]+(?:\.[0-9]+)*$') AND {n} <= 80 THEN least(len({number}) - len(replace({number}, '.', '')) + 1, 4)
        WHEN {n} >= 3 AND {n} <= 80 AND regexp_matches({t}, '^[\p{{Lu}}\s[:punct:]0-9]+$') AND regexp_matches({t}, '\p{{L}}') THEN 2
        WHEN {n} <= 60 AND NOT {ends} AND regexp_matches({t}, '^[\p{{Lu}}0-9]') AND regexp_matches({t}, '\p{{L}}') AND {count} <= 5 THEN 3 END"""


LINES = f"""
raw AS (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS idx FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
trimmed AS (SELECT doc_id, idx, {trim('raw')} AS line FROM raw),
lines AS (SELECT doc_id, idx, line, {heading_level('line')} AS level FROM trimmed)"""

_LEVELS = range(1, 5)
_NEWER = lambda k: " AND ".join([f"{k} < coalesce(level, 5)", *(f"coalesce(l{k} > l{j}, true)" for j in range(1, k))])

NODES = f"""{LINES},
marked AS (SELECT *, sum(CASE WHEN level IS NOT NULL OR line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM lines),
events AS (
  SELECT doc_id, idx, 'section' AS node_type, level, {preview('line', 80)} AS content FROM marked WHERE level IS NOT NULL
  UNION ALL SELECT doc_id, min(idx), 'paragraph', NULL, string_agg(line, chr(10) ORDER BY idx) FROM marked WHERE level IS NULL AND line <> '' GROUP BY doc_id, run),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos FROM events),
lasts AS (SELECT *, {', '.join(f'last_value(CASE WHEN level = {k} THEN pos END IGNORE NULLS) OVER w AS l{k}' for k in _LEVELS)} FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
paths AS (SELECT doc_id, pos, node_type, level, content, list_filter([0, {', '.join(f'CASE WHEN {_NEWER(k)} THEN l{k} END' for k in _LEVELS)}, pos], lambda x: x IS NOT NULL) AS path FROM lasts),
nodes AS (SELECT doc_id, pos, node_type, level, content, path, path[len(path) - 1] AS parent_pos, len(path) - 1 AS depth,
    row_number() OVER (PARTITION BY doc_id, path[len(path) - 1] ORDER BY pos) - 1 AS ordinal FROM paths
  UNION ALL SELECT doc_id, 0, 'root', NULL, 'doc-' || doc_id, [0], NULL, 0, 0 FROM documents)"""

GATHERED = f"""{NODES},
tops AS (SELECT doc_id, pos, path[2] AS top, content, coalesce(sum(strlen(content)) OVER (PARTITION BY doc_id, path[2] ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nodes WHERE depth >= 1),
gathered AS (SELECT doc_id, top AS pos, string_agg(content, ' ' ORDER BY pos) AS text FROM tops WHERE before < {fixed.GATHER_BYTES} AND content <> '' GROUP BY doc_id, top)"""


def summary(x: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({cut(x, fixed.GATHER_BYTES)}, '[.!?]'), lambda s: {trim('s')}), lambda s: strlen(s) > 15)"
    return f"CASE WHEN len({parts}) > 0 THEN array_to_string(list_transform(list_slice({parts}, 1, 2), lambda s: s || '.'), ' ') ELSE {cut(x, 150)} END"


def topics(source: str, key: str) -> str:
    """CTEs that end in topics (key, topic, n, rank)."""
    return rf"""
topic_words AS (SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]')) AS topic FROM {source}),
topic_counts AS (SELECT {key}, topic, count(*) AS n FROM topic_words WHERE strlen(topic) > 3 AND topic NOT IN ({quoted(fixed.TOPIC_STOP_WORDS)}) AND NOT regexp_matches(topic, '^[0-9]+$') GROUP BY ALL),
topics AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, topic) AS rank FROM topic_counts) WHERE rank <= 5)"""


def entities(source: str, key: str) -> str:
    """CTEs that end in entities (key, entity), ten at most for each key."""
    edge = lambda c, x: rf"regexp_replace({x}, '^[^\p{{L}}\p{{N}}{c}]+|[^\p{{L}}\p{{N}}{c}]+$', '', 'g')"
    return rf"""
ew AS (SELECT {key}, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT {key}, {words('text')} AS ws FROM {source})),
ec AS (SELECT {key}, i, {edge('$.,%', 'w')} AS m, {edge('', 'w')} AS b FROM ew),
en AS (SELECT *, lead(b) OVER (PARTITION BY {key} ORDER BY i) AS nb, strlen(b) > 1 AND regexp_matches(b, '^\p{{Lu}}') AND NOT regexp_matches(b, '^\p{{Lu}}+$') AS cap FROM ec),
ei AS (SELECT *, sum(CASE WHEN cap THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i) AS island FROM en),
er AS (SELECT *, (row_number() OVER (PARTITION BY {key}, island ORDER BY i) - 1) // 4 AS part FROM ei WHERE cap),
eg AS (SELECT {key}, string_agg(b, ' ' ORDER BY i) AS entity, count(*) AS k, min_by(b, i) AS first FROM er GROUP BY {key}, island, part),
ea AS (SELECT {key}, m AS entity FROM ec WHERE strlen(m) > 1 AND (starts_with(m, '$') OR regexp_matches(m, '^[0-9.]*%$'))
  UNION SELECT {key}, CASE WHEN lower(b) IN ({quoted(fixed.MONTHS)}) THEN b ELSE upper(b) END || ' ' || nb FROM en WHERE regexp_matches(nb, '^[0-9]{{4}}$') AND (lower(b) IN ({quoted(fixed.MONTHS)}) OR regexp_matches(lower(b), '^q[0-9]$'))
  UNION SELECT {key}, entity FROM eg WHERE k >= 2 AND first NOT IN ({quoted(fixed.NAME_SKIP_WORDS)})),
entities AS (SELECT {key}, entity, rank FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY entity) AS rank FROM ea) WHERE rank <= 10)"""


CANDIDATES = f"""below AS (SELECT n.doc_id, n.path[2] AS top, string_agg((CASE WHEN n.depth = 2 THEN chr(10) || chr(10) ELSE chr(10) END) || n.content, '' ORDER BY n.pos) AS tail
  FROM nodes n JOIN nodes p ON p.doc_id = n.doc_id AND p.pos = n.path[3] WHERE n.depth IN (2, 3) AND strlen(p.content) > 2 AND n.content <> '' GROUP BY ALL),
candidates AS (SELECT t.doc_id, t.pos, {preview('t.content', 100)} AS title, t.content || coalesce(b.tail, '') AS content, t.ordinal AS rank FROM nodes t LEFT JOIN below b ON b.doc_id = t.doc_id AND b.top = t.pos WHERE t.depth = 1 AND t.ordinal < {fixed.SECTIONS_PER_DOC})"""

#: CTEs from nodes, requests and candidates that end in acts, the events of the log.
EVENTS = f"""kinds AS (SELECT group_id, doc_id, query, {intent('query')} AS intent FROM requests),
wanted AS (SELECT group_id, doc_id, unnest(f) AS term, unnest(range(len(f))) AS k FROM (SELECT group_id, doc_id, {fetch_terms('query')} AS f FROM kinds WHERE intent NOT IN ('summarize', 'list_extract'))),
hits AS (SELECT t.group_id, t.doc_id, t.k, t.term, n.pos, n.content, n.path, row_number() OVER (PARTITION BY t.group_id, t.doc_id, t.k ORDER BY n.pos) AS rank, count(n.pos) OVER (PARTITION BY t.group_id, t.doc_id, t.k) AS matches
  FROM wanted t LEFT JOIN nodes n ON n.doc_id = t.doc_id AND n.node_type <> 'root' AND contains(lower(n.content), lower(t.term))),
reads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, doc_id, pos ORDER BY k) AS seen FROM hits WHERE rank <= {fixed.MATCHES_PER_TERM} AND pos IS NOT NULL) WHERE seen = 1 AND strlen(content) >= 20),
titles AS (SELECT x.group_id, x.doc_id, x.pos, max(a.pos) AS found FROM (SELECT group_id, doc_id, pos, unnest(path) AS slot FROM reads) x JOIN nodes a ON a.doc_id = x.doc_id AND a.pos = x.slot AND a.node_type IN ('section', 'root') GROUP BY ALL),
listed AS (SELECT DISTINCT doc_id, found AS pos FROM (SELECT x.doc_id, x.pos AS item, max(a.pos) AS found FROM (SELECT doc_id, pos, unnest(path[1:len(path) - 1]) AS slot FROM nodes WHERE node_type IN ('table', 'table_row', 'list_item')) x
  JOIN nodes a ON a.doc_id = x.doc_id AND a.pos = x.slot AND a.node_type IN ('section', 'root') GROUP BY ALL)),
tails AS (SELECT doc_id, parent_pos AS pos, string_agg(CASE WHEN content <> '' THEN chr(10) || content ELSE '' END, '' ORDER BY ordinal) AS tail, count(*) AS below FROM nodes WHERE parent_pos IS NOT NULL GROUP BY ALL),
lists AS (SELECT k.group_id, s.doc_id, s.pos, s.content, row_number() OVER (PARTITION BY k.group_id, s.doc_id ORDER BY s.pos) AS rank, count(*) OVER (PARTITION BY k.group_id, s.doc_id) AS lists
  FROM listed JOIN nodes s USING (doc_id, pos) JOIN (SELECT *, {terms('query')} AS words FROM kinds WHERE intent = 'list_extract') k ON k.doc_id = s.doc_id WHERE len(words) = 0 OR len(list_filter(words, lambda w: contains(lower(s.content), w))) > 0),
tops AS (SELECT doc_id, count(*) AS n FROM nodes WHERE depth = 1 GROUP BY doc_id),
whole AS (SELECT k.group_id, k.doc_id FROM kinds k WHERE NOT EXISTS (SELECT 1 FROM lists l WHERE l.group_id = k.group_id AND l.doc_id = k.doc_id)),
acts AS (
  SELECT group_id, doc_id, 0 AS phase, k, -1 AS slot, 'search' AS tool, 'search' AS kind, term, matches AS n, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS content, 0 AS least FROM hits WHERE rank = 1
  UNION ALL SELECT r.group_id, r.doc_id, 0, r.k, r.pos, 'expand', 'search', r.term, 1, r.pos, {preview('n.content', 80)}, r.content, 0 FROM reads r JOIN titles t ON t.group_id = r.group_id AND t.doc_id = r.doc_id AND t.pos = r.pos JOIN nodes n ON n.doc_id = r.doc_id AND n.pos = t.found
  UNION ALL SELECT k.group_id, k.doc_id, 0, 0, -1, 'scan_lists', 'list', NULL, coalesce(max(l.lists), 0), NULL, NULL, NULL, 0 FROM kinds k LEFT JOIN lists l ON l.group_id = k.group_id AND l.doc_id = k.doc_id WHERE k.intent = 'list_extract' GROUP BY k.group_id, k.doc_id
  UNION ALL SELECT l.group_id, l.doc_id, 0, 0, l.rank, 'expand', 'list', NULL, 1 + coalesce(t.below, 0), l.pos, {preview('l.content', 80)}, l.content || coalesce(t.tail, ''), 0 FROM lists l LEFT JOIN tails t ON t.doc_id = l.doc_id AND t.pos = l.pos WHERE l.rank <= {fixed.LISTS_PER_DOC}
  UNION ALL SELECT w.group_id, w.doc_id, 1, 0, -1, 'tree_overview', 'summary', NULL, coalesce(t.n, 0), NULL, NULL, NULL, 0 FROM whole w LEFT JOIN tops t ON t.doc_id = w.doc_id
  UNION ALL SELECT w.group_id, w.doc_id, 1, 0, c.rank, 'expand', 'summary', NULL, 1, c.pos, c.title, c.content, 200 FROM whole w JOIN candidates c ON c.doc_id = w.doc_id WHERE NOT EXISTS (SELECT 1 FROM reads r WHERE r.group_id = w.group_id AND r.doc_id = w.doc_id))"""


def spent(budget: int = fixed.CONTENT_BUDGET) -> str:
    """Recursive CTEs from acts that end in log: what takes place, in order, with what is left of each content. The query has to start with WITH RECURSIVE."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY doc_id, phase, k, slot) AS i FROM acts),
run AS (SELECT DISTINCT group_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS spent, CAST(NULL AS BIGINT) AS doc_id, false AS stopped, false AS here, false AS took, CAST(NULL AS VARCHAR) AS text FROM acts
  UNION ALL SELECT group_id, i, spent + CASE WHEN tool = 'expand' AND takes THEN strlen(part) ELSE 0 END, doc_id, stopped OR (tool = 'expand' AND rest > 0 AND NOT takes), here OR (tool = 'expand' AND takes), takes, CASE WHEN tool = 'expand' AND takes THEN part END
  FROM (SELECT *, CASE tool WHEN 'expand' THEN rest > 0 AND NOT stopped AND (strlen(content) <= rest OR rest > least) WHEN 'search' THEN rest > 0 WHEN 'tree_overview' THEN NOT here ELSE true END AS takes, CASE WHEN rest > 0 THEN {cut('content', 'rest')} END AS part
    FROM (SELECT e.group_id, e.i, r.spent, e.doc_id, e.tool, e.content, e.least, {budget} - r.spent AS rest, coalesce(e.doc_id = r.doc_id, false) AND r.stopped AS stopped, coalesce(e.doc_id = r.doc_id, false) AND r.here AS here FROM run r JOIN numbered e ON e.group_id = r.group_id AND e.i = r.i + 1))),
log AS (SELECT n.* EXCLUDE (content), r.text AS content, row_number() OVER (PARTITION BY n.group_id ORDER BY n.i) AS step_number FROM run r JOIN numbered n ON n.group_id = r.group_id AND n.i = r.i WHERE r.took),
sections AS (SELECT group_id, doc_id, pos, title, content, row_number() OVER (PARTITION BY group_id ORDER BY i) - 1 AS seq FROM log WHERE tool = 'expand')"""


def steps(name: str) -> str:
    """The rows of the step log; name is an expression of doc_id. No two sections share a node."""
    flat = trim(r"regexp_replace(content, '\s+', ' ', 'g')")
    return f"""SELECT group_id, step_number, tool, doc_id, n,
  CASE WHEN tool = 'search' THEN 'Searching "' || term || '" in "' || {name} || '" — ' || n || ' matches' WHEN tool = 'tree_overview' THEN 'Scanning structure of "' || {name} || '"' WHEN tool = 'scan_lists' THEN 'Found ' || n || ' list/table sections in "' || {name} || '"'
    WHEN kind = 'search' THEN 'Reading matched content from "' || {name} || '"' WHEN kind = 'list' THEN 'Reading list/table "' || ({cut('title', 40)}) || '" from "' || {name} || '"' ELSE 'Reading "' || ({cut('title', 60)}) || '" from "' || {name} || '"' END AS input,
  CASE WHEN tool = 'search' THEN n || ' matching nodes' WHEN tool = 'tree_overview' THEN n || ' top-level sections found' WHEN tool = 'scan_lists' THEN n || ' list/table sections found' WHEN content = '' THEN n || ' nodes expanded'
    ELSE CASE WHEN strlen({flat}) > 200 THEN ({cut(flat, 200)}) || '…' ELSE {flat} END END AS output FROM log"""

# --- drawings ---
_PARENTS = ",\n".join(
    f"d{k} AS (SELECT doc_id, pos, parent_pos, x FROM ends WHERE depth = {k} UNION ALL SELECT s.doc_id, s.pos, s.parent_pos, (min_by(c.x, c.pos) + max_by(c.x, c.pos)) / 2 FROM seen s JOIN d{k + 1} c ON c.doc_id = s.doc_id AND c.parent_pos = s.pos GROUP BY s.doc_id, s.pos, s.parent_pos)"
    for k in (2, 1, 0)
)
LAYOUT = f"""{NODES},
hidden AS (SELECT DISTINCT x.doc_id, x.pos FROM (SELECT doc_id, pos, unnest(path) AS slot FROM nodes WHERE depth <= 3) x JOIN nodes c ON c.doc_id = x.doc_id AND c.pos = x.slot AND c.ordinal >= 10),
seen AS (SELECT n.doc_id, n.pos, n.parent_pos, n.depth FROM nodes n ANTI JOIN hidden h ON h.doc_id = n.doc_id AND h.pos = n.pos WHERE n.depth <= 3),
ends AS (SELECT s.*, (row_number() OVER (PARTITION BY s.doc_id ORDER BY s.pos) - 1) * 70.0::DOUBLE AS x FROM seen s ANTI JOIN seen c ON c.doc_id = s.doc_id AND c.parent_pos = s.pos),
d3 AS (SELECT doc_id, pos, parent_pos, x FROM ends WHERE depth = 3), {_PARENTS},
layout AS ({' UNION ALL '.join(f'SELECT doc_id, pos, x, {80 * k}::DOUBLE AS y FROM d{k}' for k in range(4))})"""
