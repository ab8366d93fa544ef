"""The page queries in DuckDB SQL."""

from __future__ import annotations

from weftgraph.plans.journey import GRAPH_SQL

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_REST = "regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)"
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1, 's')"
_WORD = r"(^|[^\p{L}\p{N}_])"
_AFTER = r"($|[^\p{L}\p{N}_])"


def _hits(text: str, words: list[str], open_end: bool = False) -> str:
    """How often one of the words stands in the text, found in the text with doubled separators."""
    pad = f"regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    tail = "" if open_end else _AFTER
    return f"len(regexp_extract_all({pad}, '(?i){_WORD}({'|'.join(words)}){tail}'))"


def _entity(kind: str, name: str, words: list[str], open_end: bool = False) -> str:
    t, h, b = (_hits(c, words, open_end) for c in ("title", "source", "text"))
    return f"SELECT url, '{kind}' AS entity_type, '{name}' AS entity, {t} AS t, {h} AS h, {b} AS b FROM v"


_ENTITIES = f"""
WITH v AS (SELECT doc_id::VARCHAR AS url, split_part(text, chr(10), 1) AS title, source, text FROM documents), s AS (
  {_entity("Function", "Conjunction", ["and", "und"])} UNION ALL {_entity("Function", "Article", ["the", "der", "la", "le"])}
  UNION ALL {_entity("Form", "Stem", ["ther", "tion"], True)}
  UNION ALL SELECT url, 'Form', 'Code', len(regexp_extract_all(title, '(?i)[A-Z]{{4}}[0-9]{{2}}')), 0, len(regexp_extract_all(text, '(?i)[A-Z]{{4}}[0-9]{{2}}')) FROM v
)
SELECT url, entity_type, entity, (3 * t + 2 * h + least(b, 5))::DOUBLE AS score,
  CASE WHEN t > 0 THEN 'title' WHEN h > 0 THEN 'heading' ELSE 'body' END AS evidence
FROM s WHERE 3 * t + 2 * h + least(b, 5) >= 3
"""

_TOPIC_TESTS = {"Joining": ["and", "und"], "Pointing": ["the", "der", "la"], "Ending": ["tion*"]}
_TOPIC_FIELDS = {"title": "split_part(text, chr(10), 1)", "h1": "lang", "breadcrumb": "''", "nav_label": "substr(text, length(split_part(text, chr(10), 1)) + 2)", "url_path": "source"}


def _topics() -> str:
    parts = []
    for topic, terms in _TOPIC_TESTS.items():
        cases = []
        for field, text in _TOPIC_FIELDS.items():
            for term in terms:
                word, tail = term.rstrip("*"), "" if term.endswith("*") else _AFTER
                cases.append(f"WHEN regexp_matches({text}, '(?i){_WORD}{word}{tail}') THEN '{field}/{term}'")
        parts.append(f"SELECT doc_id::VARCHAR AS url, '{topic}' AS topic, CASE {' '.join(cases)} END AS hit FROM documents")
    return " UNION ALL ".join(parts)


_TOPIC_ROWS = f"SELECT url, topic, split_part(hit, '/', 1) AS field, split_part(hit, '/', 2) AS rule FROM ({_topics()}) WHERE hit IS NOT NULL"

_LEADS = """
WITH kinds AS (SELECT p_partkey, p_type || '_' || p_size::VARCHAR AS kind FROM part),
  sold AS (SELECT * FROM lineitem JOIN kinds ON l_partkey = p_partkey),
  counts AS (SELECT kind, sum(l_quantity) AS leads FROM sold GROUP BY kind),
  numbered AS (SELECT kind, leads, length(kind) AS c FROM counts),
  tags AS (SELECT CASE c % 4 WHEN 1 THEN kind || '_123456' WHEN 2 THEN 'NONE_' || kind ELSE kind END AS lead_tag, leads, 'https://s.example/' || (c % 7) AS main FROM numbered),
  carriers AS (SELECT DISTINCT kind AS tag, 's' || l_suppkey AS src, 'https://s.example/' || (l_suppkey % 7) AS url, CASE WHEN l_linenumber > 3 THEN 'nav' ELSE 'body' END AS region
    FROM sold),
  stripped AS (SELECT *, regexp_replace(lead_tag, '_[0-9]{5,7}$', '') AS s FROM tags),
  joined AS (SELECT t.lead_tag, t.leads, t.main, c.*, CASE WHEN t.lead_tag = c.tag THEN 'exact' ELSE 'fallback' END AS join_type
    FROM stripped t JOIN carriers c ON regexp_replace(c.tag, '_[0-9]{5,7}$', '') = t.s),
  kept AS (SELECT * FROM joined j WHERE join_type = 'exact' OR lead_tag NOT IN (SELECT tag FROM carriers))
"""

_JOURNEY = f"""
WITH RECURSIVE {GRAPH_SQL},
  wa(node, d) AS (SELECT url, 0 FROM nodes WHERE win UNION SELECT src, d + 1 FROM wa JOIN live ON dst = node WHERE d < 40),
  wc(node, d) AS (SELECT url, 0 FROM nodes WHERE win UNION SELECT src, d + 1 FROM wc JOIN live ON dst = node WHERE content AND d < 40),
  da AS (SELECT node, min(d) AS d FROM wa GROUP BY node), dc AS (SELECT node, min(d) AS d FROM wc GROUP BY node),
  base AS (SELECT url, win, explored, split_part(url, ':', 2)::INT AS k, split_part(url, ':', 1)::INT AS u FROM nodes),
  tags AS (SELECT url, 'Place' AS entity_type, k::VARCHAR AS entity, (k % 4 + 1)::DOUBLE AS score FROM base WHERE k % 3 = 0
    UNION ALL SELECT url, 'Group', (u % 50)::VARCHAR, (u % 3 + 1)::DOUBLE FROM base WHERE k % 3 = 0)
"""

_PAGE = "'https://x.com/en/' || ['Track', 'news.html', 'about', 'shop', 'support'][k % 5 + 1] || '/' || k"
_ROLLUP = (
    _JOURNEY
    + """, cats AS (SELECT CASE k % 5 WHEN 0 THEN 'track' WHEN 1 THEN 'news' WHEN 2 THEN 'about' WHEN 3 THEN 'shop' ELSE 'support' END AS section,
    CASE WHEN win THEN 'win' ELSE CASE k % 5 WHEN 0 THEN 'tool' WHEN 1 THEN 'content' WHEN 2 THEN 'corporate' WHEN 3 THEN 'other' ELSE 'support' END END AS page_type,
    CASE WHEN win THEN 'win' WHEN d IS NOT NULL THEN 'reaches win' ELSE 'dead end' END AS reach, d, k % 2 = 0 AS js
  FROM base LEFT JOIN dc ON node = url WHERE explored)
SELECT {key}, count(*) AS pages, count(*) FILTER (reach IN ('win', 'reaches win')) AS reach_win_all_links, count(*) FILTER (reach IN ('win', 'reaches win')) AS reach_win_content_only,
  median(d)::DOUBLE AS median_clicks_content_only, count(*) FILTER (reach = 'dead end') AS dead_or_trap_content_only, count(*) FILTER (js) AS js_dependent
FROM cats GROUP BY {key}"""
)

ORACLES = {
    "normalized_urls": f"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END
  || coalesce('?' || (SELECT string_agg(x, '&' ORDER BY split_part(x, '=', 1)) FROM (SELECT unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS x)
      WHERE x <> '' AND NOT regexp_matches(x, '(?i)^(utm_.*|ref)=')), '') AS normal FROM pages""",
    "url_parts": f"""
SELECT page_id, {_HOST} AS host,
  CASE WHEN rest = '' THEN '(home)' ELSE regexp_replace(split_part(rest, '/', 1), '[.](html?|page|aspx?|php)$', '') END AS section,
  CASE WHEN rest = '' THEN 'home' ELSE 'other' END AS page_type, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {_HOST} || lower({_PATH}) AS conversion,
  lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {_HOST} || regexp_replace({_PATH}, '/+$', '') AS seed, regexp_replace({_HOST}, '[^a-z0-9]+', '_', 'g') AS slug
FROM (SELECT *, ltrim(CASE WHEN {_PATH} LIKE '/en/%' OR {_PATH} LIKE '/de/%' THEN substr({_PATH}, 5) ELSE {_PATH} END, '/') AS rest FROM pages)""",
    "scope_and_win": f"""
SELECT page_id, in_scope, is_win, CASE WHEN is_win THEN 'contact' END AS win_type, contains({_PATH}, '/en/') AND NOT is_win AND NOT no AS near_miss FROM (
  SELECT *, {_HOST} IN ('therou.example.com', 'm.therou.example.com', 'blog.tionsh.example.net', 'thther.example.org') AND (contains({_PATH}, '/en/') OR contains({_PATH}, '/de/')) AS in_scope,
    contains(url, 'page=2') AS no, (regexp_matches(url, '/en/1') OR regexp_full_match(url, '.*/de/[0-9]+[.]html')) AND NOT contains(url, 'page=2') AS is_win FROM pages)""",
    "robots_allowed": f"""
SELECT page_id, CASE WHEN regexp_matches(r, '^/en/.*[.]html$') THEN true WHEN regexp_matches(r, '^/.*[.]html$') THEN false
  WHEN starts_with(r, '/de/1') THEN true WHEN starts_with(r, '/de/') THEN false ELSE true END AS allowed FROM (SELECT page_id, {_REST} AS r FROM pages)""",
    "dead_and_blocked": f"""
SELECT page_id, CASE WHEN s IN (404, 410) THEN 'HTTP ' || s WHEN starts_with(lower(trim(t)), '404') THEN 'title starts with 404' END AS dead_reason,
  CASE WHEN s IN (403, 429) THEN 'HTTP ' || s END AS block_reason
FROM (SELECT page_id, [200, 404, 410, 403, 429, 200, 200][page_id % 7 + 1] AS s, {_TITLE} AS t FROM pages)""",
    "link_extraction_counts": """
SELECT src, href, count(*) AS n, max(text) AS text FROM (SELECT url AS src, unnest(regexp_extract_all(nav, '<a href="([^"]*)"', 1)) AS href, unnest(regexp_extract_all(nav, '<a href="[^"]*">(.*?)</a>', 1)) AS text
  FROM (SELECT url, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages)) GROUP BY src, href""",
    "page_heads": """
SELECT h1_count, 0::BIGINT AS n_types, count(*) AS pages, count(*) AS titled
FROM (SELECT len(regexp_extract_all(html, '<h1>[^<]'))::BIGINT AS h1_count FROM pages) GROUP BY h1_count""",
    "survivor_merge": """
WITH rows AS (SELECT url, max(CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END) AS rank FROM pages GROUP BY url), keyed AS (
  SELECT *, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^http:', 'https:') AS key FROM rows)
SELECT url, key, first_value(url) OVER w AS keep, row_number() OVER w = 1 AS is_kept FROM keyed WINDOW w AS (PARTITION BY key ORDER BY rank, url <> key, url)""",
    "duplicate_titles": r"""
SELECT doc_id, title <> '' AND count(*) OVER (PARTITION BY regexp_replace(lower(title), '^\s+|\s+$', '', 'g')) > 1 AS title_duplicated
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents)""",
    "boilerplate_grams": r"""
WITH tokens AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''), lambda t: regexp_replace(lower(t), '^[^\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+$', '', 'g')) AS w FROM documents),
  grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM tokens WHERE len(w) >= 8))
SELECT gram, count(*) AS pages FROM grams GROUP BY gram HAVING count(*) >= 3""",
    "entity_tags": _ENTITIES,
    "entity_coverage": _JOURNEY
    + """SELECT entity_type, entity, count(*) AS pages_tagged, count(*) FILTER (dc.d = 1) AS pages_linking_win_content, count(*) FILTER (da.d = 1) AS pages_linking_win_all,
  median(dc.d)::DOUBLE AS median_clicks_content, median(da.d)::DOUBLE AS median_clicks_all, round_even(100 * count(*) FILTER (dc.d <= 2) / count(*), 1) AS pct_within_2_content,
  round_even(100 * count(*) FILTER (da.d <= 2) / count(*), 1) AS pct_within_2_all, count(*) FILTER (dc.d IS NULL) AS no_path_content,
  CASE WHEN count(*) < 10 THEN '' WHEN count(dc.d) = 0 THEN 'no path' WHEN count(*) FILTER (dc.d IS NULL) * 2 > count(*) THEN 'mostly no path' ELSE '' END AS flag
FROM tags t JOIN nodes n ON n.url = t.url AND NOT n.win LEFT JOIN da ON da.node = t.url LEFT JOIN dc ON dc.node = t.url GROUP BY entity_type, entity""",
    "bridge_links": _JOURNEY
    + """, pairs AS (SELECT t.url, b.url AS bridge_page, any_value(dc.d) AS clicks, round_even(sum(least(t.score, b.score)), 2) AS shared_score,
    string_agg(t.entity_type || ': ' || t.entity, '; ' ORDER BY -least(t.score, b.score), t.entity_type, t.entity) AS shared_entities
  FROM tags t JOIN nodes n ON n.url = t.url AND n.explored AND NOT n.win LEFT JOIN dc ON dc.node = t.url
  JOIN tags b ON b.entity_type = t.entity_type AND b.entity = t.entity AND b.url <> t.url JOIN dc near ON near.node = b.url AND near.d = 1
  WHERE (dc.d IS NULL OR dc.d > 1) AND NOT EXISTS (SELECT 1 FROM live WHERE content AND src = t.url AND dst = b.url) GROUP BY t.url, b.url),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY shared_score DESC, bridge_page) AS rank FROM pairs)
SELECT url, clicks::BIGINT AS clicks, rank, bridge_page, shared_score, shared_entities FROM ranked WHERE rank <= 3""",
    "topic_tags": _TOPIC_ROWS,
    "topic_matrix": f"""
WITH t AS ({_TOPIC_ROWS}), p AS (SELECT doc_id::VARCHAR AS url, lang AS site, n_chars % 9 AS home_all, CASE WHEN n_chars % 5 > 0 THEN n_chars % 5 END AS win_all FROM documents),
  s AS (SELECT site, count(*) AS total FROM p GROUP BY site), names AS (SELECT unnest(['Joining', 'Pointing', 'Ending', 'Nothing']) AS topic),
  held AS (SELECT site, topic, count(DISTINCT url) AS pages, median(home_all)::DOUBLE AS h, median(win_all)::DOUBLE AS w FROM t JOIN p USING (url) GROUP BY site, topic)
SELECT s.site, names.topic, coalesce(pages, 0) AS pages, round_even(100 * coalesce(pages, 0) / total, 1) AS share_pct, h AS median_clicks_from_home, w AS median_clicks_to_win
FROM s CROSS JOIN names LEFT JOIN held ON held.site = s.site AND held.topic = names.topic""",
    "site_scalars": """
WITH p AS (SELECT source AS site, n_chars % 9 AS h, CASE WHEN n_chars % 5 > 0 THEN n_chars % 5 END AS wa, CASE WHEN n_chars % 7 > 2 THEN n_chars % 7 END AS wb, n_chars % 4 AS i,
  n_chars % 3 = 0 AS c, CASE WHEN n_chars % 11 > 0 THEN n_chars % 2 = 0 END AS one FROM documents)
SELECT site, count(*) AS pages, round_even(100 * count(*) FILTER (wa IS NOT NULL AND (wb IS NULL OR wb - wa >= 2)) / count(*), 1) AS menu_reliance_share,
  round_even(100 * count(*) FILTER (h >= 4) / count(*), 1) AS share_4plus_from_home, round_even(100 * count(*) FILTER (h >= 5) / count(*), 1) AS share_5plus_from_home,
  round_even(100 * count(*) FILTER (i = 1) / count(*), 1) AS single_inbound_share, CASE WHEN count(*) FILTER (c) > 0 THEN round_even(100 * count(*) FILTER (c AND h >= 4) / count(*) FILTER (c), 1) END AS deep_share_content,
  CASE WHEN count(*) FILTER (NOT c) > 0 THEN round_even(100 * count(*) FILTER (NOT c AND h >= 4) / count(*) FILTER (NOT c), 1) END AS deep_share_product_service,
  CASE WHEN count(one) > 0 THEN round_even(100 * count(*) FILTER (one) / count(one), 1) END AS one_h1
FROM p GROUP BY site""",
    "lead_attribution": _LEADS
    + """, n AS (SELECT lead_tag, count(DISTINCT src) AS n FROM kept GROUP BY lead_tag)
SELECT src, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS mc_id, lead_tag, any_value(join_type) AS join_type, string_agg(DISTINCT region, ',' ORDER BY region) AS region, any_value(n) AS tag_source_pages,
  round(any_value(leads) / any_value(n), 6) AS leads_allocated, CASE WHEN any_value(n) = 1 THEN 'exact' ELSE 'shared' END AS attribution, floor(any_value(leads) / any_value(n))::BIGINT AS leads_whole
FROM kept JOIN n USING (lead_tag) GROUP BY src, lead_tag""",
    "lead_matches": _LEADS
    + """, m AS (SELECT t.lead_tag, any_value(t.leads) AS leads, any_value(k.join_type) AS join_type, count(DISTINCT k.src) AS pages,
    CASE WHEN any_value(t.main) IS NOT NULL AND any_value(k.join_type) IS NOT NULL THEN bool_or(k.url = t.main) ELSE false END AS lands_on_target FROM tags t LEFT JOIN kept k USING (lead_tag) GROUP BY t.lead_tag)
SELECT join_type, lands_on_target, count(*) AS tags, sum(leads) AS leads, sum(pages)::BIGINT AS pages FROM m GROUP BY join_type, lands_on_target""",
    "lead_rollup": _LEADS
    + "SELECT CASE WHEN leads >= 1000 THEN lead_tag ELSE '(other, <1000 leads)' END AS tag, sum(leads) AS leads, count(*) AS tags FROM tags GROUP BY 1",
    "zero_lead_tags": _LEADS
    + """, paid AS (SELECT DISTINCT tag FROM kept WHERE leads > 0)
SELECT tag, count(DISTINCT src) AS pages, count(DISTINCT src) FILTER (url IN ('https://s.example/0', 'https://s.example/1', 'https://s.example/2')) AS win_pages,
  CASE WHEN count(*) FILTER (url IN ('https://s.example/0', 'https://s.example/1', 'https://s.example/2')) > 0 THEN 'shop' ELSE '' END AS win_types
FROM carriers WHERE tag NOT IN (SELECT tag FROM paid) GROUP BY tag""",
    "section_rollup": _ROLLUP.format(key="section"),
    "page_type_rollup": _ROLLUP.format(key="page_type"),
    "dead_links": f"""WITH {GRAPH_SQL}, dead AS (SELECT url FROM nodes WHERE split_part(url, ':', 2) = '7')
SELECT d.url, count(e.src) AS links, count(DISTINCT e.src) AS pages, count(*) FILTER (e.body) AS body_links
FROM dead d LEFT JOIN (SELECT * FROM edges WHERE src NOT IN (SELECT url FROM dead)) e ON e.dst = d.url GROUP BY d.url""",
}
