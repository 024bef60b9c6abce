"""The registered queries as plain SQL for DuckDB, written from the rules, not from the Spark plans.

Texts are handled whole and every table is read whole. Word boundaries and white space are spelled
out because the regular expressions of the two engines differ there. Lists are compared joined.
"""

from __future__ import annotations

from docstruct import constants as K
from docstruct import labels
from docstruct.functions.text import WHITE_SPACE

SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
START = rf"(?:^|[^{WORD}])"
END = rf"(?:$|[^{WORD}])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STRIP_CHARS = " || ".join(
    ["chr(%d)" % ord(c) for c in WHITE_SPACE]
)


def strip(x: str) -> str:
    return f"trim({x}, {STRIP_CHARS})"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[{SPACE}\x{{00}}-\x{{1f}}\x{{7f}}]+', ' ', 'g'))"


def clean(x: str) -> str:
    x = rf"regexp_replace({x}, '[{SPACE}\x{{00}}-\x{{1f}}\x{{7f}}]+', ' ', 'g')"
    x = f"replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    x = rf"regexp_replace({x}, ' ([,.;:])', '\1', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([{WORD}])- ([{WORD}])', '\1\2', 'g')"
    return f"trim({x})"


def clean_title(x: str) -> str:
    x = clean(x)
    x = rf"regexp_replace({x}, 'https?://[^{SPACE}]+', ' ', 'gi')"
    for word in ("Article", "Check for updates"):
        for _ in range(2):
            x = rf"regexp_replace({x}, '({START}){word}({END})', '\1 \2', 'gi')"
    x = rf"regexp_replace({x}, '({START})doi[: ][^{SPACE}]+', '\1 ', 'gi')"
    return clean(x)


def sanitize(x: str, n: int | None = None) -> str:
    x = collapse(f"coalesce({x}, '')")
    return x if n is None else f"trim(substring({x}, 1, {n}))"


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def lookup(x: str, mapping: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def noise(x: str) -> str:
    patterns = [p.replace(r"\b", END) for p in K.NOISE_PATTERNS]
    return f"regexp_matches(lower({strip(x)}), {q('|'.join(patterns))})"


def citation(x: str) -> str:
    p = rf"{START}et al\.,|{START}sci\. adv\.[{WORD}]|{START}science advances{END}"
    return f"regexp_matches(lower({x}), '{p}')"


def venue_line(x: str) -> str:
    p = rf"volume|issue|{START}nature{END}|{START}sci\. adv\.[{WORD}]"
    return f"regexp_matches(lower({x}), '{p}')"


AUTHOR = K.AUTHOR_NAME_PATTERN.replace(r"\s", f"[{SPACE}]")


def author_line(x: str) -> str:
    return f"len(regexp_extract_all(regexp_replace({x}, {q('[' + K.AUTHOR_MARKS + '0-9]+')}, ' ', 'g'), {q(AUTHOR)})) >= 2"


def heading(x: str) -> str:
    return lookup(rf"lower(trim(regexp_replace({x}, '[^A-Za-z]+', ' ', 'g')))", K.SECTION_ALIASES)


def figure_id(x: str) -> str:
    found = rf"upper(regexp_extract({x}, '(?i)^[{SPACE}]*fig(?:ure)?\.?[{SPACE}]*(\d+[A-Za-z]?){END}', 1))"
    return f"'Figure ' || nullif({found}, '')"


SEEDED = r"""
lines AS (SELECT doc_id, i - 1 AS idx, arr[i] AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents) s,
               unnest(range(1, len(arr) + 1)) u(i)),
templ(pos, m, r, txt) AS (VALUES
 (1,   1, 0, 'Scalable indexing of corpus number {d}'),
 (2,   3, 0, 'Ada Lovelace1, Alan Turing2 & Grace Hopper'),
 (3,   4, 1, 'Nature Machine Intelligence | Volume 7 | April 20{y} | 639-649'),
 (4,   5, 2, 'https://doi.org/10.1038/s42256-0{y}-{d}.'),
 (5,   2, 0, 'Published online: 21 February 20{y}'),
 (6,   3, 1, 'Abstract'),
 (115, 2, 1, '1. Introduction'),
 (125, 4, 0, 'Downloaded from https://example.com/{d}'),
 (135, 3, 2, 'Materials and Methods'),
 (142, 2, 0, 'Figure 1 compares accuracy and latency of (a) ours vs. (b) baseline {d}.'),
 (143, 3, 0, 'Page 2'),
 (144, 5, 0, 'Error bars show the spread over ten runs of the pipeline.'),
 (155, 1, 0, 'As shown in Fig. 1, the improvement holds for corpus {d}.'),
 (165, 2, 1, 'RESULTS'),
 (175, 3, 1, 'Fig. 2a | Overview of the workflow; table of stable parts.'),
 (176, 7, 0, 'short'),
 (185, 4, 2, 'Results and Discussion'),
 (195, 2, 0, 'Conclusions')
), raw_blocks AS (
 SELECT doc_id, 100 + idx * 10 AS pos, line AS txt FROM lines WHERE trim(line) <> ''
 UNION ALL
 SELECT d.doc_id, t.pos,
        replace(replace(t.txt, '{d}', CAST(d.doc_id AS VARCHAR)), '{y}', CAST(10 + d.doc_id % 15 AS VARCHAR))
 FROM (SELECT DISTINCT doc_id FROM lines) d JOIN templ t ON d.doc_id % t.m = t.r % t.m
), ordered AS (
 SELECT doc_id, txt, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS order_index
 FROM raw_blocks
), paged AS (
 SELECT doc_id, txt, pos, order_index,
        CAST(floor(order_index / 12.0) AS INT) + 1 AS page_number, order_index % 12 AS slot
 FROM ordered
), blocks AS (
SELECT doc_id, concat('p', CAST(page_number AS VARCHAR), '_b', CAST(slot AS VARCHAR)) AS block_id, page_number, order_index,
       'text' AS block_type, txt AS text,
       CAST(slot * 60 + CASE WHEN (doc_id + order_index) % 5 = 0 THEN 90 ELSE 0 END AS DOUBLE) AS y0,
       CAST(CASE WHEN pos = 1 THEN 18 ELSE 10 END AS DOUBLE) AS max_size
FROM paged
)"""

FLAGGED = f"""
fb AS MATERIALIZED (
 SELECT *, {noise('text')} AS is_noise, {citation('text')} AS is_citation, {venue_line('text')} AS is_venue,
        {author_line('text')} AS is_author, {heading('text')} AS heading_key, {figure_id('text')} AS figure_id
 FROM blocks WHERE block_type = 'text' AND text <> ''
), first_headings AS (
 SELECT *, heading_key IS NOT NULL AND
        row_number() OVER (PARTITION BY doc_id, page_number, heading_key ORDER BY order_index) = 1 AS is_heading,
        row_number() OVER (PARTITION BY doc_id ORDER BY order_index) - 1 AS text_pos
 FROM fb
), gaps AS (
 SELECT *, lag(page_number) OVER w AS last_page, lag(y0) OVER w AS last_y0
 FROM fb WHERE NOT is_noise WINDOW w AS (PARTITION BY doc_id ORDER BY order_index)
), breaks AS (
 SELECT *, figure_id IS NOT NULL OR heading_key IS NOT NULL OR length(text) < {K.CAPTION_MIN_CHARS}
        OR last_page IS NULL OR last_page <> page_number OR y0 - last_y0 > {K.CAPTION_MAX_GAP} AS brk
 FROM gaps
), islands AS (
 SELECT *, sum(brk::INT) OVER (PARTITION BY doc_id ORDER BY order_index) AS island FROM breaks
), heads AS (
 SELECT doc_id, island, min(order_index) AS start_at, arg_min(figure_id, order_index) AS head_id
 FROM islands GROUP BY ALL HAVING head_id IS NOT NULL
), runs AS (
 SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_at) - 1 AS INT) AS caption_order FROM heads
), cap AS (
 SELECT i.doc_id, i.order_index, r.caption_order, r.head_id
 FROM islands i JOIN runs r ON i.doc_id = r.doc_id AND i.island = r.island
), an AS MATERIALIZED (
 SELECT f.*, c.caption_order, c.head_id,
        coalesce(sum(f.is_heading::INT) OVER (PARTITION BY f.doc_id ORDER BY f.order_index), 0) AS section_seq
 FROM first_headings f LEFT JOIN cap c ON f.doc_id = c.doc_id AND f.order_index = c.order_index
)"""

TITLE = f"""
p1 AS (SELECT * FROM fb WHERE page_number = 1),
able AS (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY order_index) AS nth,
        bool_or(y0 < {K.TITLE_MAX_Y}) OVER (PARTITION BY doc_id) AS any_top
 FROM p1 WHERE NOT (is_noise OR is_citation OR is_venue OR is_author) AND heading_key IS NULL
), cand AS (
 SELECT *, max(max_size) OVER (PARTITION BY doc_id) AS top_size FROM able
 WHERE CASE WHEN any_top THEN y0 < {K.TITLE_MAX_Y} ELSE nth <= 6 END
), large AS (
 SELECT * FROM cand WHERE max_size >= greatest({K.TITLE_MIN_SIZE}, top_size - {K.TITLE_SIZE_SLACK})
), picked AS (
 SELECT doc_id, order_index, text, block_id FROM large
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY order_index) <= 2
 UNION ALL
 SELECT doc_id, order_index, text, block_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM large l WHERE l.doc_id = c.doc_id)
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY max_size DESC, order_index) <= 2
), picked_clean AS (SELECT *, {clean_title('text')} AS piece FROM picked),
titles AS (
 SELECT doc_id, min(order_index) AS title_at, list(order_index) AS title_orders,
        string_agg(block_id, ' | ' ORDER BY order_index) AS title_block_ids,
        {clean("coalesce(string_agg(piece, ' ' ORDER BY order_index) FILTER (WHERE piece <> ''), '')")} AS title
 FROM picked_clean GROUP BY doc_id
), after_title AS (
 SELECT p.*, is_noise OR is_author OR is_citation AS skipped
 FROM p1 p JOIN titles t ON p.doc_id = t.doc_id
 WHERE p.order_index > t.title_at AND NOT list_contains(t.title_orders, p.order_index)
), author_stop AS (
 SELECT doc_id, min(order_index) AS stop FROM after_title WHERE heading_key IS NOT NULL GROUP BY doc_id
), abstract_stop AS (
 SELECT doc_id, min(order_index) AS stop FROM after_title WHERE heading_key IS NOT NULL AND NOT skipped GROUP BY doc_id
), author_lines AS (
 SELECT a.doc_id, a.order_index, a.text FROM after_title a LEFT JOIN author_stop s ON a.doc_id = s.doc_id
 WHERE (s.stop IS NULL OR a.order_index < s.stop) AND NOT is_noise AND is_author
 QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY a.order_index) <= {K.AUTHOR_LINES}
), author_text AS (
 SELECT doc_id, replace(regexp_replace(string_agg(text, ' ' ORDER BY order_index),
        {q('[' + K.AUTHOR_MARKS + ']+|[0-9]+')}, ' ', 'g'), '&', ',') AS t
 FROM author_lines GROUP BY doc_id
), names AS (
 SELECT doc_id, i, {clean(f"regexp_extract_all(t, {q(AUTHOR)})[i]")} AS name
 FROM author_text, unnest(range(1, len(regexp_extract_all(t, {q(AUTHOR)})) + 1)) u(i)
), first_names AS (SELECT doc_id, name, min(i) AS i FROM names GROUP BY ALL),
authors AS (SELECT doc_id, string_agg(name, ' | ' ORDER BY i) AS authors FROM first_names GROUP BY doc_id),
abstract_lines AS (
 SELECT a.doc_id, a.order_index, a.text FROM after_title a LEFT JOIN abstract_stop s ON a.doc_id = s.doc_id
 WHERE (s.stop IS NULL OR a.order_index < s.stop) AND NOT skipped AND length(text) >= {K.ABSTRACT_MIN_CHARS}
 QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY a.order_index) <= {K.ABSTRACT_BLOCKS}
), abstracts AS (
 SELECT doc_id, {clean("string_agg(text, ' ' ORDER BY order_index)")} AS abstract FROM abstract_lines GROUP BY doc_id
), venue_hits AS (
 SELECT doc_id, order_index, coalesce(
   nullif(regexp_extract(text, '{START}(Sci\\. Adv\\.[{WORD}].*)', 1, 'i'), ''),
   nullif(regexp_extract(text, '{START}(Science Advances(?:[^{WORD}].*|$))', 1, 'i'), ''),
   nullif(regexp_extract(text, '{START}(Nature(?:[^{WORD}].*|$))', 1, 'i'), ''),
   nullif(regexp_extract(text, '{START}(Cell(?:[^{WORD}].*|$))', 1, 'i'), ''),
   nullif(regexp_extract(text, '{START}(arXiv(?:[^{WORD}].*|$))', 1, 'i'), '')) AS v
 FROM p1 WHERE NOT is_noise
), venues AS (SELECT doc_id, {clean('arg_min(v, order_index)')} AS venue FROM venue_hits WHERE v IS NOT NULL GROUP BY doc_id),
year_hits AS (
 SELECT doc_id, order_index, regexp_extract(text, '(19|20)\\d{{2}}') AS y,
        CASE WHEN is_citation OR contains(lower(text), 'published') THEN 0 ELSE 1 END AS prio FROM p1
), years AS (SELECT doc_id, y AS year FROM year_hits WHERE y <> ''
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY prio, order_index) = 1)"""

DOI = f"""
doi_hits AS (
 SELECT doc_id, order_index, page_number, text, i,
        rtrim(regexp_extract_all(text, {q(K.DOI_PATTERN)}, 0, 'i')[i], {q(K.DOI_TRIM)}) AS doi
 FROM fb, unnest(range(1, len(regexp_extract_all(text, {q(K.DOI_PATTERN)}, 0, 'i')) + 1)) u(i)
), doi_scored AS (
 SELECT *, CASE WHEN contains(lower(text), 'doi') THEN 4 ELSE 0 END
         + CASE WHEN contains(lower(text), 'doi.org') THEN 3 ELSE 0 END
         + CASE WHEN page_number <= 2 THEN 2 ELSE 0 END
         + CASE WHEN length(doi) >= 15 THEN 1 ELSE 0 END AS score
 FROM doi_hits WHERE NOT ends_with(doi, '-')
), dois AS (
 SELECT doc_id, doi, score FROM doi_scored
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(doi) DESC, order_index, i) = 1
)"""


def _keyword_rows() -> str:
    rows = [
        f"({i}, {q(key)}, {q(word)})"
        for i, (key, words) in enumerate(K.FALLBACK_KEYWORDS.items())
        for word in words
    ]
    return ", ".join(rows)


SECTIONS = f"""
section_keys AS (SELECT doc_id, section_seq, heading_key AS section_key FROM an WHERE is_heading),
section_bodies AS (
 SELECT doc_id, section_seq, {clean("string_agg(text, ' ' ORDER BY order_index)")} AS content FROM an
 WHERE section_seq > 0 AND NOT is_heading AND caption_order IS NULL AND NOT is_noise AND NOT is_citation AND NOT is_author
 GROUP BY ALL
), headed AS MATERIALIZED (
 SELECT k.doc_id, k.section_key, arg_max(b.content, k.section_seq) AS content, CAST(min(k.section_seq) AS INT) AS place
 FROM section_keys k JOIN section_bodies b USING (doc_id, section_seq) WHERE b.content <> '' GROUP BY ALL
), fallback_abstracts AS (
 SELECT doc_id, 'abstract' AS section_key, abstract AS content, 0 AS place FROM abstracts
 WHERE abstract <> '' AND doc_id NOT IN (SELECT doc_id FROM headed WHERE section_key = 'abstract')
), whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY order_index) AS raw_text FROM fb GROUP BY doc_id),
split_texts AS (
 SELECT doc_id, string_split(regexp_replace(raw_text, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM whole
), sentences AS (
 SELECT doc_id, i, {strip('parts[i]')} AS sentence FROM split_texts, unnest(range(1, len(parts) + 1)) u(i)
), keywords(place, section_key, word) AS (VALUES {_keyword_rows()}),
keyword_hits AS (
 SELECT DISTINCT s.doc_id, s.i, s.sentence, k.place, k.section_key
 FROM sentences s JOIN keywords k ON contains(lower(s.sentence), k.word)
), keyword_first AS (
 SELECT h.* FROM keyword_hits h ANTI JOIN headed d ON h.doc_id = d.doc_id AND h.section_key = d.section_key
 QUALIFY row_number() OVER (PARTITION BY h.doc_id, h.section_key ORDER BY h.i) <= {K.KEYWORD_SENTENCES}
), keyword_sections AS (
 SELECT doc_id, section_key, string_agg(sentence, ' ' ORDER BY i) AS content, place FROM keyword_first GROUP BY ALL
)"""

FIGURES = f"""
captions AS (
 SELECT doc_id, caption_order, any_value(head_id) AS figure_id, {clean("string_agg(text, ' ' ORDER BY order_index)")} AS caption,
        min(page_number) AS page_number, list(block_id ORDER BY order_index) AS caption_block_ids, min(text_pos) AS start_pos
 FROM an WHERE caption_order IS NOT NULL GROUP BY ALL
), mention_list AS (
 SELECT doc_id, order_index, block_id, text, caption_order,
   list_transform(regexp_extract_all(text, '(?i){START}fig(?:ure)?\\.?[{SPACE}]*(\\d+[A-Za-z]?){END}', 1), lambda x: upper(x)) AS found
 FROM an WHERE NOT is_noise
), mentions AS (
 SELECT DISTINCT doc_id, order_index, block_id, text, caption_order AS run, 'Figure ' || f AS figure_id
 FROM mention_list, unnest(found) u(f)
), refs AS (
 SELECT c.doc_id, c.caption_order, m.order_index AS rank, m.text, m.block_id
 FROM captions c JOIN mentions m ON c.doc_id = m.doc_id AND c.figure_id = m.figure_id
      AND m.run IS DISTINCT FROM c.caption_order
 QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.caption_order ORDER BY m.order_index) <= {K.FIGURE_REFERENCES}
), near AS (
 SELECT c.doc_id, c.caption_order, o.rank, a.text, a.block_id
 FROM captions c CROSS JOIN (VALUES (0, -2), (1, -1), (2, 1), (3, 2)) o(rank, d)
 JOIN an a ON a.doc_id = c.doc_id AND a.text_pos = c.start_pos + o.d
 WHERE a.caption_order IS DISTINCT FROM c.caption_order AND NOT a.is_noise AND length(a.text) >= {K.NEIGHBOUR_MIN_CHARS}
   AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = c.doc_id AND r.caption_order = c.caption_order)
 QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.caption_order ORDER BY o.rank) <= {K.NEIGHBOUR_REFERENCES}
), all_refs AS (SELECT * FROM refs UNION ALL SELECT * FROM near),
ref_lists AS (
 SELECT doc_id, caption_order, list(text ORDER BY rank) AS spans, list(block_id ORDER BY rank) AS ids FROM all_refs GROUP BY ALL
), figures AS MATERIALIZED (
 SELECT c.*, coalesce(r.spans, []::VARCHAR[]) AS spans, coalesce(r.ids, []::VARCHAR[]) AS ref_ids
 FROM captions c LEFT JOIN ref_lists r USING (doc_id, caption_order)
), figure_sections AS (
 SELECT doc_id, string_agg('### ' || figure_id || chr(10) || caption || chr(10) || chr(10) || {q(labels.text('body_references'))}
   || chr(10) || CASE WHEN len(spans) > 0 THEN array_to_string(list_transform(spans, lambda s: '- ' || s), chr(10))
                 ELSE {q('- ' + labels.text('missing'))} END, chr(10) || chr(10) ORDER BY caption_order) AS content
 FROM figures GROUP BY doc_id
)"""

ALL_SECTIONS = """
all_sections AS MATERIALIZED (
 SELECT doc_id, section_key, content, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, place) - 1 AS INT) AS position
 FROM (
  SELECT doc_id, 'title' AS section_key, title AS content, 'title' AS source, 0 AS g, 0 AS place FROM titles WHERE title <> ''
  UNION ALL SELECT doc_id, section_key, content, 'fallback_abstract', 1, place FROM fallback_abstracts
  UNION ALL SELECT doc_id, section_key, content, 'heading', 2, place FROM headed
  UNION ALL SELECT doc_id, section_key, content, 'fallback_keyword', 3, place FROM keyword_sections
  UNION ALL SELECT doc_id, 'figures', content, 'figures', 4, 0 FROM figure_sections)
)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


BLOCKS = with_ctes(SEEDED)
FB = with_ctes(SEEDED, FLAGGED)
FRONT = with_ctes(SEEDED, FLAGGED, TITLE)
SECT = with_ctes(SEEDED, FLAGGED, TITLE, SECTIONS)
FIG = with_ctes(SEEDED, FLAGGED, FIGURES)
FULL = with_ctes(SEEDED, FLAGGED, TITLE, DOI, SECTIONS, FIGURES, ALL_SECTIONS)


def joined(x: str, sep: str = " | ") -> str:
    return f"array_to_string({x}, {q(sep)})"


FIGURE_TEXT = "caption || CASE WHEN len(spans) > 0 THEN ' ' || array_to_string(spans, ' ') ELSE '' END"

ARTIFACTS = f"""
typed AS MATERIALIZED (
 SELECT *, lower({FIGURE_TEXT}) AS low, {FIGURE_TEXT} AS whole_text FROM figures
), artifacts AS MATERIALIZED (
 SELECT *, CASE {" ".join(f"WHEN {contains_any('low', ws)} THEN {q(n)}" for n, ws in K.FIGURE_TYPE_RULES)} ELSE 'unknown' END AS figure_type,
  list_filter([{", ".join(f"CASE WHEN regexp_matches(low, '{START}{w}{END}') THEN {q(w)} END" for w in K.METRIC_WORDS)}], lambda x: x IS NOT NULL)[1:4] AS axes,
  list_transform(regexp_extract_all(caption, '(?i)\\(([a-z])\\)', 1), lambda x: lower(x))[1:6] AS panel_labels,
  list_filter([trim(substring(caption, 1, 160), ''), substring({strip('spans[1]')}, 1, 160), substring({strip('spans[2]')}, 1, 160)], lambda x: x <> '') AS visible,
  list_filter(list_concat([CASE WHEN caption <> '' THEN {q(labels.text('evidence_caption'))} || substring(caption, 1, 120) END],
    list_transform(spans[1:2], lambda s: {q(labels.text('evidence_reference'))} || substring(s, 1, 120))), lambda x: x IS NOT NULL)[1:5] AS evidence,
  list_filter([{q(labels.text('uncertain_image'))}, CASE WHEN len(spans) = 0 THEN {q(labels.text('uncertain_reference'))} END], lambda x: x IS NOT NULL) AS uncertain
 FROM typed
), last_artifact AS (
 SELECT doc_id, figure_id, arg_max(figure_type, caption_order) AS figure_type, arg_max(axes, caption_order) AS axes,
        arg_max(evidence, caption_order) AS evidence, arg_max(uncertain, caption_order) AS uncertain
 FROM artifacts GROUP BY ALL
), compared AS (
 SELECT doc_id, caption_order, string_split(regexp_replace(whole_text,
   '({START})(?:vs|versus|compared with|against)({END})', '\\1' || chr(1) || '\\2', 'gi'), chr(1)) AS parts FROM typed
), evidence AS MATERIALIZED (
 SELECT f.doc_id, f.caption_order, {sanitize('f.figure_id', 40)} AS figure_id, {sanitize('f.caption', 120)} AS figure_title_or_caption,
  f.page_number, a.figure_type,
  CASE WHEN len(c.parts) > 1 THEN [{sanitize('c.parts[1]', 60)}, {sanitize('c.parts[-1]', 60)}] ELSE []::VARCHAR[] END AS compared_items,
  a.axes AS metrics_or_axes,
  list_filter(list_transform(list_concat([{q(labels.text('caption_summary'))} || {sanitize('f.caption', 120)}], a.evidence),
     lambda x: {sanitize('x', 200)}), lambda x: x <> '')[1:6] AS direct_evidence,
  list_filter(list_transform(f.spans, lambda x: {sanitize('x', 220)}), lambda x: x <> '')[1:4] AS referenced_text_spans,
  'noop' AS semantic_source, {q(labels.text('low'))} AS evidence_quality,
  list_transform(a.uncertain, lambda x: {sanitize('x', 160)})[1:6] AS uncertainties
 FROM figures f JOIN last_artifact a USING (doc_id, figure_id) JOIN compared c USING (doc_id, caption_order)
), analyses AS MATERIALIZED (
 SELECT doc_id, caption_order, figure_id,
  coalesce(nullif({sanitize('figure_title_or_caption', 80)}, ''), {q(labels.text('missing'))}) AS figure_title_or_caption,
  CASE WHEN figure_type = 'method_diagram' THEN {q(labels.text('focus_method'))}
       WHEN figure_type IN ('line_chart', 'bar_chart', 'result_figure') THEN {q(labels.text('focus_result'))}
       ELSE {q(labels.text('focus_other'))} END AS experiment_focus,
  compared_items[1:4] AS compared_items, metrics_or_axes[1:4] AS metrics_or_axes, direct_evidence[1:3] AS main_observations,
  {q(labels.text('insufficient'))} AS claimed_conclusion,
  CASE WHEN len(referenced_text_spans) > 0 THEN {q(labels.text('consistency_supported'))} ELSE {q(labels.text('consistency_unsupported'))} END
   || {q(labels.text('reason_no_model'))} AS consistency_check, evidence_quality AS confidence
 FROM evidence
)"""
ART = with_ctes(SEEDED, FLAGGED, FIGURES, ARTIFACTS)

JOBS = """
jobs_raw AS (
 SELECT user_id AS job_id, event_id, ts, props,
   CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'analyzing'
                   WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
   CASE WHEN event_type = 'error' THEN concat('error ', props) END AS error_message
 FROM events
), latest AS (
 SELECT * FROM jobs_raw QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1
)"""
JOB = with_ctes(JOBS)


def title_case(mapping_keys, x: str) -> str:
    return lookup(x, {k: k.replace("_", " ").title() for k in mapping_keys})


def keyword_sql(source: str, keyword: str, max_hits: int, window: int, key: str = "doc_id") -> str:
    needle = keyword.lower().strip()
    width = len(keyword)
    return f"""
 SELECT {key}, {q(keyword)} AS keyword, CAST(i AS INT) AS hit_no, CAST(pos AS INT) AS position,
  replace({strip(f"substring(t, CAST(greatest(pos - {window}, 0) AS INT) + 1, CAST(pos + {width + window} - greatest(pos - {window}, 0) AS INT))")}, chr(10), ' ') AS snippet
 FROM (SELECT {key}, t, i, length(array_to_string(parts[1:i], {q(needle)})) AS pos
       FROM (SELECT {key}, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t,
                    string_split(lower(regexp_replace(text, '\\r\\n?', chr(10), 'g')), {q(needle)}) AS parts FROM {source}),
            unnest(range(1, least(len(parts), {max_hits + 1}))) u(i))"""


FULL_TEXTS = "full_texts AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY order_index) AS text FROM blocks GROUP BY doc_id)"


def section_sql(name: str) -> str:
    known = ", ".join(q(h) for hs in K.TOOL_HEADINGS.values() for h in hs)
    accepted = ", ".join(q(h) for h in K.TOOL_HEADINGS[name])
    rule = rf"regexp_replace(regexp_replace(lower({strip('line')}), '^[0-9ivx]+[{SPACE}]*[.)][{SPACE}]*', ''), '[:\-]+$', '')"
    miss = (
        f"'prefix' AS status, {strip(f'substring(text, 1, {K.ABSTRACT_PREFIX_CHARS})')} AS content"
        if name == "abstract"
        else "'not_found' AS status, CAST(NULL AS VARCHAR) AS content"
    )
    return with_ctes(SEEDED, FULL_TEXTS) + f""",
 split_lines AS (SELECT doc_id, i, arr[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM full_texts),
                 unnest(range(1, len(arr) + 1)) u(i)),
 named AS (SELECT *, {rule} AS name FROM split_lines),
 spans AS (SELECT doc_id, i, name, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM named WHERE name IN ({known})),
 chosen AS (SELECT * FROM spans WHERE name IN ({accepted}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1),
 found AS (SELECT c.doc_id, substring({strip("string_agg(n.line, chr(10) ORDER BY n.i)")}, 1, {K.SECTION_CHARS}) AS content
           FROM chosen c JOIN named n ON n.doc_id = c.doc_id AND n.i >= c.i AND (c.stop IS NULL OR n.i < c.stop) GROUP BY c.doc_id)
 SELECT doc_id, 'found' AS status, content FROM found
 UNION ALL SELECT doc_id, {miss} FROM full_texts WHERE doc_id NOT IN (SELECT doc_id FROM found)"""


def _stage_rows() -> str:
    stages = labels.STAGE_LABELS["zh"]
    return ", ".join(f"({q(s)}, {q(stages[s][0])}, {K.JOB_STAGES[s][0]})" for s in K.JOB_STATUSES)


def _step_rows() -> str:
    names = labels.STEP_LABELS["zh"]
    return ", ".join(
        f"({q(s)}, {i + 1}, {q(k)}, {q(names[k])}, {q(K.JOB_STAGES[s][1][i])})"
        for s in K.JOB_STATUSES
        for i, k in enumerate(K.JOB_STEPS)
    )


ORACLES: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
    "clean_markup": f"SELECT page_id, {clean_title('html')} AS without_links, {sanitize('html')} AS sanitized FROM pages",
    "sanitize_turns": f"""SELECT conv_id, turn, {sanitize('text')} AS sanitized,
        array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sanitize('x', 120)}), lambda x: x <> '')[1:4], ' | ') AS first_lines
        FROM conversations""",
    "strip_markdown": rf"""SELECT doc_id, {strip(rf"regexp_replace(regexp_replace(regexp_replace({strip("'# ' || text")}, '(?m)^[{SPACE}]*#{{1,6}}[{SPACE}]*', '', 'g'), '(?m)^[{SPACE}]*[-*][{SPACE}]*', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")} AS plain
        FROM documents""",
    "infer_title": f"""SELECT doc_id, nullif(substring({strip(rf"regexp_extract(text, '[^{SPACE}][^\n\r]*')")}, 1, 200), '') AS title FROM documents""",
    "sentence_counts": rf"""SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?])[{SPACE}]+', '\1' || chr(1), 'g'), chr(1))) AS INT) AS sentences,
        CAST(len(string_split(text, chr(10))) AS INT) AS lines FROM documents""",
    "section_labels": FB + f""" SELECT text, heading_key AS canonical_key, {lookup('heading_key', labels.SECTION_LABELS['zh'])} AS label,
        {title_case(labels.SECTION_LABELS['zh'], 'heading_key')} AS title,
        regexp_replace(lower(text), '^[0-9ivx]+\\s*[.)]\\s*', '') AS tool_heading, count(*) AS n
        FROM fb WHERE heading_key IS NOT NULL GROUP BY text, heading_key""",
    "route_files": r"""SELECT page_id, CASE WHEN ends_with(lower(url), '.pdf') THEN 'pdf' ELSE 'plain_text' END AS route,
        CASE WHEN regexp_matches(url, '[^/.][^/]*\.[^./]+$') THEN lower(regexp_extract(url, '(\.[^./]+)$', 1)) ELSE '.txt' END AS suffix FROM pages""",
    "seeded_block_table": BLOCKS + " SELECT * FROM blocks",
    "block_flags": FB + """ SELECT doc_id, order_index, is_noise, is_citation, is_venue, is_author, heading_key, figure_id FROM fb""",
    "block_positions": FB + """ SELECT doc_id, order_index, text_pos, is_heading, CAST(section_seq AS BIGINT) AS section_seq, caption_order FROM an""",
    "titles": FRONT + " SELECT doc_id, title, title_block_ids FROM titles WHERE title <> ''",
    "authors": FRONT + " SELECT doc_id, authors FROM authors",
    "doi": with_ctes(SEEDED, FLAGGED, DOI) + " SELECT doc_id, doi, CAST(score AS INT) AS score FROM dois",
    "venue_year": FRONT + " SELECT doc_id, venue, year FROM venues FULL JOIN years USING (doc_id)",
    "fallback_abstract": SECT + " SELECT doc_id, content FROM fallback_abstracts",
    "sections": SECT + """ SELECT doc_id, section_key, content,
        CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INT) AS position FROM headed""",
    "keyword_fallback": SECT + " SELECT doc_id, section_key, content FROM keyword_sections",
    "noise": FB + f""" SELECT doc_id, string_agg(text, ' | ' ORDER BY order_index) AS discarded_noise FROM (
        SELECT * FROM fb WHERE is_noise QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY order_index) <= {K.NOISE_KEPT}) GROUP BY doc_id""",
    "document_sections": FULL + " SELECT doc_id, section_key, content, position, source FROM all_sections",
    "document_structure": FULL + f""", listed AS (
         SELECT doc_id, string_agg(section_key, ' | ' ORDER BY position) AS section_order,
                max(content) FILTER (WHERE section_key = 'abstract') AS abstract FROM all_sections GROUP BY doc_id),
        noise_list AS (SELECT doc_id, string_agg(text, ' | ' ORDER BY order_index) AS discarded_noise FROM (
         SELECT * FROM fb WHERE is_noise QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY order_index) <= {K.NOISE_KEPT}) GROUP BY doc_id),
        docs AS (SELECT doc_id, max(page_number) AS page_count FROM blocks GROUP BY doc_id),
        counted AS (SELECT doc_id, CAST(count(*) AS INT) AS n FROM figures GROUP BY doc_id)
        SELECT d.doc_id, nullif(t.title, '') AS title, coalesce(a.authors, '') AS authors, x.doi, v.venue, y.year, l.abstract,
         d.page_count, coalesce(c.n, 0) AS figure_count, coalesce(l.section_order, '') AS section_order,
         coalesce(n.discarded_noise, '') AS discarded_noise
        FROM docs d LEFT JOIN titles t USING (doc_id) LEFT JOIN authors a USING (doc_id) LEFT JOIN dois x USING (doc_id)
        LEFT JOIN venues v USING (doc_id) LEFT JOIN years y USING (doc_id) LEFT JOIN listed l USING (doc_id)
        LEFT JOIN counted c USING (doc_id) LEFT JOIN noise_list n USING (doc_id)""",
    "uncertainties": FULL + f""", docs AS (SELECT DISTINCT doc_id FROM blocks),
        has AS (SELECT DISTINCT doc_id, section_key FROM all_sections),
        checks(i, section_key, message) AS (VALUES (0, 'title', {q(labels.text('no_title'))}),
         {", ".join(f"({i + 1}, {q(s)}, {q(labels.text('no_section').format(s))})" for i, s in enumerate(K.EXPECTED_SECTIONS))},
         (9, 'figures', {q(labels.text('no_figure'))})),
        missed AS (SELECT d.doc_id, c.i, c.message FROM docs d CROSS JOIN checks c
         LEFT JOIN has h ON h.doc_id = d.doc_id AND h.section_key = c.section_key WHERE h.doc_id IS NULL)
        SELECT d.doc_id, coalesce(string_agg(m.message, ' | ' ORDER BY m.i), '') AS uncertainties
        FROM docs d LEFT JOIN missed m USING (doc_id) GROUP BY d.doc_id""",
    "raw_text": FULL + f""", parts AS (SELECT doc_id, {strip("string_agg(content, chr(10) || chr(10) ORDER BY position)")} AS raw_text
         FROM all_sections WHERE section_key NOT IN ('title', 'figures') GROUP BY doc_id)
        SELECT doc_id, coalesce(p.raw_text, {strip('w.raw_text')}) AS raw_text FROM whole w LEFT JOIN parts p USING (doc_id)""",
    "focus_text": FULL + f""", prio AS (SELECT *, CASE section_key {" ".join(f"WHEN {q(k)} THEN {i}" for i, k in enumerate(K.FOCUS_PRIORITY))} END AS p,
         '## ' || {title_case(K.FOCUS_PRIORITY + ['discussion', 'title'], 'section_key')} || chr(10) || {strip('content')} AS chunk FROM all_sections),
        chosen AS (SELECT * FROM prio a WHERE p IS NOT NULL OR NOT EXISTS (SELECT 1 FROM prio b WHERE b.doc_id = a.doc_id AND b.p IS NOT NULL)),
        summed AS (SELECT *, row_number() OVER w AS rn, sum(length(chunk)) OVER w AS used FROM chosen
         WINDOW w AS (PARTITION BY doc_id ORDER BY coalesce(p, 0), position)),
        folded AS (SELECT doc_id, string_agg(section_key, ' | ' ORDER BY rn) AS selected_sections,
         {strip(f"string_agg(chunk, chr(10) || chr(10) ORDER BY rn) FILTER (WHERE rn = 1 OR used <= {K.FOCUS_CHARS})")} AS focus_text FROM summed GROUP BY doc_id)
        SELECT w.doc_id, coalesce(f.focus_text, substring({strip('w.raw_text')}, 1, {K.FOCUS_CHARS})) AS focus_text,
         coalesce(f.selected_sections, '') AS selected_sections FROM whole w LEFT JOIN folded f USING (doc_id)""",
    "overlay_sections": SECT + f""", first_hits AS (SELECT * FROM keyword_hits QUALIFY row_number() OVER (PARTITION BY doc_id, section_key ORDER BY i) <= {K.KEYWORD_SENTENCES}),
        draft AS (SELECT doc_id, section_key, string_agg(sentence, ' ' ORDER BY i) AS content, place FROM first_hits GROUP BY ALL),
        merged AS (SELECT coalesce(d.doc_id, h.doc_id) AS doc_id, coalesce(d.section_key, h.section_key) AS section_key,
          coalesce(d.content, h.content) AS content, CASE WHEN d.doc_id IS NOT NULL THEN 0 ELSE 1 END AS age, coalesce(d.place, h.place) AS place
         FROM draft d FULL JOIN headed h ON d.doc_id = h.doc_id AND d.section_key = h.section_key)
        SELECT doc_id, section_key, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY
          CASE WHEN section_key = 'results' AND age = 0 THEN 0 ELSE 1 END, age, place) - 1 AS INT) AS position FROM merged""",
    "merged_metadata": FRONT + """, docs AS (SELECT DISTINCT doc_id FROM p1)
        SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN upper(nullif(t.title, '')) ELSE nullif(t.title, '') END AS title, lower(v.venue) AS venue, y.year
        FROM docs d LEFT JOIN titles t USING (doc_id) LEFT JOIN venues v USING (doc_id) LEFT JOIN years y USING (doc_id)""",
    "captions": FIG + f" SELECT doc_id, caption_order, figure_id, caption, page_number, {joined('caption_block_ids')} AS caption_block_ids FROM captions",
    "caption_blocks": FIG + " SELECT DISTINCT doc_id, caption_order, block_id FROM an WHERE caption_order IS NOT NULL",
    "figure_references": FIG + f" SELECT doc_id, caption_order, figure_id, {joined('ref_ids')} AS reference_block_ids, {joined('spans')} AS referenced_text_spans FROM figures",
    "figures_section": FIG + " SELECT doc_id, content FROM figure_sections",
    "figure_rank": FULL + f""", context AS (SELECT doc_id, lower(string_agg(content, chr(10))) AS low FROM all_sections
         WHERE section_key IN ('experimental_setup', 'results', 'conclusion') GROUP BY doc_id),
        scored AS (SELECT f.*, CAST(CASE WHEN contains(c.low, lower(f.figure_id)) THEN 2 ELSE 0 END + CASE WHEN len(f.spans) > 0 THEN 2 ELSE 0 END
          + CASE WHEN regexp_matches(f.caption, {q('(?i)' + K.RESULT_CAPTION_PATTERN)}) THEN 1 ELSE 0 END AS INT) AS score
         FROM figures f LEFT JOIN context c USING (doc_id))
        SELECT doc_id, caption_order, figure_id, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, caption_order) AS INT) AS rank
        FROM scored QUALIFY rank <= {K.FIGURES_SELECTED}""",
    "figure_artifacts": ART + f""" SELECT doc_id, caption_order, figure_id, page_number, figure_type, 'noop' AS extraction_source,
        {joined('visible')} AS visible_text, {joined('axes')} AS axes, {joined("list_transform(panel_labels, lambda x: figure_id || '_' || x)")} AS panels,
        {joined('evidence')} AS direct_evidence, {joined('uncertain')} AS uncertainties, {q(labels.text('low'))} AS confidence FROM artifacts""",
    "figure_evidence": ART + f""" SELECT doc_id, caption_order, figure_id, figure_title_or_caption, page_number, figure_type,
        {joined('compared_items')} AS compared_items, {joined('metrics_or_axes')} AS metrics_or_axes, {joined('direct_evidence')} AS direct_evidence,
        {joined('referenced_text_spans')} AS referenced_text_spans, semantic_source, evidence_quality, {joined('uncertainties')} AS uncertainties FROM evidence""",
    "figure_analyses": ART + f""" SELECT doc_id, caption_order, figure_id, figure_title_or_caption, experiment_focus, {joined('compared_items')} AS compared_items,
        {joined('metrics_or_axes')} AS metrics_or_axes, {joined('main_observations')} AS main_observations, claimed_conclusion, consistency_check, confidence FROM analyses""",
    "key_figures": FIG + f""", best AS (SELECT * FROM figures QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY
          CASE WHEN len(spans) > 0 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(caption, {q('(?i)' + K.RESULT_CAPTION_PATTERN)}) THEN 1 ELSE 0 END DESC, caption_order) = 1)
        SELECT doc_id, caption_order, figure_id, 0 AS origin FROM best
        UNION ALL SELECT f.doc_id, f.caption_order, f.figure_id, 1 FROM figures f
        WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = f.doc_id AND b.figure_id = f.figure_id)""",
    "corpus_rollup": with_ctes(SEEDED, FLAGGED, TITLE, DOI, SECTIONS, FIGURES, ALL_SECTIONS) + f""",
        docs AS (SELECT DISTINCT doc_id FROM blocks),
        checks(section_key, message) AS (VALUES ('title', {q(labels.text('no_title'))}),
         {", ".join(f"({q(s)}, {q(labels.text('no_section').format(s))})" for s in K.EXPECTED_SECTIONS)}, ('figures', {q(labels.text('no_figure'))})),
        typed AS (SELECT lower({FIGURE_TEXT}) AS low FROM figures)
        SELECT 'uncertainty' AS facet, message AS value, count(*) AS n FROM docs d CROSS JOIN checks c
         WHERE NOT EXISTS (SELECT 1 FROM all_sections s WHERE s.doc_id = d.doc_id AND s.section_key = c.section_key) GROUP BY message
        UNION ALL SELECT 'section', section_key, count(*) FROM all_sections GROUP BY section_key
        UNION ALL SELECT 'figure_type', CASE {" ".join(f"WHEN {contains_any('low', ws)} THEN {q(n)}" for n, ws in K.FIGURE_TYPE_RULES)} ELSE 'unknown' END, count(*) FROM typed GROUP BY 2""",
    "quality_rollup": SECT + """, per_doc AS (SELECT doc_id, count(*) AS n FROM headed GROUP BY doc_id)
        SELECT quality, toxic, count(*) AS documents, CAST(sum(coalesce(n, 0)) AS BIGINT) AS sections FROM labels LEFT JOIN per_doc USING (doc_id) GROUP BY quality, toxic""",
    "keyword_search": f"SELECT doc_id, hit_no, position, snippet FROM ({keyword_sql('documents', 'The ', K.SEARCH_HITS, K.SEARCH_WINDOW)})",
    "multi_keyword_search": " UNION ALL ".join(keyword_sql("documents", k, 3, 40) for k in ["tion", "license", "und", "e. A"]),
    "keyword_messages": f"""WITH turns AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations),
        hits AS (SELECT doc_id, string_agg('[Hit ' || hit_no || '] ...' || snippet || '...', chr(10) ORDER BY hit_no) AS message
          FROM ({keyword_sql('turns', 're.', K.SEARCH_HITS, K.SEARCH_WINDOW)}) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN message IS NULL THEN 'no_match' ELSE 'hit' END AS status, message FROM turns LEFT JOIN hits USING (doc_id)""",
    "extract_section": section_sql("introduction"),
    "extract_abstract": section_sql("abstract"),
    "job_latest": JOB + " SELECT job_id, event_id, status, error_message FROM latest",
    "job_transitions": JOB + f""", seq AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS from_status FROM jobs_raw)
        SELECT job_id, event_id, from_status, status AS to_status, coalesce(error_message, '') AS error_message,
         CASE WHEN from_status IS NULL THEN status = 'pending'
              ELSE (from_status, status) IN ({", ".join(f"({q(a)}, {q(b)})" for a, b in K.JOB_TRANSITIONS)}) END AS allowed FROM seq""",
    "job_submissions": JOB + """, marks AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS last FROM jobs_raw
         WHERE status IN ('pending', 'completed', 'failed'))
        SELECT job_id, event_id, last IS DISTINCT FROM 'pending' AS accepted FROM marks WHERE status = 'pending'""",
    "job_progress": JOB + f""", stages(status, stage, percent) AS (VALUES {_stage_rows()})
        SELECT job_id, status, stage AS current_stage, CAST(percent AS INT) AS progress_percent, rtrim(concat(status, ' ', props)) AS summary_message
        FROM latest JOIN stages USING (status)""",
    "job_steps": JOB + f""", steps(status, step_no, step, label, state) AS (VALUES {_step_rows()})
        SELECT job_id, status, CAST(step_no AS INT) AS step_no, step, label,
         CASE WHEN status = 'failed' AND step = 'parse' AND job_id % 2 <> 0 THEN 'pending' ELSE state END AS state FROM latest JOIN steps USING (status)""",
    "job_gate": JOB + " SELECT job_id, status, CASE WHEN status = 'completed' THEN NULL ELSE 'not_completed' END AS reason FROM latest",
    "log_tail": JOB + f""", kept AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS back FROM jobs_raw
          WHERE trim(concat(status, ' ', props)) <> '' QUALIFY back <= {K.LOG_TAIL_LINES})
        SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY back DESC) AS INT) AS line_no, rtrim(concat(status, ' ', props)) AS line FROM kept""",
    "stage_durations": JOB + """, seq AS (SELECT status, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) - epoch_us(ts) AS spent FROM jobs_raw)
        SELECT status, count(*) AS stays, CAST(sum(spent) AS BIGINT) AS total_micros, CAST(max(spent) AS BIGINT) AS longest_micros FROM seq WHERE spent IS NOT NULL GROUP BY status""",
    "status_counts": JOB + " SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, status, count(*) AS n FROM jobs_raw GROUP BY 1, 2",
}


def plain(x: str) -> str:
    """Text without heading marks and bullets, or NULL."""
    x = strip(x)
    x = f"regexp_replace({x}, '(?m)^[{SPACE}]*#{{1,6}}[{SPACE}]*', '', 'g')"
    x = f"regexp_replace({x}, '(?m)^[{SPACE}]*[-*][{SPACE}]*', '', 'g')"
    return f"nullif({strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")}, '')"


MISSING = q(labels.text("missing"))
NL = "chr(10)"


def shown(x: str) -> str:
    return f"coalesce(nullif(CAST({x} AS VARCHAR), ''), {MISSING})"


REPLIES = """WITH replies AS (
 SELECT event_id AS doc_id, event_type AS kind, props, CASE event_type WHEN 'click' THEN '```json' || chr(10) || props || chr(10) || '```'
   WHEN 'view' THEN 'The answer is ' || props || ' as asked.' WHEN 'signup' THEN props || ' or so }'
   WHEN 'error' THEN 'no object here' ELSE props END AS raw FROM events
), found AS (
 SELECT doc_id, kind, coalesce(nullif(regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{.*\\})\\s*```', 1), ''),
   nullif(regexp_extract(raw, '(?s)\\{.*\\}'), '')) AS json FROM replies
), read AS (
 SELECT doc_id, kind, CASE WHEN json IS NOT NULL AND json_valid(json) THEN 'parsed' ELSE 'fallback' END AS status, json,
        CASE WHEN json_valid(json) THEN json_extract_string(json, '$.k') END AS k FROM found
)"""


def _parsed_lines() -> str:
    names = labels.report("parsed_fields")
    values = [
        shown("t.title"), shown("replace(a.authors, ' | ', ', ')"), shown("x.doi"), shown("v.venue"), shown("y.year"),
        shown("d.page_count"), "CAST(coalesce(c.n, 0) AS VARCHAR)",
    ]
    return f" || {NL} || ".join(f"{q(f'- **{n}：** ')} || {v}" for n, v in zip(names, values, strict=True))


def _parsed_figure() -> str:
    a, b, c, d = labels.report("figure_fields")
    refs = f"CASE WHEN len(spans) > 0 THEN array_to_string(list_transform(spans, lambda s: '- ' || s), {NL}) ELSE '- ' || {MISSING} END"
    parts = [
        "'### ' || figure_id", f"{q(f'- **{a}：** ')} || {shown('caption')}", f"{q(f'- **{b}：** ')} || page_number",
        q(f"- **{c}：** " + labels.text("not_provided")), q(f"- **{d}：**"), refs,
    ]
    return f"{NL} || " + f" || {NL} || ".join(parts)


DOC_JOINS = """docs d LEFT JOIN titles t USING (doc_id) LEFT JOIN authors a USING (doc_id) LEFT JOIN dois x USING (doc_id)
        LEFT JOIN venues v USING (doc_id) LEFT JOIN years y USING (doc_id)"""


def _fill(template: str, *values: str) -> str:
    parts = template.split("{}")
    out = [q(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        out += [value, q(rest)]
    return " || ".join(out)


def _research_sql() -> str:
    missing = labels.text("missing")
    basics = labels.report("research_basics")
    values = [
        f"coalesce({plain('t.title')}, {MISSING})", shown("replace(a.authors, ' | ', ', ')"),
        f"coalesce({plain('v.venue')}, {MISSING})", f"coalesce({plain('y.year')}, {MISSING})",
    ]
    head = f" || {NL} || ".join(f"{q(f'- {n}：')} || {v}" for n, v in zip(basics, values, strict=True))
    quote = q("\n".join(labels.report(k).replace("{}", missing) for k in ("summary_problem", "summary_method", "summary_results")))
    scenario = f"coalesce({_fill(labels.report('scenario_venue'), plain('v.venue'))}, {MISSING})"
    bodies = [
        head, quote, f"coalesce({plain('substring(o.abstract, 1, 220)')}, {plain('substring(o.introduction, 1, 220)')}, {MISSING})",
        MISSING, MISSING, MISSING, MISSING, MISSING, MISSING, shown("g.baselines"), MISSING, shown("g.key_figures"),
        shown("g.conclusions"), shown("g.checks"), MISSING, MISSING, MISSING, scenario, MISSING, MISSING,
    ]
    pieces, at = [q(labels.report("research_title"))], iter(bodies)
    for chapter, parts in labels.report("research_chapters"):
        if not parts:
            pieces.append(f"{q(f'## {chapter}')} || {NL} || {next(at)}")
        for i, part in enumerate(parts):
            lead = f"## {chapter}\n### {part}\n" if i == 0 else f"### {part}\n"
            pieces.append(f"{q(lead)} || {next(at)}")
    text = f" || {NL} || {NL} || ".join(pieces) + f" || {NL}"
    name = f"coalesce({plain('figure_id')}, {MISSING})"
    observed = plain("main_observations[1]")
    compared = f"array_to_string(list_filter(list_transform(compared_items, lambda x: {plain('x')}), lambda x: x IS NOT NULL), ', ')"
    lines = {
        "key_figures": _fill(labels.report("figure_line"), name, f"coalesce({plain('figure_title_or_caption')}, {MISSING})"),
        "baselines": f"CASE WHEN {compared} <> '' AND {observed} IS NOT NULL THEN {_fill(labels.report('baseline_line'), name, compared, observed)} END",
        "conclusions": _fill(labels.report("figure_line"), name, f"coalesce({plain('claimed_conclusion')}, {MISSING})"),
        "checks": _fill(labels.report("consistency_line"), name, f"coalesce({plain('consistency_check')}, {MISSING})", f"coalesce({plain('confidence')}, {MISSING})"),
    }
    folds = ", ".join(f"string_agg({line}, {NL} ORDER BY caption_order) AS {key}" for key, line in lines.items())
    return with_ctes(SEEDED, FLAGGED, TITLE, DOI, SECTIONS, FIGURES, ALL_SECTIONS, ARTIFACTS) + f""",
        docs AS (SELECT DISTINCT doc_id FROM blocks),
        figure_texts AS (SELECT doc_id, {folds} FROM analyses GROUP BY doc_id),
        openings AS (SELECT doc_id, max(content) FILTER (WHERE section_key = 'abstract') AS abstract,
          max(content) FILTER (WHERE section_key = 'introduction') AS introduction FROM all_sections GROUP BY doc_id)
        SELECT d.doc_id, {text} AS markdown_report FROM {DOC_JOINS} LEFT JOIN figure_texts g USING (doc_id) LEFT JOIN openings o USING (doc_id)"""


def _general_sql() -> str:
    heads = labels.report("general_chapters")
    names = labels.FIELD_LABELS["zh"]
    first = rf"nullif(substring({strip(rf"regexp_extract(text, '[^{SPACE}][^\n\r]*')")}, 1, 200), '')"
    bodies = [
        shown("source"), shown(first), f"array_to_string(list_transform(string_split(text, {NL}), lambda x: '- ' || x), {NL})",
        f"'- ' || {MISSING}",
        f"{q('### Source')} || {NL} || source || {NL} || {NL} || {q('### ' + names['metadata'])} || {NL} || {q('- **Lang：** ')} || lang || {NL} || {q('- **N Chars：** ')} || n_chars",
    ]
    chapters = [f"{q('## ' + h)} || {NL} || {b}" for h, b in zip(heads, bodies, strict=True)]
    return f"SELECT doc_id, '# 通用文本分析报告' || {NL} || {NL} || " + f" || {NL} || {NL} || ".join(chapters) + f" || {NL} AS markdown_report FROM documents"


def _reader_sql() -> str:
    from docstruct.operators.responses import GENERAL_TEXT as profile

    first = rf"nullif(substring({strip(rf"regexp_extract(text, '[^{SPACE}][^\n\r]*')")}, 1, 200), '')"
    headings = "\n".join(f"{i}. {h}" for i, h in enumerate(profile.headings, 1))
    rules = "\n".join(f"- {r}" for r in profile.reader_rules)
    parts = [
        f"'Take notes on the text titled: ' || coalesce({first}, {q(labels.text('untitled_document'))})", strip("text"),
        q(f"Use these headings:\n{headings}"), q(f"Rules:\n{rules}"),
    ]
    return "SELECT doc_id, 'reader' AS kind, " + f" || {NL} || {NL} || ".join(parts) + " AS prompt FROM documents"


FIRST_LINE = rf"nullif(substring({strip(rf"regexp_extract(text, '[^{SPACE}][^\n\r]*')")}, 1, 200), '')"

ORACLES |= {
    "reply_objects": REPLIES + " SELECT doc_id, kind, status, json, k FROM read",
    "reply_quality": REPLIES + " SELECT kind, status, count(*) AS n FROM read GROUP BY kind, status",
    "draft_replies": f"""SELECT doc_id, 'parsed' AS status, {sanitize('text', 300)} AS title, {sanitize('text', 5000)} AS abstract,
        source AS authors FROM documents""",
    "text_documents": f"""SELECT doc_id, {FIRST_LINE} AS title, CAST(length({strip('text')}) AS INT) AS n,
        substring({strip('text')}, 1, {K.FOCUS_CHARS}) AS focus_text, 'plain_text' AS parser_kind FROM documents""",
    "reader_prompts": _reader_sql(),
    "block_lines": BLOCKS + f""" SELECT doc_id, string_agg('- ' || block_id || ' | page=' || page_number || ' | type=text | text=' || {sanitize('text', 240)}, chr(10) ORDER BY order_index) AS block_lines
        FROM blocks GROUP BY doc_id""",
    "general_reports": _general_sql(),
    "parsed_markdown": FULL + f""", docs AS (SELECT doc_id, max(page_number) AS page_count FROM blocks GROUP BY doc_id),
        counted AS (SELECT doc_id, count(*) AS n, string_agg({_parsed_figure()}, {NL} ORDER BY caption_order) AS body FROM figures GROUP BY doc_id),
        listed AS (SELECT doc_id, string_agg({NL} || '## ' || {lookup('section_key', labels.SECTION_LABELS['zh'])} || {NL} || content, {NL} ORDER BY position) AS body
          FROM all_sections WHERE section_key NOT IN ('title', 'figures') GROUP BY doc_id)
        SELECT d.doc_id, {strip(f"concat_ws({NL}, {q(labels.report('parsed_title'))}, '', {q(labels.report('parsed_basics'))}, {_parsed_lines()}, CASE WHEN c.n > 0 THEN {NL} || {q(labels.report('parsed_figures'))} END, c.body, l.body)")} || {NL} AS markdown
        FROM {DOC_JOINS} LEFT JOIN counted c USING (doc_id) LEFT JOIN listed l USING (doc_id)""",
    "research_reports": _research_sql(),
    "json_reports": with_ctes(SEEDED, FLAGGED, TITLE, DOI, SECTIONS, FIGURES, ALL_SECTIONS) + f""",
        docs AS (SELECT DISTINCT doc_id FROM blocks),
        typed AS (SELECT doc_id, caption_order, lower({FIGURE_TEXT}) AS low,
          row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN len(spans) > 0 THEN 2 ELSE 0 END
            + CASE WHEN regexp_matches(caption, {q('(?i)' + K.RESULT_CAPTION_PATTERN)}) THEN 1 ELSE 0 END DESC, caption_order) AS rank FROM figures),
        drawn AS (SELECT doc_id, string_agg(CASE {" ".join(f"WHEN {contains_any('low', ws)} THEN {q(n)}" for n, ws in K.FIGURE_TYPE_RULES)} ELSE 'unknown' END,
          ' | ' ORDER BY caption_order) AS figure_types, CAST(count(*) AS INT) AS n FROM typed WHERE rank <= {K.FIGURES_SELECTED} GROUP BY doc_id),
        counted AS (SELECT doc_id, CAST(count(*) AS INT) AS n FROM figures GROUP BY doc_id),
        prio AS (SELECT *, CASE section_key {" ".join(f"WHEN {q(k)} THEN {i}" for i, k in enumerate(K.FOCUS_PRIORITY))} END AS p FROM all_sections),
        chosen AS (SELECT * FROM prio a WHERE p IS NOT NULL OR NOT EXISTS (SELECT 1 FROM prio b WHERE b.doc_id = a.doc_id AND b.p IS NOT NULL)),
        selected AS (SELECT doc_id, string_agg(section_key, ' | ' ORDER BY coalesce(p, 0), position) AS keys FROM chosen GROUP BY doc_id),
        listed AS (SELECT doc_id, string_agg(section_key, ' | ' ORDER BY position) AS keys FROM all_sections GROUP BY doc_id)
        SELECT d.doc_id, nullif(t.title, '') AS title, coalesce(a.authors, '') AS authors, coalesce(g.figure_types, '') AS figure_types,
         coalesce(g.n, 0) AS n_evidence, coalesce(g.n, 0) AS n_analyses, coalesce(s.keys, '') AS selected_sections,
         coalesce(l.keys, '') AS section_order, coalesce(c.n, 0) AS figure_count
        FROM {DOC_JOINS} LEFT JOIN drawn g USING (doc_id) LEFT JOIN counted c USING (doc_id)
        LEFT JOIN selected s USING (doc_id) LEFT JOIN listed l USING (doc_id)""",
    "payload_metadata": """WITH d AS (SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS t, text, CAST(to_json(source) AS VARCHAR) AS s,
          CAST(to_json(lang) AS VARCHAR) AS l, CAST(n_chars AS VARCHAR) AS n FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 2 = 0
          THEN '{"doi":"10.1","keywords":[' || s || ',' || l || '],"say \\"n\\"":' || n || ',"title":' || t || ',"authors":[' || s || '],"venue":' || l || ',"year":"' || n || '"}'
          ELSE '{"authors":[' || s || '],"title":' || t || ',"year":"' || n || '","venue":' || l || '}' END AS metadata FROM d""",
    "paper_payloads": f"""WITH joined AS (SELECT *, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), ' ') AS all_lines FROM documents)
        SELECT doc_id, TRUE AS looks_like_paper, FALSE AS is_valid, all_lines AS title, source AS authors, CAST(n_chars AS VARCHAR) AS year, '' AS core_method,
         lang AS novelty, lang AS strengths, source AS limitations, all_lines AS reproducibility FROM joined""",
    "parsed_documents": FULL + f""", docs AS (SELECT doc_id, max(page_number) AS page_count FROM blocks GROUP BY doc_id),
        parts AS (SELECT doc_id, {strip("string_agg(content, chr(10) || chr(10) ORDER BY position)")} AS raw_text
         FROM all_sections WHERE section_key NOT IN ('title', 'figures') GROUP BY doc_id),
        listed AS (SELECT doc_id, string_agg(section_key || '=' || length(content), ' | ' ORDER BY position) AS sections FROM all_sections GROUP BY doc_id),
        drawn AS (SELECT doc_id, string_agg(figure_id, ' | ' ORDER BY caption_order) AS figures FROM figures GROUP BY doc_id)
        SELECT d.doc_id, nullif(t.title, '') AS title, coalesce(p.raw_text, {strip('w.raw_text')}) AS raw_text, coalesce(l.sections, '') AS sections,
         coalesce(g.figures, '') AS figures, d.page_count, x.doi
        FROM docs d LEFT JOIN titles t USING (doc_id) LEFT JOIN whole w USING (doc_id) LEFT JOIN parts p USING (doc_id)
        LEFT JOIN listed l USING (doc_id) LEFT JOIN drawn g USING (doc_id) LEFT JOIN dois x USING (doc_id)""",
    "stamped_logs": JOB + """ SELECT job_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') || ' ' || status || ' ' || props AS line,
        'analysis_' || strftime(ts, '%Y%m%d_%H%M%S') AS file_name FROM jobs_raw""",
    "job_tracking_stream": JOB + f""", seq AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS from_status FROM jobs_raw),
        marks AS (SELECT event_id, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS last FROM jobs_raw WHERE status IN ('pending', 'completed', 'failed'))
        SELECT job_id, s.event_id, from_status, status AS to_status, CASE WHEN status = 'pending' THEN m.last IS DISTINCT FROM 'pending' END AS accepted,
         CASE WHEN from_status IS NULL THEN status = 'pending'
              ELSE (from_status, status) IN ({", ".join(f"({q(a)}, {q(b)})" for a, b in K.JOB_TRANSITIONS)}) END AS allowed
        FROM seq s LEFT JOIN marks m ON s.event_id = m.event_id""",
    "job_store_stream": JOB + " SELECT job_id, event_id, status, error_message FROM latest",
}


# --- mixed corpora: drafts, replies and results over blocks and plain texts ---------------------------------

START_90 = f"coalesce(nullif({sanitize('text', 90)}, ''), 'none')"
#: The outcome of the replies of a document, by the last digit of its id (plus 1 for evidence, plus 2 for analyses).
OUTCOME = "CASE WHEN {} IN (0, 1, 5, 6) THEN 'good' WHEN {} IN (4, 9) THEN 'empty' WHEN {} IN (2, 7) THEN 'unreadable' ELSE 'none' END"


def _outcome(digit: str) -> str:
    return OUTCOME.replace("{}", f"({digit}) % 10")


MIXED = f"""
d AS MATERIALIZED (
 SELECT doc_id, source, lang, text, {START_90} AS start_text, doc_id % 3 = 2 AS is_text, doc_id % 10 AS digit,
  {_outcome('doc_id')} AS artifact_reply, {_outcome('doc_id + 1')} AS evidence_reply, {_outcome('doc_id + 2')} AS analysis_reply
 FROM documents
), block_docs AS (SELECT DISTINCT d.* FROM d JOIN blocks USING (doc_id) WHERE NOT is_text),
mixed_docs AS MATERIALIZED (
 SELECT b.doc_id, 'pdf' AS parser_kind,
  CASE WHEN digit IN (0, 5, 6) THEN 'Draft ' || b.doc_id WHEN digit = 9 THEN '7' ELSE nullif(t.title, '') END AS title,
  CASE WHEN digit IN (0, 5, 6) THEN source || ' | B. Author' WHEN digit = 9 THEN source ELSE coalesce(a.authors, '') END AS authors,
  x.doi, nullif(v.venue, '') AS venue, CASE WHEN digit IN (0, 5, 6) THEN '1999' WHEN digit = 9 THEN '2001' ELSE y.year END AS year
 FROM block_docs b LEFT JOIN titles t USING (doc_id) LEFT JOIN authors a USING (doc_id) LEFT JOIN dois x USING (doc_id)
  LEFT JOIN venues v USING (doc_id) LEFT JOIN years y USING (doc_id)
 UNION ALL SELECT doc_id, 'plain_text', {FIRST_LINE}, '', NULL, NULL, NULL FROM d WHERE is_text
), mixed_figures AS MATERIALIZED (
 SELECT f.doc_id, f.caption_order, f.figure_id, f.caption, f.page_number, f.spans
 FROM figures f JOIN block_docs b USING (doc_id) WHERE b.digit <> 1
 UNION ALL SELECT doc_id, CAST(n AS INT), 'Figure 9', 'Accuracy of ' || source, 3, ['see ' || doc_id] FROM block_docs, range(2) r(n) WHERE digit = 1
), drawn AS (
 SELECT doc_id, string_agg('### ' || figure_id || chr(10) || caption || chr(10) || chr(10) || {q(labels.text('body_references'))}
   || chr(10) || CASE WHEN len(spans) > 0 THEN array_to_string(list_transform(spans, lambda s: '- ' || s), chr(10))
                 ELSE {q('- ' + labels.text('missing'))} END, chr(10) || chr(10) ORDER BY caption_order) AS content
 FROM mixed_figures GROUP BY doc_id
), drafted AS (
 SELECT doc_id, 'method' AS section_key, start_text AS content, 0 AS at, NULL AS named FROM block_docs WHERE digit IN (0, 5, 6)
 UNION ALL SELECT doc_id, 'notes', 'notes of ' || doc_id, 1, 0 FROM block_docs WHERE digit IN (0, 5, 6)
 UNION ALL SELECT doc_id, 'figures', 'not kept', 2, 2 FROM block_docs WHERE digit IN (0, 5, 6) AND doc_id NOT IN (SELECT doc_id FROM drawn)
 UNION ALL SELECT doc_id, 'abstract', start_text, 0, NULL FROM block_docs WHERE digit = 1
 UNION ALL SELECT doc_id, 'closing', 'end of ' || doc_id, 1, NULL FROM block_docs WHERE digit = 1
), overlaid AS (
 SELECT coalesce(s.doc_id, r.doc_id) AS doc_id, coalesce(s.section_key, r.section_key) AS section_key, coalesce(r.content, s.content) AS content,
  CASE WHEN s.doc_id IS NULL THEN 1 ELSE 0 END AS fresh, coalesce(s.position, r.at) AS place
 FROM (SELECT s.* FROM all_sections s JOIN block_docs USING (doc_id) WHERE section_key NOT IN ('title', 'figures')) s
 FULL JOIN drafted r ON s.doc_id = r.doc_id AND s.section_key = r.section_key
 UNION ALL SELECT doc_id, 'figures', content, 2, 0 FROM drawn
), mixed_sections AS MATERIALIZED (
 SELECT doc_id, section_key, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY titled, named NULLS LAST, fresh, place) - 1 AS INT) AS position FROM (
  SELECT doc_id, 'title' AS section_key, title AS content, 0 AS titled, NULL AS named, 0 AS fresh, 0 AS place FROM mixed_docs WHERE parser_kind = 'pdf' AND title IS NOT NULL
  UNION ALL SELECT o.doc_id, section_key, content, 1, CASE WHEN b.digit IN (0, 5, 6) THEN CASE section_key WHEN 'notes' THEN 0 WHEN 'results' THEN 1 WHEN 'figures' THEN 2 END END, fresh, place
   FROM overlaid o JOIN block_docs b USING (doc_id))
), mixed_raw AS (
 SELECT doc_id, coalesce(p.raw, {strip('w.raw_text')}) AS raw_text FROM block_docs b JOIN whole w USING (doc_id) LEFT JOIN (
  SELECT doc_id, {strip("string_agg(content, chr(10) || chr(10) ORDER BY position)")} AS raw FROM mixed_sections
  WHERE section_key NOT IN ('title', 'figures') GROUP BY doc_id) p USING (doc_id)
 UNION ALL SELECT doc_id, {strip('text')} FROM d WHERE is_text
), chosen_figures AS MATERIALIZED (
 SELECT * FROM mixed_figures QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN len(spans) > 0 THEN 2 ELSE 0 END
   + CASE WHEN regexp_matches(caption, {q('(?i)' + K.RESULT_CAPTION_PATTERN)}) THEN 1 ELSE 0 END DESC, caption_order) <= {K.FIGURES_SELECTED}
), drawn_docs AS (SELECT DISTINCT d.* FROM d JOIN chosen_figures USING (doc_id))"""

_RULES, _REST = ARTIFACTS.replace("FROM figures", "FROM chosen_figures").split("), last_artifact AS")
_COMPARED = _REST[_REST.index("compared AS") : _REST.index("), evidence AS")]
_ANALYSED = _REST[_REST.index("SELECT doc_id, caption_order, figure_id,\n  coalesce(nullif") : _REST.index(" FROM evidence\n")]
_EMPTY = "[]::VARCHAR[]"

MIXED_FIGURES = f"""{_RULES}), mixed_artifacts AS MATERIALIZED (
 SELECT doc_id, caption_order, {sanitize('figure_id', 40)} AS figure_id, figure_type, axes, list_transform(evidence, lambda x: {sanitize('x', 200)}) AS evidence,
  list_transform(uncertain, lambda x: {sanitize('x', 160)}) AS uncertain, {q(labels.text('low'))} AS confidence, 'noop' AS origin
 FROM artifacts WHERE doc_id NOT IN (SELECT doc_id FROM drawn_docs WHERE artifact_reply = 'good')
 UNION ALL SELECT doc_id, 0, 'Figure 1', 'bar_chart', [lang], ['bars of ' || doc_id], {_EMPTY}, 'high', '' FROM drawn_docs WHERE artifact_reply = 'good'
), last_artifact AS (
 SELECT doc_id, figure_id, arg_max(struct_pack(t := figure_type, a := axes, e := evidence, u := uncertain, c := confidence, o := origin), caption_order) AS s
 FROM mixed_artifacts GROUP BY ALL
), {_COMPARED}), mixed_evidence AS MATERIALIZED (
 SELECT f.doc_id, f.caption_order, {sanitize('f.figure_id', 40)} AS figure_id, {sanitize('f.caption', 120)} AS figure_title_or_caption, f.page_number,
  coalesce(s.t, 'unknown') AS figure_type,
  CASE WHEN len(c.parts) > 1 THEN [{sanitize('c.parts[1]', 60)}, {sanitize('c.parts[-1]', 60)}] ELSE {_EMPTY} END AS compared_items,
  coalesce(s.a, {_EMPTY}) AS metrics_or_axes,
  list_filter(list_transform(list_concat([{q(labels.text('caption_summary'))} || {sanitize('f.caption', 120)}], coalesce(s.e, {_EMPTY})),
     lambda x: {sanitize('x', 200)}), lambda x: x <> '')[1:6] AS direct_evidence,
  list_filter(list_transform(f.spans, lambda x: {sanitize('x', 220)}), lambda x: x <> '')[1:4] AS referenced_text_spans,
  coalesce(s.c, {q(labels.text('low'))}) AS evidence_quality
 FROM chosen_figures f LEFT JOIN last_artifact a USING (doc_id, figure_id) JOIN compared c USING (doc_id, caption_order)
 WHERE f.doc_id NOT IN (SELECT doc_id FROM drawn_docs WHERE evidence_reply = 'good')
 UNION ALL SELECT doc_id, 0, 'Figure 1', '', NULL, 'bar_chart', {_EMPTY}, {_EMPTY}, ['bars of ' || doc_id], {_EMPTY}, {q(labels.text('insufficient'))}
 FROM drawn_docs WHERE evidence_reply = 'good'
), mixed_analyses AS MATERIALIZED (
 SELECT * EXCLUDE (reply, supported) REPLACE (CASE WHEN supported THEN {q(labels.text('consistency_supported'))} ELSE {q(labels.text('consistency_unsupported'))} END
   || CASE WHEN reply = 'unreadable' THEN {q(labels.text('reason_unparsable'))} ELSE {q(labels.text('reason_no_model'))} END AS consistency_check)
 FROM (
  {_ANALYSED}, len(referenced_text_spans) > 0 AS supported, (SELECT analysis_reply FROM d WHERE d.doc_id = mixed_evidence.doc_id) AS reply FROM mixed_evidence)
 WHERE reply IN ('unreadable', 'none')
 UNION ALL SELECT doc_id, 0, 'Figure 1', {sanitize('start_text', 120)}, '', [source, lang], {_EMPTY}, ['seen in ' || doc_id], 'concluded ' || doc_id, '',
  {q(labels.text('insufficient'))} FROM drawn_docs WHERE analysis_reply = 'good' AND doc_id IN (SELECT doc_id FROM mixed_evidence)
)"""
MIXED_ALL = with_ctes(SEEDED, FLAGGED, TITLE, DOI, SECTIONS, FIGURES, ALL_SECTIONS, MIXED)
MIXED_FULL = MIXED_ALL + "," + MIXED_FIGURES


def _mixed_report() -> str:
    """The report of ``_research_sql`` with results: ``full`` payloads, summaries alone, or none."""

    def either(full: str, otherwise: str = MISSING) -> str:
        return f"CASE WHEN r.full THEN {full} ELSE {otherwise} END"

    def said(word: str) -> str:
        return either(f"'{word} ' || d.doc_id")

    basics = [
        f"coalesce({plain('d.title')}, {MISSING})", either("'C. Writer'", shown("replace(d.authors, ' | ', ', ')")),
        either("'Venue of results'", f"coalesce({plain('d.venue')}, {MISSING})"), f"coalesce({plain('d.year')}, {MISSING})",
    ]
    head = f" || {NL} || ".join(f"{q(f'- {n}：')} || {v}" for n, v in zip(labels.report("research_basics"), basics, strict=True))
    problem = f"CASE WHEN NOT r.full THEN {_fill(labels.report('summary_fallback'), 'r.summary')} ELSE {_fill(labels.report('summary_problem'), said('problem'))} END"
    quote = f" || {NL} || ".join([problem, _fill(labels.report("summary_method"), said("method")), _fill(labels.report("summary_results"), said("results"))])
    sets = "r.source || ', set B'"
    bodies = [
        head, quote,
        either("'point ' || d.doc_id", f"coalesce({plain('substring(o.abstract, 1, 220)')}, {plain('substring(o.introduction, 1, 220)')}, {MISSING})"),
        said("problem"), said("method"), either(f"'- point ' || d.doc_id || {NL} || '- second'"), said("novel"),
        either(f"'setup ' || d.doc_id || {NL} || {NL} || {_fill(labels.report('datasets_line'), sets)}"), said("results"), shown("g.baselines"),
        either("'results ' || d.doc_id", f"coalesce(r.summary, {MISSING})"), shown("g.key_figures"), shown("g.conclusions"), shown("g.checks"),
        either("'- strong'"), either("'- weak'"), either("'code is there'"),
        either(_fill(labels.report("scenario_datasets"), sets), f"coalesce({_fill(labels.report('scenario_venue'), plain('d.venue'))}, {MISSING})"),
        said("novel"), f"coalesce(r.summary, {MISSING})",
    ]
    pieces, at = [q(labels.report("research_title"))], iter(bodies)
    for chapter, parts in labels.report("research_chapters"):
        if not parts:
            pieces.append(f"{q(f'## {chapter}')} || {NL} || {next(at)}")
        for i, part in enumerate(parts):
            pieces.append(f"{q(f'## {chapter}\n### {part}\n' if i == 0 else f'### {part}\n')} || {next(at)}")
    return f" || {NL} || {NL} || ".join(pieces) + f" || {NL}"


def _mixed_sql() -> str:
    name = f"coalesce({plain('figure_id')}, {MISSING})"
    observed = plain("main_observations[1]")
    compared = f"array_to_string(list_filter(list_transform(compared_items, lambda x: {plain('x')}), lambda x: x IS NOT NULL), ', ')"
    lines = {
        "baselines": f"CASE WHEN {compared} <> '' AND {observed} IS NOT NULL THEN {_fill(labels.report('baseline_line'), name, compared, observed)} END",
        "conclusions": f"CASE WHEN claimed_conclusion <> '' THEN {_fill(labels.report('figure_line'), name, f'coalesce({plain("claimed_conclusion")}, {MISSING})')} END",
        "checks": _fill(labels.report("consistency_line"), name, f"coalesce({plain('consistency_check')}, {MISSING})", f"coalesce({plain('confidence')}, {MISSING})"),
    }
    folds = ", ".join(f"string_agg({line}, {NL} ORDER BY caption_order) AS {key}" for key, line in lines.items())
    key_line = _fill(labels.report("figure_line"), name, f"coalesce({plain('figure_title_or_caption')}, {MISSING})")
    return MIXED_FULL + f""",
        key_rows AS (SELECT doc_id, caption_order, figure_id, figure_title_or_caption, 0 AS origin FROM mixed_analyses
          UNION ALL SELECT doc_id, caption_order, figure_id, figure_title_or_caption, 1 FROM mixed_evidence e
          WHERE NOT EXISTS (SELECT 1 FROM mixed_analyses a WHERE a.doc_id = e.doc_id AND a.figure_id = e.figure_id)),
        figure_texts AS (SELECT * FROM (SELECT doc_id, string_agg({key_line}, {NL} ORDER BY origin, caption_order) AS key_figures FROM key_rows GROUP BY doc_id)
          LEFT JOIN (SELECT doc_id, {folds} FROM mixed_analyses GROUP BY doc_id) USING (doc_id)),
        openings AS (SELECT doc_id, max(content) FILTER (WHERE section_key = 'abstract') AS abstract,
          max(content) FILTER (WHERE section_key = 'introduction') AS introduction FROM mixed_sections GROUP BY doc_id),
        replied AS (SELECT doc_id, source, 'summary ' || doc_id AS summary, doc_id % 5 = 0 AS full FROM documents WHERE doc_id % 5 IN (0, 3)),
        prio AS (SELECT *, CASE section_key {" ".join(f"WHEN {q(k)} THEN {i}" for i, k in enumerate(K.FOCUS_PRIORITY))} END AS p FROM mixed_sections),
        chunked AS (SELECT *, '## ' || {title_case(K.FOCUS_PRIORITY + ['discussion', 'title', 'notes', 'closing'], 'section_key')} || chr(10) || {strip('content')} AS chunk FROM prio),
        focused AS (SELECT * FROM chunked a WHERE p IS NOT NULL OR NOT EXISTS (SELECT 1 FROM chunked b WHERE b.doc_id = a.doc_id AND b.p IS NOT NULL)),
        summed AS (SELECT *, row_number() OVER w AS rn, sum(length(chunk)) OVER w AS used FROM focused
         WINDOW w AS (PARTITION BY doc_id ORDER BY coalesce(p, 0), position)),
        folded AS (SELECT doc_id, string_agg(section_key, ' | ' ORDER BY rn) AS selected_sections,
         {strip(f"string_agg(chunk, chr(10) || chr(10) ORDER BY rn) FILTER (WHERE rn = 1 OR used <= {K.FOCUS_CHARS})")} AS focus_text FROM summed GROUP BY doc_id)
        SELECT d.doc_id, {_mixed_report()} AS markdown_report, coalesce(f.focus_text, substring(w.raw_text, 1, {K.FOCUS_CHARS}), '') AS focus_text,
         coalesce(f.selected_sections, '') AS selected_sections
        FROM mixed_docs d LEFT JOIN replied r USING (doc_id) LEFT JOIN openings o USING (doc_id) LEFT JOIN figure_texts g USING (doc_id)
         LEFT JOIN folded f USING (doc_id) LEFT JOIN mixed_raw w USING (doc_id)"""


ORACLES |= {
    "applied_drafts": MIXED_ALL + f""",
        texts AS (SELECT doc_id, string_agg(section_key, ' | ' ORDER BY position) AS section_order,
          string_agg(section_key || '=' || content, chr(10) ORDER BY position) AS sections FROM mixed_sections GROUP BY doc_id),
        pictures AS (SELECT doc_id, CAST(count(*) AS INT) AS n, string_agg(concat_ws('=', figure_id, caption, page_number, {joined('spans')}), chr(10) ORDER BY caption_order) AS figures
          FROM mixed_figures GROUP BY doc_id)
        SELECT doc_id, parser_kind, title, authors, doi, venue, year, coalesce(section_order, '') AS section_order, coalesce(n, 0) AS figure_count,
         coalesce(sections, '') AS sections, coalesce(figures, '') AS figures, raw_text
        FROM mixed_docs LEFT JOIN texts USING (doc_id) LEFT JOIN pictures USING (doc_id) LEFT JOIN mixed_raw USING (doc_id)""",
    "artifact_replies": MIXED_FULL + f"""
        SELECT doc_id, caption_order, figure_id, figure_type, {joined('axes')} AS axes, {joined('evidence')} AS direct_evidence, confidence, 'artifact' AS kind FROM mixed_artifacts
        UNION ALL SELECT doc_id, caption_order, figure_id, figure_type, {joined('metrics_or_axes')}, {joined('direct_evidence')}, evidence_quality, 'evidence' FROM mixed_evidence""",
    "analysis_replies": MIXED_FULL + f"""
        SELECT doc_id, caption_order, figure_id, figure_title_or_caption, experiment_focus, {joined('compared_items')} AS compared_items,
         {joined('metrics_or_axes')} AS metrics_or_axes, {joined('main_observations')} AS main_observations, claimed_conclusion, consistency_check, confidence FROM mixed_analyses""",
    "mixed_reports": _mixed_sql(),
}


# --- spans and images -----------------------------------------------------------------------------------------

_HALF, _QUARTER = "(length(text) // 2)", "(length(text) // 4)"
ASSEMBLED = SEEDED.replace("), blocks AS (\nSELECT", "), seeded AS (\nSELECT") + f""",
kept_texts AS (
 SELECT doc_id, page_number, order_index % 12 AS raw_index, {clean(f"substring(text, 1, {_HALF})")} AS one, {clean(f"substring(text, {_HALF} + 1)")} AS two, y0, max_size
 FROM seeded
), page_list AS (SELECT DISTINCT doc_id, page_number FROM seeded),
kept AS (
 SELECT doc_id, page_number, raw_index, 'text' AS block_type, concat_ws(' ', nullif(one, ''), nullif(two, '')) AS text, y0,
  CASE WHEN one <> '' THEN max_size ELSE max_size - 1 END AS max_size, NULL AS image_path FROM kept_texts WHERE one <> '' OR two <> ''
 UNION ALL SELECT doc_id, page_number, 13, 'image', '', 700, 0, 'img/' || doc_id || '_' || page_number || '_a.png' FROM page_list WHERE (doc_id + page_number) % 2 = 0
 UNION ALL SELECT doc_id, page_number, 14, 'image', '', 700, 0, 'img/' || doc_id || '_' || page_number || '_b.png' FROM page_list WHERE doc_id % 5 = 0
), blocks AS MATERIALIZED (
 SELECT doc_id, 'p' || page_number || '_b' || raw_index AS block_id, page_number,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, raw_index) - 1 AS INT) AS order_index, block_type, text,
  CAST(y0 AS DOUBLE) AS y0, CAST(max_size AS DOUBLE) AS max_size, image_path FROM kept
)"""
_IMAGE_RULES = ARTIFACTS.split("), last_artifact AS")[0].replace("FROM figures", "FROM pictured")

IMAGED = f"""
page_pictures AS (
 SELECT doc_id, page_number, list(image_path ORDER BY order_index)[1:{K.FIGURE_IMAGES}] AS paths FROM blocks WHERE block_type = 'image' GROUP BY ALL
), pictured AS MATERIALIZED (
 SELECT f.*, coalesce(p.paths, []::VARCHAR[]) AS paths,
  CASE WHEN f.page_number % 2 = 0 THEN 'pages/' || f.doc_id || '_' || f.page_number || '.png' END AS snapshot
 FROM figures f LEFT JOIN page_pictures p USING (doc_id, page_number)
),{_IMAGE_RULES}), noted AS MATERIALIZED (
 SELECT *, list_filter(list_concat([CASE WHEN caption <> '' THEN {q(labels.text('evidence_caption'))} || substring(caption, 1, 120) END],
   list_transform(spans[1:2], lambda s: {q(labels.text('evidence_reference'))} || substring(s, 1, 120)),
   [CASE WHEN len(paths) > 0 THEN {q(labels.text('evidence_image'))} WHEN snapshot IS NOT NULL THEN {q(labels.text('evidence_snapshot'))} END]),
   lambda x: x IS NOT NULL)[1:5] AS direct,
  list_filter([CASE WHEN len(paths) = 0 THEN {q(labels.text('uncertain_image'))} END, CASE WHEN len(spans) = 0 THEN {q(labels.text('uncertain_reference'))} END],
   lambda x: x IS NOT NULL) AS doubts,
  CASE WHEN len(paths) = 0 THEN {q(labels.text('low'))} ELSE {q(labels.text('mid'))} END AS sure FROM artifacts
), last_noted AS (
 SELECT doc_id, figure_id, arg_max(direct, caption_order) AS direct, arg_max(sure, caption_order) AS sure FROM noted GROUP BY ALL
)"""


def _cut_list(x: str, n: int, size: int) -> str:
    return f"list_filter(list_transform({x}, lambda x: {sanitize('x', size)}), lambda x: x <> '')[1:{n}]"


ORACLES |= {
    "assembled_blocks": with_ctes(ASSEMBLED) + " SELECT * FROM blocks",
    "page_counts": with_ctes(ASSEMBLED) + """ SELECT doc_id, CAST(max(page_number) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS INT) AS page_count,
        count(*) AS block_count FROM blocks GROUP BY doc_id""",
    "image_artifacts": with_ctes(ASSEMBLED, FLAGGED, FIGURES, IMAGED) + f"""
        SELECT n.doc_id, n.caption_order, n.figure_id, page_number, figure_type, 'noop' AS extraction_source, snapshot AS page_snapshot_path,
         {joined('paths')} AS image_block_paths, paths[1] AS crop_path, {joined(_cut_list('visible', 6, 160))} AS visible_text, {joined('axes')} AS axes,
         {joined('panel_labels')} AS panels, {joined(_cut_list('n.direct', 6, 200))} AS direct_evidence, {joined('doubts')} AS uncertainties, n.sure AS confidence,
         l.sure AS evidence_quality,
         {joined(_cut_list(f"list_concat([{q(labels.text('caption_summary'))} || {sanitize('caption', 120)}], {_cut_list('l.direct', 6, 200)})", 6, 200))} AS evidence
        FROM noted n JOIN last_noted l USING (doc_id, figure_id)""",
}

ORACLES["ingested_structure"] = ORACLES["document_structure"]
