"""SQL pieces the checks share: the derived inputs, written for DuckDB."""

from __future__ import annotations

from sheafline.plans.views import CRITERIA, _RULES

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]"


def norm(x: str) -> str:
    squeezed = f"regexp_replace(lower({x}), '{WS}{{2,}}|[\\r\\n\\t]', ' ', 'g')"
    return f"coalesce(regexp_replace({squeezed}, '^{WS}+|{WS}+$', '', 'g'), '')"


def word_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def fold(x: str) -> str:
    """DuckDB's upper() leaves the sharp s as it is."""
    return f"lower(upper(replace({x}, 'ß', 'ss')))"


def bare(x: str) -> str:
    return f"regexp_replace({x}, '^[\\pP\\pS]+|[\\pP\\pS]+$', '', 'g')"


def bare_words(x: str) -> str:
    """Case-folded words without marks at their ends."""
    each = f"list_transform({word_list(fold(x))}, lambda w: {bare('w')})"
    return f"list_filter({each}, lambda w: w <> '')"


def placed_words(rows: str, key: str) -> str:
    """CTE ``placed``: ({key}, k, word, shape, folded, start, "end") of each word of ``text``, without the
    marks at its ends; k counts from 1."""
    mark = "'^[\\pP\\pS]+'"
    return f"""
raw_words AS (
  SELECT {key}, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS w, unnest(g[1 : len(w)]) AS g
  FROM (SELECT {key}, {word_list('text')} AS w, regexp_split_to_array(text, '[^{WS[1:-1]}]+') AS g
        FROM {rows})),
raw_places AS (
  SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY {key} ORDER BY place) - length(w)
            + length(regexp_extract(w, {mark})) AS start, {bare('w')} AS word
  FROM raw_words),
placed AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY place) AS k, word, {shape('word')} AS shape,
         {fold('word')} AS folded, start::BIGINT AS start, (start + length(word))::BIGINT AS "end"
  FROM raw_places WHERE word <> '')"""


def shape(x: str) -> str:
    x = f"regexp_replace({x}, '\\p{{N}}+', '9', 'g')"
    x = f"regexp_replace({x}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]+', 'a', 'g')"
    return f"regexp_replace({x}, '\\p{{Lu}}+', 'A', 'g')"


def sentence_list(x: str) -> str:
    """RE2 has no look-behind: mark every candidate, unmark the exceptions."""
    marked = f"regexp_replace({x}, '([.?!])(\\s+)', '\\1' || chr(2) || '\\2', 'g')"
    unmarked = f"regexp_replace({marked}, '([A-Z]\\.[A-Z]\\.)' || chr(2), '\\1', 'g')"
    unmarked = f"regexp_replace({unmarked}, '([A-Z][a-z]\\.)' || chr(2), '\\1', 'g')"
    return f"string_split(regexp_replace({unmarked}, chr(2) || '\\s+', chr(3), 'g'), chr(3))"


def form(x: str) -> str:
    x = f"regexp_replace({x}, '\\p{{N}}', '9', 'g')"
    x = f"regexp_replace({x}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]', 'a', 'g')"
    return f"regexp_replace({x}, '\\p{{Lu}}', 'A', 'g')"


def _elements(*tags: str) -> str:
    return "|".join(f"<{t}\\b[^>]*>.*?(?:</{t}\\s*>|\\z)" for t in tags)


def no_scripts(h: str) -> str:
    gone = _elements("script", "style", "noscript", "template")
    return f"regexp_replace({h}, '(?is)<!--.*?(?:-->|\\z)|{gone}', '', 'g')"


def selected(h: str) -> str:
    inside = f"regexp_extract_all({no_scripts(h)}, '(?is)<article\\b[^>]*>(.*?)(?:</article\\s*>|\\z)', 1)"
    return (
        f"regexp_replace(array_to_string({inside}, '<br>'), "
        f"'(?is){_elements('nav', 'footer', 'form', 'aside')}', '', 'g')"
    )


def body(h: str) -> str:
    return f"regexp_replace({no_scripts(h)}, '(?is){_elements('head')}', '', 'g')"


def unescape(x: str) -> str:
    for ref, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{char}')"
    return x


_BREAKS = (
    "(?i)</?(?:p|div|section|article|main|ul|ol|table|tr|blockquote|pre)\\b[^>]*>"
    "|</(?:h[1-6]|li|td|th)\\s*>|<(?:br|hr|h[4-6])\\b[^>]*>"
)


def to_blocks(x: str) -> str:
    x = f"regexp_replace({x}, '[ \\t\\r\\n\\f]+', ' ', 'g')"
    for n in (1, 2, 3):
        x = f"regexp_replace({x}, '(?i)<h{n}\\b[^>]*>', chr(10) || '{'#' * n} ', 'g')"
    x = f"regexp_replace({x}, '{_BREAKS}', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    x = f"regexp_replace({x}, ' *\\n[ \\n]*', chr(10), 'g')"
    return unescape(f"regexp_replace({x}, '^[ \\n]+|[ \\n]+$', '', 'g')")


def to_flat(x: str) -> str:
    x = f"regexp_replace({x}, '{_BREAKS}|<h[1-3]\\b[^>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    return unescape(f"trim(regexp_replace({x}, '[ \\t\\r\\n\\f]+', ' ', 'g'))")


def page_text(h: str) -> str:
    return f"coalesce(nullif({to_blocks(selected(h))}, ''), {to_blocks(body(h))})"


def origin(u: str) -> str:
    return f"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"


def tail(u: str) -> str:
    rest = f"regexp_replace({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*', '')"
    return f"coalesce(nullif({rest}, ''), '/')"


SEARCH_RESULTS = r"""
search_results AS (
  SELECT regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) || ' '
         || regexp_extract(url, '^[a-z]+://([^.]*)\.', 1) AS query,
         'p' || (page_id % 4) AS provider,
         page_id % 4 AS provider_order,
         page_id // 4 + 1 AS rank,
         regexp_extract(url, '^([a-z]+://[^/]*/[^/?#]*)', 1) AS url
  FROM pages)"""

ROBOTS = f"""
robots_status AS (
  SELECT o AS origin,
         CASE length(o) % 10 WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 503
              WHEN 3 THEN NULL ELSE 200 END AS status
  FROM (SELECT DISTINCT {origin('url')} AS o FROM pages)),
robots_rules AS (
  SELECT origin, agent, position, allow OR path = '' AS allow, path
  FROM robots_status,
       (VALUES {', '.join(f"('{a}', {p}, {str(ok).lower()}, '{path}')" for a, p, ok, path in _RULES)})
         AS v(agent, position, allow, path)
  WHERE status = 200 AND (agent <> 'HarvestBot' OR length(origin) % 2 = 0)),
robots_group AS (
  SELECT origin, max(lower(agent)) AS grp FROM robots_rules
  WHERE agent IN ('*', 'HarvestBot') GROUP BY origin),
bound AS (
  SELECT r.* FROM robots_rules r JOIN robots_group g
    ON r.origin = g.origin AND lower(r.agent) = g.grp)"""


def allowed(rows: str, url: str = "url", key: str = "url") -> str:
    """CTE ``decided``: (key, allowed) for the distinct urls of ``rows``."""
    return f"""
decided AS (
  SELECT u.u AS {key},
         CASE WHEN any_value(s.status) IN (401, 403) THEN false
              WHEN any_value(s.status) BETWEEN 400 AND 499 THEN true
              WHEN any_value(s.status) >= 500 THEN false
              ELSE coalesce(arg_min(b.allow, b.position), true) END AS allowed
  FROM (SELECT DISTINCT {url} AS u FROM {rows}) u
  LEFT JOIN robots_status s ON s.origin = {origin('u.u')}
  LEFT JOIN bound b ON b.origin = {origin('u.u')} AND starts_with({tail('u.u')}, b.path)
  GROUP BY u.u)"""


EVENT_LOG = """
event_log AS (
  SELECT event_id + 1 AS id, event_type AS topic, props AS payload, ts AS created_at
  FROM events)"""

OFFSETS = """
consumer_offsets AS (
  SELECT 'reader_' || topic AS consumer, max(id) AS last_id FROM event_log
  WHERE topic <> 'view' AND created_at < TIMESTAMP '2024-01-20 00:00:00' GROUP BY topic),
readers AS (SELECT DISTINCT 'reader_' || topic AS consumer, topic FROM event_log)"""

RUN_AUDIT = """
run_audit AS (
  SELECT 'plan-' || (user_id % 3) AS plan_id, 'default' AS branch_id,
         CAST(user_id AS VARCHAR) AS run_id, 'n' || (event_id % 5) AS node_id,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running'
              WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed'
              ELSE 'unknown' END AS status,
         CASE WHEN event_type = 'error' THEN props END AS error, ts AS "at"
  FROM events)"""

STEPS = """
steps AS (
  SELECT o_orderkey // 8 || '-' || (o_orderkey % 8 + 1) AS id,
         'tool-' || o_custkey AS tool_name, o_orderkey // 8 AS plan,
         o_orderkey % 8 + 1 AS line, o_orderstatus AS flag
  FROM orders),
edges AS (
  SELECT plan || '-' || (line // 2) AS src, id AS dst, line FROM steps WHERE line > 1
  UNION ALL
  SELECT plan || '-' || (line - 1), id, line FROM steps WHERE line > 1 AND flag = 'F'),
stray AS (SELECT plan || '-x' AS src, id AS dst FROM steps WHERE plan % 11 = 0)"""

METRICS = """
per_user AS (
  SELECT user_id, CAST(count(*) AS DOUBLE) AS events,
         count(*) FILTER (event_type = 'error') / count(*) AS error_rate,
         CAST(sum(CASE WHEN event_type = 'purchase'
                       THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) AS spend_cents,
         arg_max(event_type, event_id) AS last_kind
  FROM events GROUP BY user_id),
metrics AS (
  SELECT user_id, 'events' AS name, events AS value, NULL AS value_str FROM per_user
  UNION ALL SELECT user_id, 'error_rate', error_rate, NULL FROM per_user
  UNION ALL SELECT user_id, 'spend_cents', spend_cents, NULL FROM per_user
  UNION ALL SELECT user_id, 'last_kind', NULL, last_kind FROM per_user)"""


def criteria(default_op: str, missing: str) -> str:
    rows = ", ".join(
        f"('{n}', CAST({t} AS DOUBLE), {repr(o) if o else 'NULL'})" for n, t, o in CRITERIA
    )
    return f"""
criteria AS (
  SELECT u.user_id, c.name, c.threshold, coalesce(c.op, '{default_op}') AS op,
         coalesce(m.value, CAST('{missing}' AS DOUBLE)) AS value
  FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (VALUES {rows}) AS c(name, threshold, op)
  LEFT JOIN metrics m ON m.user_id = u.user_id AND m.name = c.name)"""


def compared(value: str, op: str, target: str) -> str:
    return (
        f"CASE {op} WHEN '>=' THEN {value} >= {target} WHEN '<=' THEN {value} <= {target} "
        f"WHEN '==' THEN {value} = {target} WHEN '>' THEN {value} > {target} "
        f"WHEN '<' THEN {value} < {target} END"
    )


REQUIREMENTS = """
requirements AS (
  SELECT c_custkey AS req_id,
         CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN ' ' || chr(9)
              ELSE '1995-01-01' END AS time_start,
         CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE '1996-12-31' END AS time_end,
         CASE WHEN c_custkey % 8 = 0 THEN '' ELSE n_name END AS area_value,
         CASE WHEN c_custkey % 11 = 0 THEN 'regional' WHEN c_custkey % 3 = 0 THEN NULL
              WHEN c_custkey % 3 = 1 THEN 'global' ELSE 'local' END AS scope,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'prices' END AS topic,
         c_custkey % 13 = 0 AS extra_keys
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PRICE_FACTS = """
price_facts AS (
  SELECT o_orderdate AS ts, n_name AS area, n_nationkey, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

RAW_RECORDS = """
raw_records AS (
  SELECT CASE WHEN o_orderkey % 101 = 0 THEN NULL
              WHEN o_orderkey % 103 = 0 THEN CAST(o_orderkey + 1 AS VARCHAR)
              ELSE CAST(o_orderkey AS VARCHAR) END AS order_id,
         CASE WHEN o_orderkey % 97 = 0 THEN 'n/a'
              ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS cents,
         CASE WHEN o_orderkey % 89 = 0 THEN 'soon'
              ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ordered,
         o_orderpriority AS priority, o_orderstatus AS state, o_orderkey AS src_key
  FROM orders),
clean_records AS (
  SELECT * FROM raw_records
  WHERE order_id IS NOT NULL AND cents <> 'n/a' AND ordered <> 'soon')"""

TYPED = (
    "CAST(order_id AS BIGINT) AS order_id, CAST(cents AS DOUBLE) AS cents, "
    "CAST(ordered AS TIMESTAMP) AS ordered, priority, state"
)

FEATURE_SETS = """
feature_rows AS (
  SELECT c_custkey AS set_id, u.o AS o, u.name, u.dtype, u.evidence, u.pk AS is_primary_key
  FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'float' WHEN 2 THEN 'int'
                       WHEN 3 THEN 'date' ELSE 'money' END AS kind FROM customer) c,
  LATERAL (
    SELECT 0 AS o, 'time_range' AS name, 'date' AS dtype, 'span' AS evidence, true AS pk
    WHERE c.c_custkey % 3 <> 0
    UNION ALL SELECT 1, lower(c.c_mktsegment), c.kind, c.c_name, false
    UNION ALL SELECT 2, 'location', 'string', 'place', true WHERE c.c_custkey % 4 <> 0) u)"""

LABELS_SQL = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
    "phone": r"\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b",
    "card": r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b",
}


def extractions(source: str = "documents") -> str:
    """CTE ``found``: (doc_id, text, extraction_class, nth, extraction_text, place)."""
    each = " UNION ALL ".join(
        f"""SELECT doc_id, text, '{label}' AS extraction_class,
        unnest(range(len(m))) AS nth, unnest(m) AS extraction_text,
        unnest(list_transform(range(1, len(m) + 1), lambda k:
          list_sum(list_transform(s[1 : k], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0))) AS place
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{rx}') AS m,
                     regexp_split_to_array(text, '{rx}') AS s FROM {source})"""
        for label, rx in LABELS_SQL.items()
    )
    return f"found AS ({each})"


EXAMPLES = f"""
blocks AS (
  SELECT doc_id, i AS chunk_idx, w[i * 60 + 1 : i * 60 + 60] AS w
  FROM (SELECT doc_id, w, unnest(range((len(w) + 59) // 60)) AS i
        FROM (SELECT doc_id, {word_list('text')} AS w FROM documents))),
examples AS (
  SELECT doc_id, chunk_idx, array_to_string(w, ' ') AS text, len(w) AS n,
         w[1] AS v1, CASE WHEN doc_id % 7 = 2 THEN '@none@' ELSE coalesce(w[10], '') END AS v10,
         w[-1] AS vl,
         CASE WHEN doc_id % 5 = 1 THEN 'Tenth' ELSE 'tenth' END AS l10
  FROM blocks)"""


# ``placed`` as sequences of as many words as labelled values have, the patterns that fit each, and
# the patterns learned from the documents with even ids
INDUCED = f"""
{placed_words('documents', 'doc_id')},
{extractions()},
pairs AS (
  SELECT DISTINCT doc_id, label, folded FROM (
    SELECT doc_id, extraction_class AS label, array_to_string({bare_words('extraction_text')}, ' ') AS folded
    FROM found WHERE doc_id % 2 = 0) WHERE folded <> ''),
sizes AS (SELECT DISTINCT len(string_split(folded, ' ')) AS n FROM pairs),
lists AS (
  SELECT doc_id, list(word ORDER BY k) AS w, list(folded ORDER BY k) AS f, list(shape ORDER BY k) AS s, list({form('word')} ORDER BY k) AS m,
         list(start ORDER BY k) AS b, list("end" ORDER BY k) AS e
  FROM placed GROUP BY doc_id),
seqs AS (
  SELECT doc_id, n, b[i] AS start, e[i + n - 1] AS "end", array_to_string(w[i : i + n - 1], ' ') AS value,
         array_to_string(f[i : i + n - 1], ' ') AS folded, array_to_string(s[i : i + n - 1], ' ') AS shape,
         array_to_string(m[i : i + n - 1], ' ') AS form,
         CASE WHEN i > 1 THEN f[i - 1] ELSE '^' END AS l, CASE WHEN i + n <= len(f) THEN f[i + n] ELSE '$' END AS r
  FROM (SELECT *, unnest(range(1, len(f) - n + 2)) AS i FROM lists, sizes)),
kinds AS (
  SELECT * FROM (VALUES ('both', true, true, true), ('left', true, true, false), ('right', false, true, true),
                        ('slot', true, false, true), ('shape', false, true, false),
                        ('form', false, true, false)) AS v(kind, ul, us, ur)),
pats AS (
  SELECT doc_id, n, start, "end", value, folded, kind, CASE WHEN ul THEN l ELSE '' END AS "left",
         CASE WHEN kind = 'form' THEN form WHEN us THEN shape ELSE '' END AS shape, CASE WHEN ur THEN r ELSE '' END AS "right"
  FROM seqs, kinds),
cand AS (
  SELECT label, kind, "left", shape, "right", n, count(*) AS support
  FROM pats JOIN pairs USING (doc_id, folded) GROUP BY ALL HAVING count(*) >= 3),
totals AS (
  SELECT kind, "left", shape, "right", n, count(*) AS total FROM pats WHERE doc_id % 2 = 0 GROUP BY ALL),
good AS (
  SELECT *, support / total AS precision FROM cand JOIN totals USING (kind, "left", shape, "right", n)
  WHERE support / total >= 0.9),
induced AS (
  SELECT g.* FROM good g WHERE NOT EXISTS (
    SELECT 1 FROM good w WHERE w.label = g.label AND w.n = g.n
      AND (g.kind = 'both' AND w.kind NOT IN ('both', 'form') OR g.kind IN ('left', 'right', 'form') AND w.kind = 'shape')
      AND (w."left" = '' OR w."left" = g."left") AND (w."right" = '' OR w."right" = g."right")
      AND (w.shape = '' OR w.shape = {shape('g.shape')})))"""
