"""Plain SQL for the registered queries, written against the driver tables only."""

from __future__ import annotations

from ..sources.fixtures import AS_OF, EARLIER_RUN, RUN
from .queries import PART_BYTES, PREDICATES

_AS_OF = f"TIMESTAMP '{AS_OF}'"

# --- the same derived views as in sources/fixtures.py, as common table expressions -------------

_ITEMS = """
items AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS item_id,
         CASE WHEN o_orderkey % 13 = 0 THEN 'Untitled'
              ELSE o_orderpriority || ' ' || o_orderstatus || ' #' || o_orderkey END AS title,
         o_orderpriority AS item_type,
         'owner_' || (o_custkey % 97) AS owner,
         CASE WHEN o_orderkey % 11 <> 0
              THEN 'https://svc' || (o_orderkey % 5) || '.example.org/' || o_orderkey END AS url,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS modified_at,
         CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderkey % 6 AS INTEGER) END AS tags_count,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN '[]' ELSE '["land"]' END AS tags_json,
         CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey % 4 <> 0 END AS has_description,
         o_orderkey % 3 <> 0 AS has_extent,
         o_orderkey % 2 = 0 AS has_thumbnail,
         CAST(o_orderkey % 260 AS INTEGER) AS snippet_len
  FROM orders)"""

_HEALTH = f"""
probed AS (
  SELECT l_orderkey AS k, max(l_quantity) AS q, max(l_extendedprice) AS p, max(l_shipdate) AS checked_at
  FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY l_orderkey),
outcome AS (
  SELECT *, CAST(CASE WHEN q >= 49 THEN NULL WHEN q >= 45 THEN 503 WHEN q >= 40 THEN 404 ELSE 200 END AS INTEGER)
         AS status_code FROM probed),
health AS (
  SELECT CASE WHEN k % 9 = 0 THEN '{EARLIER_RUN}' ELSE '{RUN}' END AS run_id,
         CAST(k AS VARCHAR) AS item_id,
         'https://svc' || (k % 5) || '.example.org/' || k AS checked_url,
         status_code IS NOT NULL AND status_code < 400 AS ok,
         status_code,
         CASE WHEN status_code IS NOT NULL THEN CAST(floor(p / 100000 * 1000) AS INTEGER) END AS latency_ms,
         CASE WHEN status_code IS NULL THEN 'connection failed'
              WHEN status_code >= 400 THEN 'HTTP ' || status_code END AS error_message,
         checked_at
  FROM outcome)"""

_SCORES = f"""
rules AS (
  SELECT item_id,
         coalesce(has_description, FALSE) AS r1, coalesce(tags_count, 0) >= 3 AS r2, has_extent AS r3,
         has_thumbnail AS r4, snippet_len BETWEEN 20 AND 200 AS r5, length(title) BETWEEN 10 AND 120 AS r6,
         coalesce(modified_at > {_AS_OF} - INTERVAL 181 DAY, FALSE) AS r7, coalesce(url <> '', FALSE) AS r8,
         coalesce(tags_count, 0) = 0 AS no_tags
  FROM items),
scores AS (
  SELECT CASE WHEN CAST(item_id AS BIGINT) % 7 = 0 THEN '{EARLIER_RUN}' ELSE '{RUN}' END AS run_id,
         item_id,
         CAST(20 * r1::INT + 15 * r2::INT + 15 * r3::INT + 5 * r4::INT + 5 * r5::INT + 5 * r6::INT
              + 20 * r7::INT + 10 * r8::INT AS INTEGER) AS score,
         '{{' || concat_ws(',', CASE WHEN r1 THEN '"has_description":20' END, CASE WHEN r2 THEN '"tags_count":15' END,
           CASE WHEN r3 THEN '"has_extent":15' END, CASE WHEN r4 THEN '"has_thumbnail":5' END,
           CASE WHEN r5 THEN '"snippet_len":5' END, CASE WHEN r6 THEN '"title_len":5' END,
           CASE WHEN r7 THEN '"freshness":20' END, CASE WHEN r8 THEN '"url":10' END) || '}}' AS breakdown_json,
         '[' || concat_ws(',', CASE WHEN NOT r1 THEN '"description"' END, CASE WHEN no_tags THEN '"tags"' END,
           CASE WHEN NOT r4 THEN '"thumbnail"' END) || ']' AS missing_json
  FROM rules)"""

_BASE = f"""
base AS (
  SELECT i.item_id, i.title, i.item_type, i.owner, i.url, i.modified_at, i.tags_count, i.has_description,
         s.score AS quality_score, h.ok AS health_ok, h.status_code, h.error_message, h.checked_url
  FROM items i
  LEFT JOIN (SELECT * FROM scores WHERE run_id = '{RUN}') s ON s.item_id = i.item_id
  LEFT JOIN (SELECT * FROM health WHERE run_id = '{RUN}') h ON h.item_id = i.item_id)"""

_MONTH = "'run_' || (year(o_orderdate) * 100 + month(o_orderdate))"

_RUNS = f"""
runs AS (
  SELECT {_MONTH} AS run_id, min(o_orderdate) AS started_at, max(o_orderdate) AS finished_at
  FROM orders GROUP BY ALL)"""

_SEEN = f"""
seen AS (
  SELECT item_id, run_id, content, observed_at FROM (
    SELECT CAST(o_custkey AS VARCHAR) AS item_id, {_MONTH} AS run_id,
           o_orderstatus || '/' || (o_custkey % 3) AS content, o_orderdate AS observed_at,
           row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), month(o_orderdate)
                              ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1)"""

_HISTORY = f"""{_RUNS},{_SEEN},
timed AS (
  SELECT s.*, r.started_at, lag(content) OVER w AS before
  FROM seen s JOIN runs r USING (run_id) WINDOW w AS (PARTITION BY item_id ORDER BY r.started_at)),
numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR before <> content THEN 1 ELSE 0 END)
            OVER (PARTITION BY item_id ORDER BY started_at) AS version
  FROM timed),
grouped AS (
  SELECT item_id, version, any_value(content) AS content, min(started_at) AS valid_from,
         arg_min(run_id, started_at) AS first_seen_run_id, arg_max(run_id, started_at) AS last_seen_run_id
  FROM numbered GROUP BY item_id, version),
history AS (
  SELECT item_id, sha256(length(content) || ':' || content) AS content_hash, valid_from,
         lead(valid_from) OVER (PARTITION BY item_id ORDER BY valid_from) AS valid_to,
         lead(valid_from) OVER (PARTITION BY item_id ORDER BY valid_from) IS NULL AS is_current,
         content, first_seen_run_id, last_seen_run_id
  FROM grouped)"""

_FEATURES = """
features AS (
  SELECT 'svc_' || c_nationkey AS item_id, CAST(c_custkey % 3 AS INTEGER) AS layer_index,
         CASE WHEN c_custkey % 3 = 2 THEN 'table' ELSE 'layer' END AS layer_kind, c_custkey AS feature_id,
         c_mktsegment AS class_value, c_acctbal AS measure,
         CASE WHEN c_custkey % 29 <> 0 THEN CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) END AS x,
         CASE WHEN c_custkey % 29 <> 0 THEN CAST((c_custkey * 53) % 180 - 90 AS DOUBLE) END AS y
  FROM customer)"""

_REFUSED = (
    "function reflect is not allowed", "function java_method is not allowed", "function from_json is not allowed",
    "subqueries are not allowed", "subqueries are not allowed", "column secret is not known", "function exists is not allowed",
    "function rand is not allowed", "function count is not allowed", "the predicate is not true or false",
    "the predicate cannot be read",
)


def _predicate_counts() -> str:
    parts, quoted = [], lambda text: "'" + text.replace("'", "''") + "'"
    n = len(PREDICATES) - len(_REFUSED)
    for k, where in enumerate(PREDICATES):
        head = f"SELECT {k} AS where_no, {quoted(where)} AS predicate, "
        if k < n:
            parts.append(f"{head}TRUE AS accepted, NULL AS reason, item_id, count(*) FILTER ({where}) AS matching FROM features GROUP BY item_id")
        else:
            parts.append(f"{head}FALSE, {quoted(_REFUSED[k - n])}, NULL, NULL")
    return " UNION ALL ".join(parts)


_SHIFTED = f"""{_FEATURES},
shifted AS (
  SELECT * REPLACE (CASE WHEN item_id IN ('svc_4', 'svc_9') AND feature_id % 2 = 0 THEN x * 1000 ELSE x END AS x)
  FROM features)"""

_LAYERS = """
layers AS (
  SELECT 'svc_' || n_nationkey AS item_id,
         CASE WHEN n_nationkey % 5 = 4 THEN 'Web Map' WHEN n_nationkey % 2 = 0 THEN 'Feature Service'
              ELSE 'Map Service' END AS item_type,
         CASE WHEN i = 2 THEN 'table' ELSE 'layer' END AS layer_kind, CAST(i AS INTEGER) AS layer_index,
         n_name || ' / ' || i AS layer_name,
         CASE WHEN i = 2 THEN 'None' ELSE 'Point' END AS geometry_type,
         CASE WHEN n_nationkey % 7 = 3 AND i = 1 THEN 'timeout' END AS error
  FROM nation, (VALUES (0), (1), (2)) t(i))"""

_COUNTS = f"""{_FEATURES},{_LAYERS},
counts AS (
  SELECT l.item_id, l.layer_kind, l.layer_index, l.layer_name,
         CASE WHEN l.error IS NULL THEN (
           SELECT count(*) FROM features f WHERE f.item_id = l.item_id AND f.layer_kind = l.layer_kind
             AND f.layer_index = l.layer_index AND f.measure > 0) END AS row_count,
         l.error
  FROM layers l)"""

_REQUESTS = """
requests AS (
  SELECT s_suppkey % 5 AS form, s_nationkey AS n, CASE WHEN s_suppkey % 5 = 3 THEN s_suppkey % 4 END AS wish
  FROM supplier),
targets AS (
  SELECT CASE form WHEN 0 THEN 'svc_' || n
                   WHEN 1 THEN 'https://x.example.org/item.html?id=svc_' || n || '&v=1'
                   WHEN 2 THEN 'https://svc.example.org/' || n || '/FeatureServer'
                   WHEN 3 THEN 'https://svc.example.org/' || n || '/FeatureServer/' || wish
                   ELSE 'lost_' || n END AS reference,
         CASE WHEN form IN (2, 3) THEN 'service_url' ELSE 'item_id' END AS kind,
         CASE form WHEN 2 THEN 'collection' WHEN 3 THEN 'layer' ELSE 'item' END AS target_class,
         CASE WHEN form IN (2, 3) THEN 'https://svc.example.org/' || n || '/FeatureServer' END AS service_url,
         CAST(CASE form WHEN 2 THEN 0 WHEN 3 THEN wish END AS INTEGER) AS layer_index,
         CASE WHEN form <> 4 THEN 'svc_' || n END AS resolved_id
  FROM requests)"""

_WATCH = """
log AS (
  SELECT event_id AS seq, ts AS added_at, CAST(user_id AS VARCHAR) AS item_id,
         CASE WHEN event_type = 'error' THEN 'remove' ELSE 'save' END AS action,
         'https://svc.example.org/' || user_id AS item_url,
         'Item ' || user_id || ' ' || event_type AS title, event_type AS item_type,
         'owner_' || (event_id % 11) AS owner, event_type AS source_query,
         CASE WHEN event_type = 'purchase' THEN props END AS notes
  FROM events)"""


def _replay(log: str, name: str) -> str:
    return f"""
{name}_live AS (
  SELECT * FROM {log} a WHERE action = 'save' AND seq > coalesce(
    (SELECT max(seq) FROM {log} b WHERE b.item_id = a.item_id AND b.action = 'remove'), -1)),
{name} AS (
  SELECT item_id, arg_max(item_url, seq) AS item_url, arg_max(title, seq) AS title,
         arg_max(item_type, seq) AS item_type, arg_max(owner, seq) AS owner,
         arg_min(source_query, seq) AS source_query, arg_max(added_at, seq) AS added_at,
         (SELECT n.notes FROM {name}_live n WHERE n.item_id = l.item_id AND n.notes IS NOT NULL
          ORDER BY n.seq DESC LIMIT 1) AS notes
  FROM {name}_live l GROUP BY item_id)"""


_DOC_ITEMS = """
hits AS (
  SELECT md5(CAST(doc_id AS VARCHAR)) AS id, doc_id AS hit_no,
         CASE WHEN doc_id % 3 = 0 THEN 'Feature Layer' ELSE 'Web Map' END AS type,
         CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, 1, 40) END AS title,
         source AS owner, 'https://docs.example.org/' || doc_id AS url,
         CASE WHEN doc_id % 4 <> 0 THEN substr(text, 41, 120) END AS snippet,
         CASE WHEN doc_id % 6 <> 0 THEN text END AS description,
         CASE WHEN doc_id % 10 <> 9 THEN list_slice([lang, source, 'map', 'open'], 1, doc_id % 5) END AS tags
  FROM documents),
scored AS (
  SELECT *, CAST(20 * coalesce(title <> '', FALSE)::INT + 30 * coalesce(snippet <> '', FALSE)::INT
              + 30 * coalesce(description <> '', FALSE)::INT + 10 * (coalesce(len(tags), 0) > 0)::INT
              + 10 * (coalesce(len(tags), 0) >= 3)::INT AS INTEGER) AS quality_score
  FROM hits
  WHERE contains(lower(concat_ws(' ', title, snippet, description, array_to_string(tags, ' '))), 'the'))"""

_MESSAGES = """
messages AS (
  SELECT conv_id, turn, md5(CAST(conv_id AS VARCHAR)) AS item, (conv_id * 3 + turn) % 7 AS form, text
  FROM conversations)"""


def _with(body: str, *ctes: str) -> str:
    return f"WITH {','.join(ctes)}\n{body}"


def _issue(condition: str, columns: str = "item_id, title, owner") -> str:
    return _with(f"SELECT {columns} FROM items WHERE {condition}", _ITEMS)


def _top(sql: str, order: str, n: int = 50) -> str:
    return f"{sql} ORDER BY {order} LIMIT {n}"


_NO_TAGS = "coalesce(tags_count, 0) = 0"
_NO_DESCRIPTION = "NOT coalesce(has_description, FALSE)"
_NO_EXTENT = "NOT coalesce(has_extent, FALSE)"
_STALE = f"modified_at < {_AS_OF} - INTERVAL 2 YEAR"

_BROKEN = _with(
    f"""SELECT i.item_id, i.title, i.owner, h.checked_url, h.status_code, h.error_message
FROM health h JOIN items i ON i.item_id = h.item_id WHERE h.run_id = '{RUN}' AND NOT h.ok""",
    _ITEMS, _HEALTH,
)


def _owners(description: str, cap: str = "LIMIT 20") -> str:
    return _with(
        f"""SELECT owner, count(*) AS total_items, count(*) FILTER ({_NO_TAGS}) AS missing_tags,
       count(*) FILTER ({_NO_DESCRIPTION}) AS {description}, count(*) FILTER ({_STALE}) AS stale
FROM items GROUP BY owner ORDER BY total_items DESC, owner {cap}""",
        _ITEMS,
    )


def _remediation(condition: str, weight: int, action: str, more: str = "") -> str:
    return _with(
        f"""SELECT item_id, title, item_type, owner,
       CAST(least(greatest(100 - coalesce(quality_score, 50) + {weight}, 0), 100) AS INTEGER) AS priority,
       '{action}' AS recommended_action, url, quality_score, modified_at{more}
FROM base WHERE {condition}""",
        _ITEMS, _HEALTH, _SCORES, _BASE,
    )


def _changes(run: str, other: str, limit: str = "") -> str:
    return _with(
        f"""SELECT item_id, content,
       CASE WHEN EXISTS (SELECT 1 FROM history o WHERE o.item_id = h.item_id AND {other})
            THEN 'Modified' ELSE 'New' END AS change_type
FROM history h WHERE first_seen_run_id = '{run}' ORDER BY item_id {limit}""",
        _HISTORY,
    )


def _digest(*fields: str) -> str:
    parts = ", ".join(f"coalesce(length({f}) || ':' || ({f}), '~')" for f in fields)
    return f"sha256(concat_ws(';', {parts}))"


_RAW = """
raw AS (
  SELECT doc_id AS d, lang, source, text,
         CASE WHEN doc_id % 97 <> 0 THEN md5(CAST(doc_id AS VARCHAR)) END AS id,
         CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 13 <> 1 THEN substr(text, 1, 5 + doc_id % 130) END AS title,
         CASE WHEN doc_id % 9 <> 0 THEN 'Feature Service' END AS type,
         CASE WHEN doc_id % 8 <> 0 THEN source END AS owner,
         CASE WHEN doc_id % 11 <> 0 THEN 'https://svc' || (doc_id % 5) || '.example.org/' || doc_id END AS url,
         CASE WHEN doc_id % 7 <> 0 THEN substr(text, 1, doc_id % 260) END AS snippet,
         CASE WHEN doc_id % 6 <> 0 THEN text END AS description,
         CASE WHEN doc_id % 2 = 0 THEN 'thumb.png' END AS thumbnail,
         990000000000 + doc_id * 86400000 AS modified,
         CASE doc_id % 5 WHEN 0 THEN '["' || lang || '","' || source || '","x"]'
                         WHEN 1 THEN '["' || lang || '","' || source || '"]'
                         WHEN 2 THEN '[""]' ELSE '[]' END AS tags_json,
         CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS tags_count,
         CASE doc_id % 5 WHEN 0 THEN '["' || lang || '","' || source || '","x"]'
                         WHEN 1 THEN '"' || lang || ' , ' || source || '"'
                         WHEN 2 THEN '""' WHEN 3 THEN '[]' END AS raw_tags,
         doc_id % 7 >= 4 AS has_extent,
         CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '[[0,0]]' WHEN 2 THEN '[["x",0],[1,1]]' WHEN 3 THEN '[[0,0],[1]]'
              ELSE '[[-' || (doc_id % 180 + 1) || ',-2],[' || (doc_id % 180) || '.5,4]]' END AS raw_extent
  FROM documents)"""

def _quoted(column: str) -> str:
    return f"'\"' || {column} || '\"'"


def _raw_hash(access: str) -> str:
    return _digest(
        *[_quoted(c) for c in ("id", "title", "type", "owner", "url", f"'{access}'")], "raw_tags",
        *[_quoted(c) for c in ("snippet", "description", "thumbnail")], "raw_extent", "modified::VARCHAR",
    )


_RAW_HASH = _raw_hash("public")
_FIRST, _SECOND = "TIMESTAMP '2024-05-01 00:00:00'", "TIMESTAMP '2024-06-01 00:00:00'"
_RAW_SCORE = f"""CAST(20 * described::INT + 15 * (tags_count >= 3)::INT + 15 * has_extent::INT + 5 * (thumbnail IS NOT NULL)::INT
            + 5 * (length(coalesce(snippet, '')) BETWEEN 20 AND 200)::INT
            + 5 * (length(coalesce(nullif(title, ''), 'Untitled')) BETWEEN 10 AND 120)::INT
            + 20 * (make_timestamp(modified * 1000) > {_AS_OF} - INTERVAL 181 DAY)::INT + 10 * (url IS NOT NULL)::INT
            AS INTEGER)"""

_REFERENCES = """
refs AS (
  SELECT o_orderkey AS k, o_orderkey % 8 AS form,
         'https://svc' || (o_orderkey % 5) || '.example.org/rest/' || o_orderkey AS host,
         'https://maps.example.org/apps/mapviewer/index.html?' AS viewer
  FROM orders)"""

# Whatever starts first is taken, up to its closing mark or the end of the text.
_MARKUP = "(?is)" + "|".join(
    [r"<!--.*?(?:-->|\z)"]
    + [rf"<{name}\b[^>]*(?:>.*?(?:</{name}\s*>|\z)|\z)" for name in ("script", "style", "template")]
    + [r"""<[/!?A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>""", r"<[/!?A-Za-z][^>]*(?:>|\z)"]
)

# The steps a page's text takes, innermost first. The pages hold only the entities undone here.
_HTML_STEPS = [
    (_MARKUP, " "),
    ("&quot;", '"'),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "),
]


def _html_sql(page: str = "html") -> str:
    sql = page
    for pattern, to in _HTML_STEPS:
        sql = f"regexp_replace({sql}, '{pattern}', '{to}', 'g')"
    return f"SELECT page_id, trim({sql}) AS text FROM pages"


_BOX = "min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax"
_HAS = "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN"
_GEOJSON = (
    f"""'{{"type":"Feature","geometry":' || coalesce({_HAS} '{{"coordinates":[' || CAST(x AS INTEGER) || ',' """
    """|| CAST(y AS INTEGER) || '],"type":"Point"}' END, 'null') || ',"properties":{"feature_id":' || feature_id """
)

_STYLED = f"""{_FEATURES},
keyed AS (
  SELECT f.*, n_nationkey AS n, layer_index < 2 AS drawn, list_position(
           ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'], class_value) - 1 AS place
  FROM features f JOIN nation ON item_id = 'svc_' || n_nationkey),
chosen AS (
  SELECT *, CASE WHEN NOT drawn OR n % 5 = 1 THEN 'default' WHEN n % 5 = 0 THEN 'simple'
                 WHEN place >= 0 THEN 'class' WHEN n % 2 = 0 THEN 'fallback' ELSE 'default' END AS how,
         CASE WHEN n % 5 = 0 THEN n * 3 WHEN place = 0 THEN n * 7 + 5 WHEN place > 0 THEN n * 7 + 10 * place
              ELSE 250 END AS red
  FROM keyed),
styled AS (
  SELECT feature_id, item_id, layer_index,
         CASE WHEN how <> 'default' THEN printf('#%02x1428', CAST(red AS INTEGER)) END AS fill_color,
         CASE WHEN how = 'default' THEN 'black' ELSE printf('#00%02x09', CAST(red AS INTEGER)) END AS color,
         CAST(CASE how WHEN 'default' THEN NULL WHEN 'fallback' THEN 1 ELSE 2 END AS DOUBLE) AS weight,
         CAST(CASE how WHEN 'default' THEN NULL WHEN 'simple' THEN 204 / 255.0 WHEN 'class' THEN 1
              ELSE 102 / 255.0 END AS DOUBLE) AS fill_opacity,
         CAST(CASE how WHEN 'default' THEN NULL ELSE 51 / 255.0 END AS DOUBLE) AS opacity
  FROM chosen)"""


def _shown(limit: int, tag: str) -> str:
    """Preview layers of at most ``limit`` features, as in the refresh query."""
    return f"""
first_{tag} AS (
  SELECT * FROM features WHERE layer_kind = 'layer'
  QUALIFY row_number() OVER (PARTITION BY item_id, layer_index ORDER BY feature_id) <= {limit}),
shown_{tag} AS (
  SELECT item_id, layer_index, 'Layer of ' || item_id || ' at {limit}' AS layer_name, 'Point' AS geometry_type,
         '{{"type":"FeatureCollection","features":[' || string_agg({_GEOJSON} || '}}}}', ',' ORDER BY feature_id)
         || ']}}' AS geojson, {_BOX}
  FROM first_{tag} GROUP BY item_id, layer_index)"""


def _kept(name: str) -> str:
    return f"CASE WHEN n.item_id LIKE '%7' OR n.item_id LIKE '%5' OR n.{name} IS NULL THEN o.{name} ELSE n.{name} END AS {name}"


def _sections() -> str:
    columns = ("item_id", "title", "owner", "modified_at", "checked_url", "status_code", "error_message")
    counts = ("total_items", "missing_tags", "missing_description", "stale")

    def rows(section: str, source: str, **values: str) -> str:
        listed = ", ".join(f"{values.get(c, 'NULL')} AS {c}" for c in (*columns, *counts))
        return f"SELECT '{section}' AS section, {listed} FROM {source}"

    item = {"item_id": "i.item_id", "title": "i.title", "owner": "i.owner"}
    sums = {
        "total_items": "count(*)", "missing_tags": f"count(*) FILTER ({_NO_TAGS})",
        "missing_description": f"count(*) FILTER ({_NO_DESCRIPTION})", "stale": f"count(*) FILTER ({_STALE})",
    }
    check = {c: f"h.{c}" for c in ("checked_url", "status_code", "error_message")}
    return " UNION ALL ".join([
        # The first one gives the types.
        rows("broken_services", f"items i JOIN health h ON h.item_id = i.item_id AND h.run_id = '{RUN}' AND NOT h.ok", **item, **check),
        rows("missing_tags", f"items i WHERE {_NO_TAGS}", **item),
        rows("missing_description", f"items i WHERE {_NO_DESCRIPTION}", **item),
        rows("missing_extent", f"items i WHERE {_NO_EXTENT}", **item),
        rows("stale_items", f"items i WHERE {_STALE}", **item, modified_at="i.modified_at"),
        rows("owner_summary", "items i GROUP BY i.owner", owner="i.owner", **sums),
        rows("totals", "items i", **sums),
    ])


ORACLE: dict[str, str] = {
    "missing_tags": _issue(_NO_TAGS),
    "missing_tags_strict": _issue("tags_count = 0"),
    "missing_description": _issue(_NO_DESCRIPTION),
    "missing_description_strict": _issue("has_description = FALSE"),
    "missing_extent": _issue(_NO_EXTENT),
    "stale_items": _issue(_STALE, "item_id, title, owner, modified_at"),
    "broken_services": _BROKEN,
    "report_one_pass": _with(_sections(), _ITEMS, _HEALTH),
    "health_classification": _with(
        "SELECT run_id, item_id, checked_url, ok, status_code, latency_ms, error_message, checked_at FROM health",
        _HEALTH,
    ),
    "owner_summary": _owners("missing_description"),
    "owner_summary_admin": _owners("missing_desc"),
    "owner_summary_full": _owners("missing_description", ""),
    "dashboard_missing_tags": _top(_issue(_NO_TAGS, "item_id, title, owner, tags_json"), "item_id"),
    "dashboard_missing_description": _top(_issue(_NO_DESCRIPTION), "item_id"),
    "dashboard_missing_extent": _top(_issue(_NO_EXTENT), "item_id"),
    "dashboard_stale_items": _top(_issue(_STALE, "item_id, title, owner, modified_at"), "item_id"),
    "dashboard_broken_services": _top(_BROKEN, "i.item_id, checked_url"),
    "item_scan": _issue("has_extent AND item_type IN ('1-URGENT', '2-HIGH')", "item_id, title, item_type, owner"),
    "quality_scores": _with(
        "SELECT run_id, item_id, score, breakdown_json, missing_json FROM scores", _ITEMS, _SCORES
    ),
    "quality_stats": _with(
        f"""SELECT avg(score) AS avg_score, min(score) AS min_score, max(score) AS max_score,
       count(*) FILTER (score >= 70) AS count_high_quality, count(*) FILTER (score < 50) AS count_low_quality
FROM scores WHERE run_id = '{RUN}'""",
        _ITEMS, _SCORES,
    ),
    "snapshot_summary": _with(
        f"""SELECT (SELECT count(*) FROM items) AS total_items,
       (SELECT count(*) FROM scores WHERE run_id = '{RUN}') AS scored_items,
       (SELECT count(*) FROM health WHERE run_id = '{RUN}') AS checked_urls""",
        _ITEMS, _HEALTH, _SCORES,
    ),
    "remediation_base": _with("SELECT * FROM base", _ITEMS, _HEALTH, _SCORES, _BASE),
    "remediation_tags": _remediation(_NO_TAGS, 10, "ADD_TAGS"),
    "remediation_description": _remediation("has_description = FALSE", 15, "ADD_DESCRIPTION"),
    "remediation_stale": _remediation(_STALE, 10, "REVIEW_STALE"),
    "remediation_broken": _remediation(
        "health_ok = FALSE", 30, "FIX_SERVICE_URL", ", status_code, error_message, checked_url"
    ),
    "remediation_base_fanout": _with(
        f"""SELECT i.item_id, i.owner, s.score AS quality_score, l_quantity < 40 AS health_ok,
       CAST(l_quantity AS INTEGER) AS status_code, CAST(l_partkey AS VARCHAR) AS checked_url
FROM items i LEFT JOIN (SELECT * FROM scores WHERE run_id = '{RUN}') s ON s.item_id = i.item_id
LEFT JOIN lineitem ON CAST(l_orderkey AS VARCHAR) = i.item_id""",
        _ITEMS, _SCORES,
    ),
    "remediation_pack": _with(
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS category, item_id, title, item_type, owner,
       CAST(least(greatest(100 - coalesce(quality_score, 50) + {w}, 0), 100) AS INTEGER) AS priority,
       '{a}' AS recommended_action, url, quality_score, modified_at FROM base WHERE {f}"""
            for c, w, a, f in (
                ("missing_tags", 10, "ADD_TAGS", _NO_TAGS),
                ("missing_description", 15, "ADD_DESCRIPTION", "has_description = FALSE"),
                ("stale_items", 10, "REVIEW_STALE", _STALE),
                ("broken_services", 30, "FIX_SERVICE_URL", "health_ok = FALSE"),
            )
        ),
        _ITEMS, _HEALTH, _SCORES, _BASE,
    ),
    "owner_remediation": _with(
        f"""SELECT i.owner, count(*) AS total_items, count(*) FILTER ({_NO_TAGS}) AS missing_tags_count,
       count(*) FILTER (has_description = FALSE) AS missing_description_count,
       count(*) FILTER ({_STALE}) AS stale_items_count, count(*) FILTER (h.ok = FALSE) AS broken_services_count
FROM items i LEFT JOIN (SELECT * FROM health WHERE run_id = '{RUN}') h ON h.item_id = i.item_id GROUP BY i.owner""",
        _ITEMS, _HEALTH,
    ),
    "latest_run": _with("SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 1", _RUNS),
    "previous_run": _with(
        f"""SELECT * FROM runs WHERE started_at < (SELECT started_at FROM runs WHERE run_id = '{RUN}')
ORDER BY started_at DESC, run_id LIMIT 1""",
        _RUNS,
    ),
    "run_lookup": _with(
        f"""SELECT run_id, substr(run_id, 1, 8) AS short_id,
       'catalog_health_' || strftime(started_at, '%Y-%m-%d') || '_' || substr(run_id, 1, 8) AS report_name,
       started_at, finished_at FROM runs WHERE run_id = '{EARLIER_RUN}'""",
        _RUNS,
    ),
    "warehouse_status": _with(
        """SELECT r.run_id, substr(r.run_id, 1, 8) AS short_id, r.started_at, r.finished_at,
       (SELECT count(*) FROM items) AS items,
       (SELECT count(*) FROM scores s WHERE s.run_id = r.run_id) AS scores,
       (SELECT count(*) FROM health h WHERE h.run_id = r.run_id) AS health_checks,
       (SELECT count(*) FROM health h WHERE h.run_id = r.run_id AND NOT h.ok) AS broken_services
FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 1) r""",
        _ITEMS, _HEALTH, _SCORES, _RUNS,
    ),
    "content_hash": _with(
        "SELECT item_id, "
        + _digest("item_id", "title", "item_type", "owner", "url", "tags_json",
                  "strftime(modified_at, '%Y-%m-%d %H:%M:%S')")
        + " AS content_hash FROM items",
        _ITEMS,
    ),
    "normalize_items": _with(
        f"""SELECT id AS item_id, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(type, 'Unknown') AS item_type,
       coalesce(nullif(owner, ''), 'Unknown') AS owner, url, 'public' AS access,
       CASE WHEN d % 10 > 2 THEN make_timestamp((modified - 1000) * 1000) END AS created_at,
       make_timestamp(modified * 1000) AS modified_at, tags_json, tags_count,
       coalesce(snippet, '') AS snippet, CAST(length(coalesce(snippet, '')) AS INTEGER) AS snippet_len,
       coalesce(description, '') AS description, CAST(length(coalesce(description, '')) AS INTEGER) AS description_len,
       thumbnail, thumbnail IS NOT NULL AS has_thumbnail,
       CASE WHEN has_extent THEN CAST(-(d % 180 + 1) AS DOUBLE) END AS extent_xmin,
       CASE WHEN has_extent THEN CAST(-2 AS DOUBLE) END AS extent_ymin,
       CASE WHEN has_extent THEN d % 180 + 0.5::DOUBLE END AS extent_xmax,
       CASE WHEN has_extent THEN CAST(4 AS DOUBLE) END AS extent_ymax,
       has_extent, coalesce(description, '') <> '' AS has_description,
       CASE d % 3 WHEN 0 THEN NULL WHEN 1 THEN d * 3 ELSE 0 END AS num_views,
       {_RAW_HASH} AS content_hash,
       '{RUN}' AS last_seen_run_id, {_AS_OF} AS last_seen_at
FROM raw WHERE id IS NOT NULL""",
        _RAW,
    ),
    "normalized_scan": _with(
        """SELECT id AS item_id, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(nullif(owner, ''), 'Unknown') AS owner,
       CASE d % 3 WHEN 0 THEN NULL WHEN 1 THEN d * 3 ELSE 0 END AS num_views
FROM raw WHERE id IS NOT NULL AND type IS NOT NULL""",
        _RAW,
    ),
    "normalized_scores": _with(
        f"""SELECT id AS item_id,
       {_RAW_SCORE} AS score,
       '[' || concat_ws(',', CASE WHEN NOT described THEN '"description"' END, CASE WHEN tags_count = 0 THEN '"tags"' END,
         CASE WHEN thumbnail IS NULL THEN '"thumbnail"' END) || ']' AS missing_json
FROM (SELECT *, coalesce(description, '') <> '' AS described FROM raw) WHERE id IS NOT NULL""",
        _RAW,
    ),
    "item_type_flags": """SELECT CASE WHEN doc_id % 3 = 0 THEN 'Feature Layer' ELSE 'Web Map' END AS item_type,
       count(*) FILTER (doc_id % 3 = 0) AS previewable, count(*) FILTER (doc_id % 3 = 0) AS countable, count(*) AS with_url
FROM documents GROUP BY ALL""",
    "batch_last_wins": """SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE CAST(l_orderkey % 1000 AS VARCHAR) END AS item_id,
       l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC,
  l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1""",
    "snapshot_chain": _with(
        f"""SELECT id AS item_id, hash AS content_hash, coalesce(nullif(title, ''), 'Untitled') AS title,
       CASE WHEN version = 2 THEN {_SECOND} ELSE {_FIRST} END AS valid_from,
       CASE WHEN version = 1 AND edited THEN {_SECOND} END AS valid_to, NOT (version = 1 AND edited) AS is_current,
       CASE WHEN version = 2 THEN 'second' ELSE 'first' END AS first_seen_run_id,
       CASE WHEN version = 1 AND edited THEN 'first' ELSE 'second' END AS last_seen_run_id, score
FROM (SELECT *, d % 3 = 0 AS edited, CASE version WHEN 1 THEN {_RAW_HASH} ELSE {_raw_hash("org")} END AS hash, {_RAW_SCORE} AS score
      FROM (SELECT *, coalesce(description, '') <> '' AS described, unnest([1, 2]) AS version FROM raw))
WHERE id IS NOT NULL AND (version = 1 OR edited)""",
        _RAW,
    ),
    "scan_capped": """SELECT item_id, l_shipdate, l_orderkey, l_linenumber FROM (
  SELECT CAST(l_partkey AS VARCHAR) AS item_id, l_shipdate, l_orderkey, l_linenumber FROM lineitem
  WHERE l_returnflag <> 'A' AND l_linestatus IN ('F', 'O')
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1)
ORDER BY item_id LIMIT 200""",
    "rejected_items": "SELECT doc_id AS seq, 'no item id' AS reason FROM documents WHERE doc_id % 97 = 0",
    "upsert_current": _with(
        """SELECT item_id, run_id, content, observed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY
           CAST(right(run_id, 1) AS INTEGER) % 2 = 0 DESC, observed_at DESC) AS rn FROM seen) WHERE rn = 1""",
        _SEEN,
    ),
    "scd2_rebuild": _with("SELECT * FROM history", _HISTORY),
    "scd2_apply": _with("SELECT * FROM history", _HISTORY),
    "change_feed": _with(
        """, chosen AS (SELECT run_id, started_at FROM runs WHERE run_id IN ('run_200107', 'run_200108'))
SELECT c.run_id, 'closed' AS change, h.* FROM chosen c JOIN history h ON h.valid_to = c.started_at
UNION ALL
SELECT c.run_id, CASE WHEN h.first_seen_run_id = c.run_id THEN 'opened' ELSE 'touched' END, h.* REPLACE (
         CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current, c.run_id AS last_seen_run_id)
FROM chosen c JOIN seen s ON s.run_id = c.run_id JOIN history h
  ON h.item_id = s.item_id AND h.valid_from <= c.started_at AND (h.valid_to IS NULL OR h.valid_to > c.started_at)""",
        _HISTORY,
    ),
    "change_report": _changes("run_199806", "o.first_seen_run_id <> 'run_199806'", "LIMIT 20"),
    "change_report_full": _changes("run_199806", "o.first_seen_run_id <> 'run_199806'"),
    "change_report_looking_back": _changes("run_199502", "o.first_seen_run_id < 'run_199502'"),
    "watchlist_replay": _with("SELECT * FROM saved", _WATCH, _replay("log", "saved")),
    "watchlist_export": _with(
        """SELECT item_id AS id, item_url AS url, title, item_type AS type, owner, source_query, added_at, notes
FROM saved""",
        _WATCH, _replay("log", "saved"),
    ),
    "watchlist_apply_log": _with("SELECT * FROM saved", _WATCH, _replay("log", "saved")),
    "watchlist_upsert": _with(
        """SELECT coalesce(n.item_id, o.item_id) AS item_id, coalesce(n.item_url, o.item_url) AS item_url,
       coalesce(n.title, o.title) AS title, coalesce(n.item_type, o.item_type) AS item_type,
       coalesce(n.owner, o.owner) AS owner, coalesce(o.source_query, n.source_query) AS source_query,
       coalesce(n.added_at, o.added_at) AS added_at, coalesce(n.notes, o.notes) AS notes
FROM saved o FULL OUTER JOIN again n ON n.item_id = o.item_id""",
        _WATCH,
        "early AS (SELECT * FROM log WHERE added_at < TIMESTAMP '2024-01-15 00:00:00')",
        _replay("early", "saved"),
        """again AS (SELECT * FROM log WHERE added_at >= TIMESTAMP '2024-01-15 00:00:00'
  AND source_query = 'purchase' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) = 1)""",
    ),
    "watchlist_remove": _with(
        """SELECT * FROM saved WHERE item_id NOT IN (
  SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3)""",
        _WATCH, _replay("log", "saved"),
    ),
    "search_rank": _with(
        """SELECT hit_no, id, title, type, owner, url, quality_score,
       hit_no IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_saved
FROM scored WHERE type = 'Feature Layer' ORDER BY hit_no LIMIT 50""",
        _DOC_ITEMS,
    ),
    "search_unranked": _with(
        """SELECT hit_no, title, quality_score FROM scored WHERE type = 'Feature Layer' ORDER BY hit_no LIMIT 5""",
        _DOC_ITEMS,
    ),
    "search_scores": _with("SELECT id, title, quality_score FROM scored", _DOC_ITEMS),
    "search_indexed": _with("SELECT id, title, quality_score FROM scored", _DOC_ITEMS),
    "layer_where_checked": _with(_predicate_counts(), _FEATURES),
    "layer_row_counts": _with("SELECT * FROM counts", _COUNTS),
    "layer_row_total": _with(
        """SELECT item_id, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_count,
       count(*) FILTER (layer_kind = 'layer') AS total_layers, count(*) FILTER (layer_kind = 'table') AS total_tables,
       count(error) AS failed FROM counts GROUP BY item_id""",
        _COUNTS,
    ),
    "layer_counts_displayed": _with(
        """SELECT item_id, layer_kind, layer_index, layer_name,
       coalesce(CAST(row_count AS VARCHAR), 'Error') AS row_count FROM counts""",
        _COUNTS,
    ),
    "layer_resolve": _with(
        "SELECT reference, kind, target_class, service_url, layer_index, resolved_id FROM targets", _REQUESTS
    ),
    "layer_count_requests": _with(
        """SELECT t.reference, t.resolved_id, t.layer_index, count(c.item_id) > 0 AS ok,
       CASE WHEN t.resolved_id IS NULL THEN 'reference is not known'
            WHEN count(c.item_id) = 0 THEN 'no layer ' || t.layer_index END AS error,
       count(c.item_id) AS layers_counted, CAST(coalesce(sum(c.row_count), 0) AS BIGINT) AS total_count
FROM (SELECT *, row_number() OVER () AS request FROM targets) t LEFT JOIN counts c ON c.item_id = t.resolved_id AND (
    t.layer_index IS NULL OR (c.layer_kind = 'layer' AND c.layer_index = t.layer_index))
GROUP BY t.request, t.reference, t.resolved_id, t.layer_index""",
        _COUNTS, _REQUESTS,
    ),
    "layer_count_unlisted": _with(
        """, wanted AS (
  SELECT *, CAST(substr(coalesce(resolved_id, 'svc_-1'), 5) AS INTEGER) % 6 = 5 AS unlisted FROM targets),
found AS (
  SELECT reference, layer_index, row_number() OVER () AS request, CASE WHEN NOT unlisted THEN resolved_id END AS resolved_id,
         CASE WHEN NOT unlisted OR kind = 'service_url' THEN resolved_id END AS target FROM wanted)
SELECT t.reference, t.resolved_id, t.layer_index, count(c.item_id) > 0 AS ok,
       CASE WHEN t.target IS NULL THEN 'reference is not known'
            WHEN count(c.item_id) = 0 THEN 'no layer ' || t.layer_index END AS error,
       count(c.item_id) AS layers_counted, CAST(coalesce(sum(c.row_count), 0) AS BIGINT) AS total_count
FROM found t LEFT JOIN counts c ON c.item_id = t.target AND (
    t.layer_index IS NULL OR (c.layer_kind = 'layer' AND c.layer_index = t.layer_index))
GROUP BY t.request, t.reference, t.resolved_id, t.target, t.layer_index""",
        _COUNTS, _REQUESTS,
    ),
    "layer_count_details": _with(
        """SELECT t.reference, c.item_id, c.layer_kind, c.layer_index, c.layer_name, c.row_count, c.error
FROM (SELECT DISTINCT * FROM targets) t JOIN counts c ON c.item_id = t.resolved_id AND (
    t.layer_index IS NULL OR (c.layer_kind = 'layer' AND c.layer_index = t.layer_index))""",
        _COUNTS, _REQUESTS,
    ),
    "layer_extent": _with(
        f"SELECT item_id, layer_kind, layer_index, {_BOX} FROM features GROUP BY ALL", _FEATURES
    ),
    "layer_bounds_check": _with(
        """SELECT item_id, layer_kind, layer_index, bool_or(coalesce(abs(x) > 185 OR abs(y) > 95, FALSE)) AS bounds_bad
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, layer_kind, layer_index ORDER BY feature_id) AS rn FROM shifted)
WHERE rn <= 5 GROUP BY ALL""",
        _SHIFTED,
    ),
    "layer_diagnose": _with(
        f"""SELECT item_id, layer_kind, layer_index, {_BOX},
       coalesce(min(x) BETWEEN -180 AND 180 AND min(y) BETWEEN -90 AND 90, FALSE) AS is_lat_lon
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, layer_kind, layer_index ORDER BY feature_id) AS rn FROM shifted)
WHERE rn <= 100 GROUP BY item_id, layer_kind, layer_index""",
        _SHIFTED,
    ),
    "layer_preview": _with(
        f"""SELECT item_id, layer_kind, layer_index, feature_id,
       {_GEOJSON} || ',"class_value":"' || class_value || '"}}}}' AS feature
FROM features WHERE layer_kind = 'layer' AND measure > 0
QUALIFY row_number() OVER (PARTITION BY item_id, layer_index ORDER BY feature_id) <= 50""",
        _FEATURES,
    ),
    "layer_preview_one": _with(
        f"""SELECT item_id, layer_kind, layer_index, feature_id,
       {_GEOJSON} || ',"class_value":"' || class_value || '"}}}}' AS feature
FROM features WHERE layer_kind = 'layer' AND item_id = 'svc_3' AND layer_index = 1 ORDER BY feature_id LIMIT 300""",
        _FEATURES,
    ),
    "layer_preview_documents": _with(
        f"""SELECT item_id, layer_kind, layer_index, '{{"type":"FeatureCollection","features":[' ||
       string_agg({_GEOJSON} || '}}}}', ',' ORDER BY feature_id) || ']}}' AS geojson,
       CAST(count(*) AS INTEGER) AS n_features
FROM (SELECT * FROM features WHERE layer_kind = 'layer' AND measure > 0
      QUALIFY row_number() OVER (PARTITION BY item_id, layer_index ORDER BY feature_id) <= 20)
GROUP BY item_id, layer_kind, layer_index""",
        _FEATURES,
    ),
    "layer_preview_parts": _with(
        f""", sized AS (
  SELECT *, strlen(feature) + 1 AS bytes FROM (
    SELECT item_id, layer_kind, layer_index, feature_id, {_GEOJSON} || ',"class_value":"' || class_value || '"}}}}' AS feature FROM features)),
cut AS (
  SELECT *, (sum(bytes) OVER (PARTITION BY item_id, layer_kind, layer_index ORDER BY feature_id) - 1) // {(PART_BYTES - 42) // 2} AS part FROM sized)
SELECT item_id, layer_kind, layer_index, min(feature_id) AS first_feature, CAST(count(*) AS INTEGER) AS n_features,
       '{{"type":"FeatureCollection","features":[' || string_agg(feature, ',' ORDER BY feature_id) || ']}}' AS geojson
FROM cut GROUP BY item_id, layer_kind, layer_index, part""",
        _FEATURES,
    ),
    "layer_preview_status": _with(
        f""", head AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, layer_index ORDER BY feature_id) AS rn
  FROM shifted WHERE layer_kind = 'layer' AND measure > 0),
shown AS (
  SELECT item_id, layer_index, {_BOX}, count(*) AS n,
         bool_or(rn <= 5 AND coalesce(abs(x) > 185 OR abs(y) > 95, FALSE)) AS off
  FROM head WHERE rn <= 50 GROUP BY item_id, layer_index),
asked AS (SELECT reference, resolved_id AS item_id, coalesce(layer_index, 0) AS layer_index FROM targets),
judged AS (
  SELECT a.*, l.layer_name, l.geometry_type, s.* EXCLUDE (item_id, layer_index),
         CASE WHEN a.item_id IS NULL THEN 'reference is not known'
              WHEN CAST(substr(a.item_id, 5) AS INTEGER) % 5 = 4 THEN 'no preview of item type Web Map'
              WHEN a.layer_index > 1 THEN 'no layer ' || a.layer_index || ' among 2'
              WHEN l.error IS NOT NULL THEN 'layer cannot be read: ' || l.error
              WHEN s.off THEN 'coordinates are not longitude and latitude' END AS error
  FROM asked a
  LEFT JOIN (SELECT * FROM layers WHERE layer_kind = 'layer') l ON l.item_id = a.item_id AND l.layer_index = a.layer_index
  LEFT JOIN shown s ON s.item_id = a.item_id AND s.layer_index = a.layer_index)
SELECT reference, item_id, layer_index, concat_ws(':', item_id, layer_index) AS layer_key, error IS NULL AS ok, error,
       layer_name, geometry_type,
       CASE WHEN error IS NULL THEN xmin END AS xmin, CASE WHEN error IS NULL THEN ymin END AS ymin,
       CASE WHEN error IS NULL THEN xmax END AS xmax, CASE WHEN error IS NULL THEN ymax END AS ymax,
       CASE WHEN error IS NULL THEN coalesce(n, 0) END AS n_features FROM judged""",
        _SHIFTED, _LAYERS, _REQUESTS,
    ),
    "preview_refresh": _with(
        f"""SELECT o.item_id, o.layer_index,
       CASE WHEN n.item_id LIKE '%7' THEN o.layer_name ELSE n.layer_name END AS layer_name, o.geometry_type,
       CASE WHEN n.item_id LIKE '%7' THEN o.geojson ELSE n.geojson END AS geojson,
       {", ".join(_kept(c) for c in ("xmin", "ymin", "xmax", "ymax"))}
FROM shown_old o JOIN shown_new n ON n.item_id = o.item_id AND n.layer_index = o.layer_index""",
        _FEATURES, _shown(10, "old"), _shown(30, "new"),
    ),
    "class_style_lookup": _with("SELECT * FROM styled", _STYLED),
    "class_style_composite": _with(
        """SELECT feature_id, item_id, layer_index,
       CASE WHEN red IS NOT NULL THEN printf('#%02x1428', CAST(red AS INTEGER)) END AS fill_color,
       CASE WHEN red IS NULL THEN 'black' ELSE '#000009' END AS color, CAST(CASE WHEN red IS NOT NULL THEN 3 END AS DOUBLE) AS weight,
       CAST(CASE WHEN red IS NOT NULL THEN 1 END AS DOUBLE) AS fill_opacity, CAST(CASE WHEN red IS NOT NULL THEN 1 END AS DOUBLE) AS opacity
FROM (SELECT *, CASE WHEN layer_index < 2 THEN CAST(substr(item_id, 5) AS INTEGER)
        + 10 * (list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE'], class_value) - 1) END AS red FROM features)""",
        _FEATURES,
    ),
    "style_diversity": _with(
        """SELECT item_id, layer_index, count(DISTINCT fill_color) AS n_colors,
       coalesce(string_agg(DISTINCT fill_color, ',' ORDER BY fill_color), '') AS colors
FROM styled GROUP BY item_id, layer_index""",
        _STYLED,
    ),
    "html_to_text": _html_sql(),
    "html_to_text_hostile": _html_sql(
        """html || '<script>s = ''<!--''</script> seen <!-- <b> --> after <i title="a > b">x</i>' || CASE page_id % 4 WHEN 0 THEN '<script>var x = 1;'
           WHEN 1 THEN ' tail <!-- hidden' WHEN 2 THEN ' tail <a href="x' ELSE ' tail <style' END"""
    ),
    "layer_ref_parse": _with(
        """SELECT k AS ref_no, CASE WHEN form IN (0, 2, 3, 4, 5) THEN 'service_url' ELSE 'item_id' END AS kind,
       CASE form WHEN 0 THEN 'https://svc.example.org/rest/' || k || '/FeatureServer'
                 WHEN 2 THEN host || '/FeatureServer' WHEN 3 THEN host || '/FeatureServer/'
                 WHEN 4 THEN host || '/FeatureServer/' || (k % 12) WHEN 5 THEN host || '/MapServer/2' END AS url,
       CASE WHEN form = 1 THEN viewer || 'url=' WHEN form IN (6, 7) THEN md5(CAST(k AS VARCHAR)) END AS item_id,
       CAST(CASE WHEN form IN (0, 2, 3) THEN 0 END AS INTEGER) AS layer_index,
       CASE WHEN form IN (1, 6, 7) THEN 'item' WHEN form IN (4, 5) THEN 'layer' ELSE 'collection' END AS target_class
FROM refs""",
        _REFERENCES,
    ),
    "text_ref_extract": _with(
        """SELECT conv_id, turn, CASE form WHEN 0 THEN item WHEN 1 THEN 'https://a.example.org/x/FeatureServer/3'
       WHEN 2 THEN item WHEN 3 THEN trim(text || ' map this /MapServer thing', E' \\t\\n\\r')
       WHEN 4 THEN trim(text || ' https://m.example.org/apps/mapviewer/index.html?url=https://a/FeatureServer', E' \\t\\n\\r')
       END AS reference FROM messages""",
        _MESSAGES,
    ),
    "message_intent": _with(
        """SELECT conv_id, turn,
       form IN (1, 3) OR regexp_matches(lower(text), 'visualize|preview|map this') AS wants_preview,
       form IN (0, 2) OR regexp_matches(lower(text), 'count rows|how many rows|record count|how many records') AS wants_count
FROM messages""",
        _MESSAGES,
    ),
}
