"""The queries of the general data-processing operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayweft.operators import nested, orphans, packed, proximity, snapshots
from wayweft.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Ways added, removed or changed between consecutive exports."""
    return snapshots.tag_changes(table(spark, d, "way_snapshots"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes at most 10 m apart, and junctions inside regions."""
    near = proximity.near_nodes(table(spark, d, "osm_nodes"))
    inside = proximity.junction_regions(table(spark, d, "jcts"), table(spark, d, "regions"))
    return near.unionByName(inside)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Children of every element of the nested payloads."""
    return nested.children(nested.flatten_elements(table(spark, d, "osm_raw"), "raw_id", "payload"))


def p3_identities(spark: SparkSession, d: str) -> DataFrame:
    """How often every distinct element occurs."""
    return nested.identities(nested.flatten_elements(table(spark, d, "osm_raw"), "raw_id", "payload"))


def p3_elements(spark: SparkSession, d: str) -> DataFrame:
    """How often every element occurs, in whatever state: elem_type, elem_id, n_occurrences, n_payloads."""
    return nested.element_counts(nested.flatten_elements(table(spark, d, "osm_raw"), "raw_id", "payload"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Street names packed in one field, one per row."""
    return packed.street_names(table(spark, d, "rlis_streets"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "osm_ways"), table(spark, d, "jcts"), table(spark, d, "osm_nodes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a live node, by month of delivery."""
    return _p5(spark, d)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and keys per table and month."""
    return orphans.orphan_report(_p5(spark, d))


def p5_heavy(spark: SparkSession, d: str) -> DataFrame:
    """Keys with so many references that they are checked by broadcast."""
    return orphans.heavy_keys(table(spark, d, "osm_ways"), table(spark, d, "jcts"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p3_found, p3_identities, p3_elements, p4_found, p5_found, p5_report, p5_heavy)
}

_P5 = """
WITH refs AS (
  SELECT DISTINCT 'osm_ways' AS ref_table, date_trunc('month', loaded_at) AS m, id AS ref_id, unnest(nodes) AS node_id FROM osm_ways
  UNION SELECT DISTINCT 'jcts', date_trunc('month', loaded_at), jct_id, node_id FROM jcts),
keys AS (SELECT DISTINCT node_id, m FROM refs WHERE node_id IS NOT NULL AND m IS NOT NULL),
live AS (SELECT k.node_id, k.m, arg_max(coalesce(n.visible, true), coalesce(n.version, -1) * 2 + CASE WHEN coalesce(n.visible, true) THEN 1 ELSE 0 END) AS ok
  FROM keys k JOIN osm_nodes n ON n.id = k.node_id AND date_trunc('month', n.loaded_at) <= k.m GROUP BY 1, 2),
found AS (SELECT DISTINCT r.ref_table, strftime(r.m, '%Y-%m') AS period, r.ref_id, r.node_id
  FROM refs r JOIN keys k ON r.node_id = k.node_id AND r.m = k.m LEFT JOIN live l ON l.node_id = r.node_id AND l.m = r.m WHERE l.ok IS NULL OR NOT l.ok)
"""

_P3_TREE = r"""
WITH RECURSIVE plain AS (
  SELECT raw_id, payload::JSON AS j FROM osm_raw WHERE json_valid(payload)
  UNION ALL SELECT raw_id, (j->>'$')::JSON FROM plain WHERE json_type(j) = 'VARCHAR' AND json_valid(j->>'$')),
tree AS (SELECT raw_id, t.value AS v FROM plain, json_tree(plain.j) t WHERE json_type(plain.j) IN ('OBJECT', 'ARRAY') AND t.type = 'OBJECT' AND NOT regexp_matches(t.fullkey, '\.(meta|tags|nodes)($|[.\[])')),"""
_P3 = _P3_TREE + r"""
e AS (SELECT DISTINCT raw_id, v->>'type' AS parent_type, try_cast(v->>'id' AS BIGINT) AS parent_id, v FROM tree WHERE v->>'type' IN ('node', 'way', 'group') AND try_cast(v->>'id' AS BIGINT) IS NOT NULL),
item AS (SELECT raw_id, parent_type, parent_id, x.value AS i FROM e, json_each(e.v->'tags') x WHERE json_type(e.v->'tags') = 'ARRAY' AND x.type = 'OBJECT'),
walk AS (
  SELECT raw_id, parent_type, parent_id, x.key AS key, x.value AS value FROM e, json_each(e.v->'tags') x WHERE json_type(e.v->'tags') = 'OBJECT'
  UNION ALL SELECT raw_id, parent_type, parent_id, i->>'k', i->'v' FROM item WHERE json_exists(i, '$.k')
  UNION ALL SELECT raw_id, parent_type, parent_id, x.key, x.value FROM item, json_each(item.i) x WHERE NOT json_exists(i, '$.k')
  UNION ALL SELECT raw_id, parent_type, parent_id, CASE WHEN json_type(w.value) = 'OBJECT' THEN w.key || ':' || x.key ELSE w.key END, x.value FROM walk w, json_each(w.value) x WHERE json_type(w.value) IN ('OBJECT', 'ARRAY'))
SELECT DISTINCT raw_id, parent_type, parent_id, 'tag' AS child, key AS child_key, value->>'$' AS child_value FROM walk WHERE key IS NOT NULL AND json_type(value) NOT IN ('OBJECT', 'ARRAY', 'NULL')
UNION SELECT raw_id, parent_type, parent_id, 'node', x.key, try_cast(CASE WHEN x.type = 'OBJECT' THEN x.value->>'ref' ELSE x.value->>'$' END AS BIGINT)::VARCHAR FROM e, json_each(e.v->'nodes') x
  WHERE json_type(e.v->'nodes') = 'ARRAY' AND try_cast(CASE WHEN x.type = 'OBJECT' THEN x.value->>'ref' ELSE x.value->>'$' END AS BIGINT) IS NOT NULL
UNION SELECT raw_id, parent_type, parent_id, 'element', c->>'type', try_cast(c->>'id' AS BIGINT)::VARCHAR FROM (
  SELECT e.*, x.value AS c FROM e, json_each(e.v->'elements') x WHERE parent_type = 'group' AND json_type(e.v->'elements') = 'ARRAY' UNION ALL SELECT e.*, v->'elements' FROM e WHERE parent_type = 'group' AND json_type(e.v->'elements') = 'OBJECT')
  WHERE json_type(c) = 'OBJECT' AND c->>'type' IN ('node', 'way', 'group') AND try_cast(c->>'id' AS BIGINT) IS NOT NULL"""

_BLANK = r"[ \t\n\r\f\v]"
_PIECE = r'("(?:[^"]|"")*"|“[^”]*”|[0-9](?:/[0-9])+|[^;,|&/\t\n\r%s])+'
_P4 = f"""
WITH last AS (SELECT objectid, streetname AS s, ftype FROM rlis_streets QUALIFY row_number() OVER (PARTITION BY objectid ORDER BY loaded_at DESC NULLS LAST, streetname DESC NULLS LAST, ftype DESC NULLS LAST) = 1),
pieces AS (SELECT objectid, CASE WHEN upper(trim(ftype)) = 'RAMP' THEN regexp_extract_all(s, '{_PIECE % "-"}') ELSE regexp_extract_all(s, '{_PIECE % ""}') END AS p FROM last WHERE s IS NOT NULL),
cut AS (SELECT objectid, list_transform(p, lambda v: regexp_replace(v, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS p FROM pieces),
plain AS (SELECT objectid, list_filter(list_transform(p, lambda v: CASE WHEN regexp_full_match(v, '"(?:[^"]|"")*"') THEN trim(replace(v[2:-2], '""', '"')) WHEN regexp_full_match(v, '“[^”]*”') THEN trim(v[2:-2]) ELSE v END), lambda v: v <> '') AS v FROM cut)
SELECT objectid, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS value FROM plain WHERE len(v) >= 2"""

SQL: dict[str, str] = {
    "p1_found": r"""
WITH canon AS (
  SELECT snap_date, id, loaded_at, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(tags, lambda t: t IS NOT NULL),
    lambda t: to_json([t.k, regexp_replace(t.v, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')])::VARCHAR))), ','), '') AS c
  FROM way_snapshots WHERE snap_date IS NOT NULL AND id IS NOT NULL),
cur AS (SELECT snap_date, id, c FROM canon QUALIFY row_number() OVER (PARTITION BY snap_date, id ORDER BY loaded_at DESC NULLS LAST, c DESC) = 1),
dates AS (SELECT snap_date, row_number() OVER (ORDER BY snap_date) AS no FROM (SELECT DISTINCT snap_date FROM cur)),
n AS (SELECT cur.*, no FROM cur JOIN dates USING (snap_date)),
pairs AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.no, b.no + 1) AS no, a.id IS NOT NULL AS has_new, b.id IS NOT NULL AS has_old, a.c AS ca, b.c AS cb
  FROM n a FULL JOIN n b ON a.id = b.id AND a.no = b.no + 1)
SELECT strftime(d.snap_date, '%Y-%m-%d') AS snap_date, p.id, CASE WHEN NOT has_old THEN 'added' WHEN NOT has_new THEN 'removed' ELSE 'changed' END AS change_kind
FROM pairs p JOIN dates d ON d.no = p.no WHERE p.no > 1 AND (NOT has_old OR NOT has_new OR ca <> cb)""",
    "p2_found": """
WITH cur AS (SELECT id, lon, lat FROM (SELECT * FROM osm_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, loaded_at DESC NULLS LAST, visible DESC, lon DESC, lat DESC) = 1)
  WHERE visible AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0)),
g AS (SELECT *, floor(lat * 10000)::BIGINT AS cy, CASE WHEN abs(lat) > 84 THEN 0 ELSE (floor(lon * 1000)::BIGINT + 720000) % 360000 END AS cx FROM cur),
probe AS (SELECT DISTINCT a.*, a.cy + dy.y AS jy, CASE WHEN abs(a.cy + dy.y + 0.5) > 840000 THEN 0 ELSE (a.cx + dx.x + 360000) % 360000 END AS jx FROM g a, (VALUES (-1), (0), (1)) dy(y), (VALUES (-1), (0), (1)) dx(x)),
near AS (SELECT a.id AS a_id, b.id AS b_id FROM probe a JOIN g b ON b.cy = a.jy AND b.cx = a.jx AND a.id < b.id
  WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 10),
rings AS (SELECT region_id, unnest(rings) AS ring FROM regions),
edges AS (SELECT region_id, unnest(list_zip(ring[1:len(ring) - 1], ring[2:])) AS e FROM rings),
p AS (SELECT DISTINCT jct_id, point.x AS x, point.y AS y FROM jcts WHERE point IS NOT NULL),
sides AS (SELECT region_id, jct_id, x, y, count(*) AS n FROM (SELECT region_id, e[1].x AS x0, e[1].y AS y0, e[2].x AS x1, e[2].y AS y1 FROM edges) e
  JOIN p ON (y0 > y) <> (y1 > y) WHERE x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 GROUP BY ALL)
SELECT 'near' AS kind, a_id, b_id FROM near UNION ALL SELECT DISTINCT 'in', region_id, jct_id FROM sides WHERE n % 2 = 1""",
    "p3_found": _P3,
    "p3_elements": _P3_TREE + """
x AS (SELECT raw_id, v->>'type' AS elem_type, try_cast(v->>'id' AS BIGINT) AS elem_id FROM tree)
SELECT elem_type, elem_id, count(*) AS n_occurrences, count(DISTINCT raw_id) AS n_payloads FROM x WHERE elem_type IN ('node', 'way', 'group') AND elem_id IS NOT NULL GROUP BY 1, 2""",
    "p4_found": _P4,
    "p5_found": _P5 + "SELECT * FROM found",
    "p5_report": _P5 + "SELECT ref_table, period, count(*) AS n_refs, count(DISTINCT node_id) AS n_keys FROM found GROUP BY 1, 2",
    "p5_heavy": """
WITH refs AS (SELECT unnest(list_distinct(nodes)) AS node_id FROM osm_ways WHERE loaded_at IS NOT NULL UNION ALL SELECT node_id FROM jcts WHERE loaded_at IS NOT NULL),
n AS (SELECT node_id, count(*) AS n_refs FROM refs WHERE node_id IS NOT NULL GROUP BY 1)
SELECT * FROM n WHERE n_refs * 10000 >= (SELECT sum(n_refs) FROM n)""",
}
