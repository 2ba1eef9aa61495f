"""The same results in plain SQL, for checking the Spark jobs against DuckDB.

``build(name)`` returns one statement: the named final query with the common
table expressions it needs, in order. Distances are brute force on purpose.
"""

from __future__ import annotations

import re

from . import rules, testbed

CTE: dict[str, str] = {}
FINAL: dict[str, str] = {}


def build(name: str) -> str:
    order: list[str] = []
    seen: set[str] = set()

    def need(sql: str) -> None:
        for word in re.findall(r"\b[a-z_0-9]+\b", sql):
            if word in CTE and word not in seen:
                seen.add(word)
                need(CTE[word])
                order.append(word)

    need(FINAL[name])
    recursive = "RECURSIVE " if any("UNION ALL" in CTE[c] and re.search(rf"\b{c}\b", CTE[c]) for c in order) else ""
    head = ",\n".join(f"{c} AS (\n{CTE[c]}\n)" for c in order)
    return (f"WITH {recursive}{head}\n" if head else "") + FINAL[name]


def statements() -> dict[str, str]:
    return {name: build(name) for name in FINAL}


def duck(spark_text: str) -> str:
    return spark_text.replace(" div ", " // ")


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def case_map(expr: str, table: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    )
    return f"(12742000 * atan2(sqrt({h}), sqrt(1 - {h})))"


def metres(expr: str) -> str:
    return f"CAST(floor({expr} + 0.5) AS BIGINT)"


def tag(key: str, column: str = "tags") -> str:
    return f"([x.value FOR x IN {column} IF x.key = {quote(key)}])[1]"


# --- base tables -------------------------------------------------------------
CTE["points"] = """
SELECT 't' || track_idx AS track_id, track_idx, seq, ts,
  CASE WHEN track_idx = 0 THEN 43.02e0 + 4e-2 * (seq // 4000) + sin((seq % 4000) * 1e-2) * 5e-3
       ELSE 43 + 5e-2 * ((track_idx - 1) % 20) + seq * 45e-5 END AS lat,
  CASE WHEN track_idx = 0 THEN 9e-1 + (seq % 4000) * 3e-4
       ELSE 1 + 3e-1 * ((track_idx - 1) // 20) + sin(seq * 1e-2) * 5e-3 + seq * 45e-5 END AS lon,
  CASE WHEN event_type = 'error' AND track_idx % 4 = 1 THEN NULL ELSE value * 12345e-4 END AS ele
FROM (
  SELECT event_type, value, ts,
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + (event_id - event_id // 3 - 1) // 400 END AS track_idx,
    CASE WHEN event_id % 3 = 0 THEN event_id // 3 ELSE (event_id - event_id // 3 - 1) % 400 END AS seq
  FROM events)"""
CTE["segs"] = f"""
SELECT *, {hav('a_lat', 'a_lon', 'b_lat', 'b_lon')} AS len FROM (
  SELECT track_id, track_idx, seq AS seg_idx, lat AS a_lat, lon AS a_lon, ele AS a_ele,
    lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon, lead(ele) OVER w AS b_ele
  FROM points WINDOW w AS (PARTITION BY track_id ORDER BY seq)) WHERE b_lat IS NOT NULL"""
CTE["measured"] = """
SELECT *, cum_end - len AS cum_start0, coalesce(lag(cum_end) OVER (PARTITION BY track_id ORDER BY seg_idx), 0) AS cum_start,
  max(cum_end) OVER (PARTITION BY track_id) AS total
FROM (SELECT *, sum(len) OVER (PARTITION BY track_id ORDER BY seg_idx) AS cum_end FROM segs)"""
CTE["rule_rows"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({n}, {quote(c)}, {r}, {str(d).lower()}, {quote(k)}, {quote(v)}, {quote(i)})"
        for n, (c, r, d, k, v, i) in enumerate(rules.rule_rows())
    )
    + ") AS t(idx, category, rank, default_enabled, key, value, icon)"
)
_TAG_ROWS = testbed._TAGS.strip()
_TAG_ROWS = re.sub(r"^filter\(array\(", "[x FOR x IN [", _TAG_ROWS)
_TAG_ROWS = re.sub(r"\), x -> x.value IS NOT NULL\)$", "] IF x.value IS NOT NULL]", _TAG_ROWS)
_TAG_ROWS = re.sub(r"struct\((.*?) AS key,\s*(.*?) AS value\)", r"{'key': \1, 'value': \2}", _TAG_ROWS, flags=re.S)
_TAG_ROWS = _TAG_ROWS.replace("r1.", "r1_").replace("r2.", "r2_")
CTE["elements"] = f"""
SELECT CASE k % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS type, k AS id, k AS ord, k % 17 AS k17,
  43 + ((kb * 7919) % 3000) / 3e3 * 12e-1 + shift AS lat,
  1 + 3e-1 * (kb // 3000) + ((kb * 104729) % 2999) / 2999e0 * 25e-2 AS lon,
  {_TAG_ROWS} AS tags
FROM (
  SELECT b.*, r1.key AS r1_key, r1.value AS r1_value, r2.key AS r2_key, r2.value AS r2_value FROM (
    SELECT c_custkey AS k, c_name,
      CASE WHEN (c_custkey // 4) % 3 = 0 THEN c_custkey - c_custkey % 4 ELSE c_custkey END AS kb,
      CASE WHEN (c_custkey // 4) % 6 = 3 THEN (c_custkey % 4) * 4e-4 ELSE 0e0 END AS shift
    FROM customer) b
  JOIN rule_rows r1 ON r1.idx = b.kb % 81 JOIN rule_rows r2 ON r2.idx = (b.k * 7 + 3) % 81)"""
CTE["pois"] = f"""
SELECT poi_id, osm_type, osm_id, lat, lon, tags, ord, r.category, r.icon,
  coalesce(nullif({tag('name')}, ''), upper(substr(replace(r.value, '_', ' '), 1, 1)) || substr(replace(r.value, '_', ' '), 2)) AS name
FROM (
  SELECT e.type || '/' || e.id AS poi_id, e.type AS osm_type, e.id AS osm_id, e.lat, e.lon, e.tags, e.ord,
    arg_min(r.idx, t.pos) AS hit
  FROM elements e, (SELECT id AS eid, unnest(range(1, len(tags) + 1)) AS pos FROM elements) t, rule_rows r
  WHERE t.eid = e.id AND r.key = e.tags[t.pos].key AND r.value = e.tags[t.pos].value AND (e.type = 'node' OR e.k17 <> 0)
  GROUP BY ALL) p JOIN rule_rows r ON r.idx = p.hit"""
CTE["pair_dist"] = f"""
SELECT poi_id, track_idx, track_id, seg_idx, cum_start + t * len AS along,
  {hav('lat', 'lon', 'a_lat + t * (b_lat - a_lat)', 'a_lon + t * (b_lon - a_lon)')} AS d,
  CASE WHEN seg_idx = max_seg THEN {hav('lat', 'lon', 'b_lat', 'b_lon')} END AS d_last
FROM (
  SELECT p.poi_id, p.lat, p.lon, s.*, max(seg_idx) OVER (PARTITION BY poi_id, track_id) AS max_seg,
    greatest(0, least(1, ((p.lon - a_lon) * (b_lon - a_lon) + (p.lat - a_lat) * (b_lat - a_lat))
      / ((b_lon - a_lon) * (b_lon - a_lon) + (b_lat - a_lat) * (b_lat - a_lat)))) AS t
  FROM pois p, measured s)"""
CTE["track_dist"] = """
SELECT poi_id, track_idx, track_id, least(min(d), coalesce(min(d_last), min(d))) AS d,
  arg_min(along, {'d': d, 's': seg_idx}) AS along
FROM pair_dist GROUP BY 1, 2, 3"""
CTE["nearest"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY d, track_idx) AS rn FROM track_dist WHERE d <= 1500)
WHERE rn = 1"""
CTE["corridor"] = """
SELECT p.*, n.track_id, n.track_idx, n.d, n.along FROM pois p JOIN nearest n USING (poi_id)"""

# --- tracks -----------------------------------------------------------------------
FINAL["track_segments"] = f"SELECT track_id, seg_idx, {metres('len * 1000')} AS seg_len_mm FROM segs"
FINAL["track_length"] = f"""
SELECT track_id, {metres('coalesce(sum(len), 0)')} AS total_distance_m, CAST(count(*) + 1 AS BIGINT) AS n_points FROM segs GROUP BY 1"""
FINAL["track_cumdist"] = f"""
SELECT track_id, seg_idx AS seq, {metres('cum_start')} AS cum_m FROM measured
UNION ALL SELECT track_id, max(seg_idx) + 1, {metres('max(cum_end)')} FROM measured GROUP BY 1"""
FINAL["elevation_stats"] = """
SELECT track_id, CASE WHEN bool_or(b_ele IS NULL OR a_ele IS NULL) THEN 0
    ELSE CAST(floor(coalesce(sum(CASE WHEN b_ele - a_ele >= 2 THEN b_ele - a_ele END), 0) + 0.5) AS BIGINT) END AS elevation_gain_m,
  CASE WHEN bool_or(b_ele IS NULL OR a_ele IS NULL) THEN 0
    ELSE CAST(floor(coalesce(sum(CASE WHEN a_ele - b_ele >= 2 THEN a_ele - b_ele END), 0) + 0.5) AS BIGINT) END AS elevation_loss_m
FROM segs GROUP BY 1"""
CTE["targets"] = """
SELECT track_id, track_idx, n, total, unnest(range(0, n)) AS i FROM (
  SELECT track_id, track_idx, max(total) AS total, greatest(2, CAST(floor(max(total) / 500 + 0.5) AS BIGINT)) AS n
  FROM measured GROUP BY 1, 2)"""
CTE["resampled"] = """
SELECT g.track_id, g.track_idx, g.i AS seq, g.n, a_lat + f * (b_lat - a_lat) AS lat, a_lon + f * (b_lon - a_lon) AS lon
FROM (
  SELECT g.*, s.*, (g.i / (g.n - 1)::DOUBLE * g.total - s.cum_start) / (s.cum_end - s.cum_start) AS f
  FROM targets g JOIN measured s ON s.track_id = g.track_id
    AND g.i / (g.n - 1)::DOUBLE * g.total <= s.cum_end
    AND (g.i / (g.n - 1)::DOUBLE * g.total > s.cum_start OR (g.i = 0 AND s.seg_idx = 0))) g"""
FINAL["resample_track"] = f"""
SELECT track_id, seq, {metres('lat * 1e6')} AS lat_e6, {metres('lon * 1e6')} AS lon_e6 FROM resampled"""
FINAL["track_bbox"] = """
SELECT CAST(floor(min(lat) * 1e6 + 0.5) AS BIGINT) AS min_lat_e6, CAST(floor(max(lat) * 1e6 + 0.5) AS BIGINT) AS max_lat_e6,
  CAST(floor(min(lon) * 1e6 + 0.5) AS BIGINT) AS min_lon_e6, CAST(floor(max(lon) * 1e6 + 0.5) AS BIGINT) AS max_lon_e6 FROM points"""
FINAL["track_rollup"] = """
SELECT t.track_id, CAST(sum(t.n_points) AS BIGINT) AS n_points, CAST(sum(r.n) AS BIGINT) AS n_resampled,
  CAST(floor(sum(t.total) + 0.5) AS BIGINT) AS total_distance_m
FROM (SELECT track_id, count(*) + 1 AS n_points, sum(len) AS total FROM segs GROUP BY 1) t
JOIN (SELECT track_id, max(n) AS n FROM targets GROUP BY 1) r USING (track_id) GROUP BY ROLLUP (t.track_id)"""
FINAL["track_chunks"] = """
SELECT track_id, chunk, CAST(least(50, n - chunk * 47) AS BIGINT) AS n_points, chunk * 47 AS first_seq,
  least(chunk * 47 + 50, n) - 1 AS last_seq
FROM (SELECT track_id, n, unnest(range(0, CASE WHEN n <= 50 THEN 1 ELSE (n + 46) // 47 END)) AS chunk
      FROM (SELECT track_id, max(n) AS n FROM resampled GROUP BY 1))
WHERE least(50, n - chunk * 47) >= 2"""

# --- categories and corridor ----------------------------------------------------------
FINAL["osm_dedup"] = """
SELECT type, id, chunk, label FROM (
  SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY chunk, pos) AS rn FROM (
    SELECT type, id, (id * 5 + c * 3) % 11 AS chunk, id * 3 + c AS pos, id || ':' || c AS label
    FROM elements, range(0, 3) AS g(c) WHERE c <= id % 3)) WHERE rn = 1"""
FINAL["categorize"] = f"""
SELECT poi_id, osm_type, osm_id, category, name, icon, {metres('lat * 1e6')} AS lat_e6, {metres('lon * 1e6')} AS lon_e6,
  CAST(len(tags) AS INT) AS n_tags FROM pois"""
FINAL["tag_predicates"] = """
SELECT r.key, string_agg(DISTINCT r.value, '|' ORDER BY r.value) AS wanted, max(e.n) AS n_elements
FROM rule_rows r LEFT JOIN (
  SELECT t.key, count(DISTINCT id) AS n FROM (SELECT id, unnest(tags) AS t FROM elements)
  JOIN rule_rows rr ON rr.key = t.key AND rr.value = t.value AND rr.category IN ('Water', 'Gears', 'Wifi') GROUP BY 1) e ON e.key = r.key
WHERE r.category IN ('Water', 'Gears', 'Wifi') GROUP BY 1"""
FINAL["segment_distance"] = f"""
SELECT p.poi_id, s.seg_idx, {metres('d')} AS distance_m FROM pair_dist s JOIN pois p USING (poi_id)
WHERE d <= 300"""
FINAL["distance_to_track"] = f"SELECT poi_id, track_id, {metres('d')} AS distance_m FROM track_dist WHERE d <= 1500"
FINAL["corridor_runs"] = f"""
SELECT run_id, poi_id, {metres('d')} AS distance_m FROM (
  SELECT 'run' || (track_idx % 3) AS run_id, poi_id, min(d) AS d FROM track_dist WHERE d <= 1500 GROUP BY 1, 2)"""
FINAL["corridor_join"] = f"""
SELECT poi_id, track_id, {metres('d')} AS distance_m, {metres('along')} AS along_m FROM track_dist WHERE d <= 300"""
FINAL["along_track"] = f"SELECT poi_id, track_id, {metres('along')} AS along_m FROM nearest"
CTE["dedup_in"] = """
SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS n,
  greatest(50, CASE WHEN total >= 1200 THEN 120 WHEN total >= 700 THEN 80 WHEN total >= 300 THEN 60 ELSE 0 END) AS radius
FROM (SELECT *, count(*) OVER () AS total FROM corridor)"""
CTE["walk"] = f"""
SELECT category, 0::BIGINT AS n, []::STRUCT(o BIGINT, y DOUBLE, x DOUBLE)[] AS leaders, NULL::BIGINT AS ord, NULL::BIGINT AS leader
FROM (SELECT DISTINCT category FROM dedup_in WHERE category NOT IN {in_list(rules.NEVER_MERGED)})
UNION ALL
SELECT category, n, CASE WHEN hit IS NULL THEN list_append(leaders, {{'o': ord, 'y': lat, 'x': lon}}) ELSE leaders END, ord, coalesce(hit, ord)
FROM (
  SELECT w.category, d.n, w.leaders, d.ord, d.lat, d.lon,
    ([l.o FOR l IN w.leaders IF {hav('l.y', 'l.x', 'd.lat', 'd.lon')} <= d.radius])[1] AS hit
  FROM walk w JOIN dedup_in d ON d.category = w.category AND d.n = w.n + 1)"""
CTE["deduped"] = f"""
SELECT d.*, m.n_merged FROM corridor d JOIN (
  SELECT c.category, w.leader, arg_max(c.poi_id, {{'t': len(c.tags), 'o': -c.ord}}) AS poi_id, count(*) AS n_merged
  FROM walk w JOIN corridor c ON c.ord = w.ord WHERE w.ord IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT category, ord, poi_id, 1 FROM corridor WHERE category IN {in_list(rules.NEVER_MERGED)}) m ON m.poi_id = d.poi_id"""
FINAL["poi_dedup"] = "SELECT poi_id, category, CAST(n_merged AS BIGINT) AS n_merged FROM deduped"
FINAL["corridor_pois"] = f"""
SELECT poi_id, category, name, icon, track_id, {metres('d')} AS distance_m, {metres('along')} AS along_m FROM deduped"""
FINAL["adaptive_radius"] = """
SELECT run_id, count(*) AS n_pois,
  CAST(greatest(50, CASE WHEN count(*) >= 1200 THEN 120 WHEN count(*) >= 700 THEN 80 WHEN count(*) >= 300 THEN 60 ELSE 0 END) AS DOUBLE) AS radius
FROM (SELECT DISTINCT 'run' || (track_idx % 3) AS run_id, poi_id FROM track_dist WHERE d <= 1500) GROUP BY 1"""
CTE["run_near"] = """
SELECT 'run' || (track_idx % 2) AS run_id, poi_id, min(d) AS d FROM track_dist WHERE d <= 1500 GROUP BY 1, 2"""
CTE["sweep_in"] = f"""
SELECT *, greatest(50, CASE WHEN total >= 1200 THEN 120 WHEN total >= 700 THEN 80 WHEN total >= 300 THEN 60 ELSE 0 END) AS radius,
  row_number() OVER (PARTITION BY run_id, m, category ORDER BY ord) AS n
FROM (
  SELECT r.run_id, t.m, r.d, p.ord, p.poi_id, p.category, p.lat, p.lon, p.tags, count(*) OVER (PARTITION BY r.run_id, t.m) AS total
  FROM run_near r JOIN pois p USING (poi_id), (VALUES (300), (600), (900), (1500)) AS t(m) WHERE r.d <= t.m)"""
CTE["sweep_walk"] = f"""
SELECT run_id, m, category, 0::BIGINT AS n, []::STRUCT(o BIGINT, y DOUBLE, x DOUBLE)[] AS leaders, NULL::BIGINT AS ord, NULL::BIGINT AS leader
FROM (SELECT DISTINCT run_id, m, category FROM sweep_in WHERE category NOT IN {in_list(rules.NEVER_MERGED)})
UNION ALL
SELECT run_id, m, category, n, CASE WHEN hit IS NULL THEN list_append(leaders, {{'o': ord, 'y': lat, 'x': lon}}) ELSE leaders END, ord, coalesce(hit, ord)
FROM (
  SELECT w.run_id, w.m, w.category, d.n, w.leaders, d.ord, d.lat, d.lon,
    ([l.o FOR l IN w.leaders IF {hav('l.y', 'l.x', 'd.lat', 'd.lon')} <= d.radius])[1] AS hit
  FROM sweep_walk w JOIN sweep_in d ON d.run_id = w.run_id AND d.m = w.m AND d.category = w.category AND d.n = w.n + 1)"""
FINAL["distance_sweep"] = f"""
SELECT run_id, CAST(m AS DOUBLE) AS max_distance_m, count(*) AS n_pois, CAST(sum(n) AS BIGINT) AS n_near, {metres('sum(d)')} AS sum_distance_m
FROM (
  SELECT run_id, m, arg_max(d, {{'t': len(tags), 'o': -ord}}) AS d, count(*) AS n
  FROM (SELECT w.leader, s.* FROM sweep_walk w JOIN sweep_in s ON s.run_id = w.run_id AND s.m = w.m AND s.ord = w.ord WHERE w.ord IS NOT NULL)
  GROUP BY run_id, m, category, leader
  UNION ALL SELECT run_id, m, d, 1 FROM sweep_in WHERE category IN {in_list(rules.NEVER_MERGED)}) GROUP BY 1, 2"""
FINAL["source_region"] = f"""SELECT poi_id, {metres('min(d)')} AS distance_m FROM track_dist WHERE d <= 1000 GROUP BY 1"""
FINAL["distance_counts"] = f"""
SELECT run_id, CAST(m AS DOUBLE) AS max_distance_m, count(*) AS n_pois, {metres('sum(d)')} AS sum_distance_m
FROM run_near, (VALUES (300), (600), (900), (1500)) AS t(m) WHERE d <= m GROUP BY 1, 2"""

# --- sources ---------------------------------------------------------------------------
FINAL["gpx_ingest"] = """
SELECT '/in/f' || n || '.GPX' AS path, CASE WHEN n % 3 = 0 THEN 'Meta ' || n WHEN n % 5 <> 4 AND n % 3 <> 2 THEN 'T' || n ELSE 'f' || n END AS name,
  CAST(row_number() OVER (PARTITION BY n ORDER BY event_id) - 1 AS BIGINT) AS seq,
  CAST(floor((40 + (event_id % 1000) * 1e-3) * 1e6 + 0.5) AS BIGINT) AS lat_e6, (1 + event_id % 7) * 1000000 AS lon_e6,
  CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN -100 ELSE CAST(floor(value * 100 + 0.5) AS BIGINT) END AS ele_cm,
  strftime(ts, '%Y-%m-%d') AS "time", NULL AS error
FROM (SELECT *, event_id // 250 AS n FROM events) WHERE event_id % 50 <> 7 AND n % 7 <> 6
UNION ALL SELECT DISTINCT '/in/f' || event_id // 250 || '.GPX', NULL, NULL, NULL, NULL, NULL, NULL, 'Invalid GPX file: XML parse error'
FROM events WHERE event_id // 250 % 7 = 6"""
FINAL["osm_ingest"] = """
SELECT id // 50 AS n, CAST(id % 50 AS INT) AS pos, type, id,
  CASE WHEN type = 'node' OR k17 <> 0 THEN CAST(floor(lat * 1e6 + 0.5) AS BIGINT) END AS lat_e6,
  array_to_string([x.key || '=' || x.value FOR x IN tags], ';') AS tags FROM elements"""
FINAL["search_ingest"] = """
SELECT doc_id // 10 AS n, CAST(doc_id % 10 AS INT) AS pos, CASE WHEN doc_id % 9 <> 7 THEN 'T' || doc_id ELSE '' END AS title,
  'https://e.org/' || doc_id AS url, CASE WHEN doc_id % 8 = 1 THEN 'unknown' ELSE source END AS engine, CAST(length(text) AS INT) AS n_chars
FROM documents
UNION ALL SELECT n, e.pos, '', CASE e.pos WHEN 0 THEN 'timed out ' || n ELSE 'CAPTCHA' END, CASE e.pos WHEN 0 THEN 'bing' ELSE 'aol' END, -1
FROM (SELECT DISTINCT doc_id // 10 AS n FROM documents), (VALUES (0), (1)) AS e(pos) WHERE n % 3 = 0"""
FINAL["geo_context"] = """
SELECT c_custkey AS k, c_custkey % 11 <> 0 AS found, CASE WHEN c_custkey % 11 <> 0 THEN
    CASE c_custkey % 5 WHEN 0 THEN 'City ' || c_custkey WHEN 1 THEN 'Village ' || c_custkey WHEN 2 THEN 'Village ' || c_custkey
    WHEN 3 THEN 'County ' || c_nationkey END END AS locality,
  CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 5 <> 4 THEN 'County ' || c_nationkey END AS county,
  CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS state, CASE WHEN c_custkey % 11 <> 0 THEN 'France' END AS country,
  CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 2 = 0 THEN 'fr' END AS country_code FROM customer"""
FINAL["page_preview"] = r"""
SELECT page_id, url, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title,
  nullif(trim(regexp_replace(coalesce(
    nullif(regexp_extract(html, '(?is)<meta\s+name=["'']description["'']\s+content=["''](.*?)["''][^>]*>', 1), ''),
    regexp_extract(html, '(?is)<meta\s+content=["''](.*?)["'']\s+name=["'']description["''][^>]*>', 1)), '\s+', ' ', 'g')), '') AS description,
  md5(nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\s+', ' ', 'g'),
    '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 1200), '')) AS excerpt_md5
FROM pages"""
FINAL["failure_report"] = """
SELECT CASE WHEN user_id % 3 = 0 THEN 'yandex-maps' ELSE 'google-maps' END AS source, 'https://maps.example.com/' || user_id AS url,
  count(*) AS n_failures, CAST(max(1 + event_id % 4) AS INT) AS max_attempts, arg_max('E' || event_id, ts) AS last_error
FROM events WHERE event_type = 'error' GROUP BY 1, 2"""

# --- places ------------------------------------------------------------------------------
FINAL["category_filter"] = "SELECT poi_id, category FROM pois WHERE category IN ('Water', 'Food shop', 'Wifi')"
FINAL["category_counts"] = "SELECT category, count(*) AS n_pois FROM pois GROUP BY 1"
FINAL["poi_sort_distance"] = "SELECT poi_id, CAST(row_number() OVER (ORDER BY d, poi_id) AS INT) AS place FROM corridor"
FINAL["poi_sort_name"] = "SELECT poi_id, name, CAST(row_number() OVER (ORDER BY lower(strip_accents(name)) COLLATE ICU_NOACCENT, poi_id) AS INT) AS place FROM corridor"
FINAL["poi_sort"] = f"SELECT poi_id, category, {metres('d')} AS distance_m FROM corridor ORDER BY category, d, poi_id"
_POLICY = case_map("category", rules.POLICY, "'skip'")
FINAL["policy_assign"] = f"SELECT poi_id, {_POLICY} AS policy FROM pois"
FINAL["policy_counts"] = f"""
SELECT count(*) AS n_pois, count(*) FILTER (WHERE {_POLICY} <> 'skip') AS n_enrichable, count(*) FILTER (WHERE {_POLICY} = 'full') AS n_full FROM pois"""
FINAL["generic_name_filter"] = f"SELECT poi_id, name FROM pois WHERE lower(trim(name)) NOT IN {in_list(rules.GENERIC_NAMES)}"
FINAL["translate_labels"] = f"""
SELECT poi_id, {case_map('category', rules.CATEGORY_LABEL['fr'], 'category')} AS category_fr,
  {case_map('category', rules.CATEGORY_LABEL['en'], 'category')} AS category_en,
  {case_map('lower(trim(name))', rules.GENERIC_NAME_FR, 'name')} AS name_fr FROM pois"""
FINAL["icon_lookup"] = f"""
SELECT poi_id, coalesce(([i FOR i IN [{case_map("x.key || '=' || x.value", rules.OSMAND_TAG_ICON)} FOR x IN tags] IF i IS NOT NULL])[1],
  {case_map('category', rules.OSMAND_ICON, "'special_star'")}) AS osmand_icon FROM pois"""
CTE["poi_enr"] = r"""
SELECT *, CASE k % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END || '/' || k AS poi_id,
  CASE k % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'skipped' ELSE 'done' END AS status,
  CASE WHEN k % 5 = 1 THEN CASE WHEN k % 2 = 0 THEN 'no-results' ELSE 'generic-name' END END AS skip_reason,
  CASE WHEN k % 3 = 1 THEN 'Mon-Fri: 8:00-12:00, 14:00-18:00; Sat: 9:00-12:00 / Sun: closed' END AS hours,
  (k % 101) / 1e2 AS confidence, CASE WHEN k % 6 <> 5 THEN (k % 41) / 1e1 + 1 END AS rating, CASE WHEN k % 4 = 1 THEN k END AS review_count,
  CASE WHEN k % 7 < 3 THEN 1 + k % 4 END AS price_level,
  CASE WHEN k % 5 = 2 THEN 'Place ' || k || repeat(' long and winding description', 8) WHEN k % 5 = 3 THEN 'A <b>&  place' || k END AS description
FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0)"""
FINAL["availability_flags"] = r"""
SELECT poi_id, sunday AS open_sunday, evening AS open_evening,
  array_to_string([x.t FOR x IN [{'t': CASE WHEN sunday THEN 'Open Sunday' END}, {'t': CASE WHEN evening THEN 'Open evenings' END}] IF x.t IS NOT NULL], '|') AS availability
FROM (
  SELECT poi_id, CASE h WHEN '' THEN false WHEN 'Mo-Su 08:00-22:00' THEN true WHEN 'Mo-Fr 09:00-18:00; Su closed' THEN false
      WHEN 'Sa 10:00-12:00; Su 08h00 - 01h00' THEN true ELSE false END AS sunday,
    len([x FOR x IN regexp_extract_all(h, '\d{1,2}[h:.]?\d{0,2}\s*[-–]\s*(\d{1,2})', 1) IF CAST(x AS INT) >= 20 OR CAST(x AS INT) <= 2]) > 0 AS evening
  FROM (SELECT p.poi_id, coalesce(e.hours, """ + tag("opening_hours") + r""", '') AS h FROM pois p LEFT JOIN poi_enr e USING (poi_id)))"""
FINAL["confidence_bands"] = """
SELECT CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.3 THEN 'medium' WHEN confidence > 0 THEN 'low' END AS band, count(*) AS n_pois
FROM poi_enr GROUP BY 1"""

# --- cache -----------------------------------------------------------------------------------
CTE["cache_versions"] = """
SELECT 'node' AS osm_type, o_custkey AS osm_id, CASE o_orderkey % 3 WHEN 0 THEN 'Food shop' WHEN 1 THEN 'Water' ELSE repeat('x', 101) END AS category,
  45 + o_custkey * 1e-3 AS lat, CASE WHEN o_orderkey % 41 = 0 THEN 200e0 ELSE 1e0 END AS lon, 'Name ' || o_orderkey AS name,
  '{"rating":' || o_orderkey % 5 || '}' AS enrichment, CASE WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'done' END AS status,
  o_orderdate AS enriched_at, o_orderkey AS version FROM orders"""
CTE["cache_now"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY osm_type, osm_id ORDER BY enriched_at DESC, version DESC) AS rn FROM cache_versions) WHERE rn = 1"""
FINAL["cache_lookup"] = """
SELECT c.osm_type, c.osm_id, c.name, enriched_at < TIMESTAMP '2001-08-01' - INTERVAL 90 DAY AS is_stale
FROM cache_now c JOIN pois p USING (osm_type, osm_id) WHERE c.osm_id > 0"""
FINAL["cache_lookup_stats"] = """
SELECT count(*) AS requested, count(DISTINCT CASE WHEN c.osm_id IS NOT NULL THEN r.osm_type || r.osm_id END) AS hits,
  count(*) - count(DISTINCT CASE WHEN c.osm_id IS NOT NULL THEN r.osm_type || r.osm_id END) AS misses
FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'way' ELSE 'node' END AS osm_type, user_id * 3 AS osm_id FROM events) r
LEFT JOIN cache_now c USING (osm_type, osm_id) WHERE r.osm_id > 0"""
FINAL["cache_split"] = """
SELECT p.poi_id, CASE WHEN c.osm_id IS NOT NULL AND p.osm_id > 0 THEN 'reuse' ELSE 'work' END AS action
FROM pois p LEFT JOIN (SELECT * FROM cache_now WHERE enriched_at >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY) c USING (osm_type, osm_id)"""
FINAL["cache_upsert"] = """
SELECT osm_type, osm_id, category, name, enrichment, version, strftime(enriched_at, '%Y-%m-%d') AS enriched_on FROM (
  SELECT *, row_number() OVER (PARTITION BY osm_type, osm_id ORDER BY enriched_at DESC, version DESC) AS rn FROM cache_versions
  WHERE status = 'done' AND osm_id > 0 AND length(category) <= 100 AND lon BETWEEN -180 AND 180) WHERE rn = 1"""
FINAL["pending_worklist"] = """
SELECT p.poi_id, p.category FROM pois p LEFT JOIN poi_enr e USING (poi_id)
WHERE e.status IS NULL OR e.status = 'error' OR (e.status = 'skipped' AND e.skip_reason = 'no-results' AND e.k % 3 = 0)"""
CTE["places"] = """
SELECT n, 'p' || n AS poi_id, n AS ord, 45 + (n % 100) * 1e-2 AS lat, 1 + (n // 100) * 1e-2 AS lon,
  CASE n % 7 WHEN 0 THEN 'Restaurant or Bar' WHEN 1 THEN 'Food shop' WHEN 2 THEN 'Sleeping place' WHEN 3 THEN 'Gears' WHEN 4 THEN 'Laundry'
    WHEN 5 THEN 'Water' ELSE 'Restaurant or Bar' END AS category,
  CASE WHEN n % 11 = 5 THEN ' Toilets ' WHEN n % 11 = 7 THEN '' ELSE 'Chez Paul ' || n END AS name,
  CASE WHEN n % 4 = 3 THEN NULL WHEN n % 4 = 1 THEN 'Tours' ELSE 'Saumur' END AS locality,
  CASE WHEN n % 4 IN (0, 1) THEN 'Indre-et-Loire' END AS county, CASE WHEN n % 4 = 0 THEN 'Centre' END AS state,
  CASE WHEN n % 4 <> 3 THEN 'France' END AS country,
  CASE WHEN n % 3 = 0 THEN 'fast_food' END AS amenity, CASE WHEN n % 3 = 1 THEN 'bakery' END AS shop,
  CASE WHEN n % 5 = 0 THEN '0' || n END AS phone, n % 5 AS n_unresponsive,
  CASE WHEN n % 2 = 0 THEN 'https://www.place' || n || '.example.com/' END AS site
FROM (SELECT doc_id // 9 AS n FROM documents WHERE doc_id % 9 = 0)"""


def num(expr: str) -> str:
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"


FINAL["enrichment_worklist"] = f"""
SELECT poi_id, CAST(v - 1 AS INT) AS variant, trim(CASE v WHEN 1 THEN q1 ELSE q2 END) AS query,
  'https://www.google.com/maps/search/' || replace(name, ' ', '%20') || '/@' || {num('lat')} || ',' || {num('lon')} || ',17z' AS google_maps_url,
  'https://www.google.com/maps/dir/?api=1&destination=' || {num('lat')} || ',' || {num('lon')} AS google_directions_url,
  CASE WHEN trim(name) <> '' THEN 'https://yandex.com/maps/?text=' || replace(trim(name), ' ', '%20') || '&ll=' || {num('lon')} || ',' || {num('lat')} || '&z=16' END AS yandex_maps_url,
  site AS official_site
FROM (
  SELECT *, concat_ws(' ', CASE WHEN trim(name) <> '' THEN '"' || trim(name) || '"' END, locality, county, state,
      CASE WHEN trim(name) = '' THEN nullif(concat_ws(' ', replace(amenity, '_', ' '), shop), '') END,
      {case_map('category', rules.SEARCH_WORDS, "'avis'")}) AS q1,
    concat_ws(' ', CASE WHEN trim(name) <> '' THEN '"' || trim(name) || '"' END, locality) AS q2
  FROM places), (VALUES (1), (2)) AS t(v)
WHERE v = 1 OR (q2 <> '' AND q2 <> q1)"""


def site_url(key: str) -> str:
    raw = f"trim({tag(key)})"
    url = (
        f"CASE WHEN regexp_matches({raw}, '(?i)^https?://') THEN {raw} "
        f"WHEN regexp_full_match({raw}, '(?i)[\\w.-]+\\.[a-z]{{2,}}(/.*)?') THEN 'https://' || {raw} END"
    )
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({url}, '(?i)^https?://([^/?#:]+)', 1)), '^www\\.', ''), '^m\\.', '')"
    exact = "|".join(d.replace(".", "\\.") for d in rules.NOT_OFFICIAL_DOMAINS)
    brand = "|".join(rules.NOT_OFFICIAL_BRANDS)
    return f"CASE WHEN NOT regexp_matches({host}, '(^|\\.)({exact})$') AND NOT regexp_matches({host}, '^({brand})(\\.|$)') THEN {url} END"


FINAL["official_site"] = f"SELECT id, coalesce({', '.join(site_url(k) for k in rules.OFFICIAL_SITE_TAGS)}) AS site FROM elements"
FINAL["geocode_batch"] = """
SELECT poi_id, a AS lat_key, b AS lon_key, CASE WHEN (a + b) % 3 <> 0 THEN 'L' || a % 7 END AS locality
FROM (SELECT poi_id, CAST(floor(lat * 1000 + 0.5) AS BIGINT) AS a, CAST(floor(lon * 1000 + 0.5) AS BIGINT) AS b FROM pois)"""
CTE["snippets"] = f"""
SELECT 'p' || poi AS poi_id, * FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 + (doc_id - doc_id // 3 - 1) // 9 END AS poi,
    CASE WHEN doc_id % 3 = 0 THEN doc_id // 3 ELSE (doc_id - doc_id // 3 - 1) % 9 END AS pos,
    {testbed._SNIPPET_TITLE} AS title, {duck(testbed._SNIPPET_URL)} AS url,
    CASE WHEN doc_id % 29 = 0 THEN '  ' ELSE text || {testbed._SNIPPET_SUFFIX} END AS content, source AS engine
  FROM documents)"""
_U = r"^([a-z]+)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def url_host(url: str) -> str:
    return f"nullif(lower(regexp_extract({url}, '{_U}', 2)), '')"


def url_page(url: str) -> str:
    part = lambda i: f"regexp_extract({url}, '{_U}', {i})"
    path = f"CASE WHEN length({part(3)}) > 1 THEN regexp_replace({part(3)}, '/$', '') ELSE '/' END"
    kept = (
        f"[CASE WHEN q LIKE '%=%' THEN q ELSE q || '=' END FOR q IN string_split(substr({part(4)}, 2), '&') "
        f"IF q <> '' AND split_part(q, '=', 1) NOT IN {in_list(['utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'fbclid', 'gclid', 'ref', 'source', 'srsltid'])}]"
    )
    return (
        f"CASE WHEN regexp_matches({url}, '{_U}') THEN {part(1)} || '://' || regexp_replace(lower({part(2)}), '^(www|m)\\.', '') || {path} "
        f"|| CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END || {part(5)} ELSE {url} END"
    )


FINAL["url_normalize"] = f"""
SELECT url, {url_page('url')} AS page, {url_host('url')} AS host FROM (SELECT url FROM pages UNION ALL SELECT url FROM snippets)"""

# --- snippets ---------------------------------------------------------------------------
_WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
CTE["distinct_pages"] = f"""
SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY pos) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY poi_id, page ORDER BY pos) AS pn FROM (
    SELECT poi_id, pos, title, url, engine, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content, {url_page('url')} AS page FROM snippets)
  WHERE content <> '') WHERE pn = 1"""
CTE["cand"] = "SELECT * FROM distinct_pages WHERE rn <= 16"
_FOREIGN = "一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿ֐-׿ऀ-ॿ"


def noise_sql() -> str:
    named = " OR ".join(
        f"regexp_matches({c}, '(?i)my unicredit banking|internet banking|login|sign in')" for c in ("title", "content", "url")
    )
    sample = "(title || ' ' || substr(content, 1, 200))"
    dense = (
        f"length(regexp_replace({sample}, '[^{_FOREIGN}]', '', 'g')) / "
        f"greatest(length(regexp_replace({sample}, '{_WS}', '', 'g')), 1) > 0.15"
    )
    return f"({named} OR {dense})"


def elsewhere_sql() -> str:
    text = "lower(title || ' ' || content)"
    mentioned = " OR ".join(f"coalesce(contains({text}, lower({c})), false)" for c in ("locality", "county", "state", "country"))
    city = r"([A-Z][a-zà-ÿ]+(?:\s+[A-Z][a-zà-ÿ]+)*)"
    c1 = f"lower(regexp_extract(title, ',\\s*{city}\\s*[-–:·]?\\s*', 1))"
    c2 = f"lower(regexp_extract(title, '[-–]\\s*{city}\\s*$', 1))"
    c3 = f"lower(regexp_extract(title, '(?i)in\\s+{city}', 1))"
    arms = []
    for c in (c1, c2, c3):
        same = f"({c} = lower(locality) OR {c} = lower(county) OR {c} = lower(country))"
        arms.append(f"WHEN length({c}) >= 3 AND coalesce({same}, false) THEN false")
        arms.append(f"WHEN length({c}) >= 3 AND NOT contains(lower(locality), {c}) AND NOT contains({c}, lower(locality)) THEN true")
    return f"(NOT ({mentioned}) AND CASE {' '.join(arms)} ELSE false END)"


FINAL["snippet_dedup"] = "SELECT poi_id, pos, url, md5(content) AS content_md5 FROM cand"
FINAL["snippet_noise"] = f"SELECT poi_id, pos, {noise_sql()} AS is_noise FROM snippets"
CTE["placed"] = f"""
SELECT c.*, locality, county, state, country FROM cand c LEFT JOIN places p USING (poi_id)"""
CTE["all_placed"] = """
SELECT c.*, locality, county, state, country FROM distinct_pages c LEFT JOIN places p USING (poi_id)"""
FINAL["snippet_geo"] = f"SELECT poi_id, pos, {elsewhere_sql()} AS is_elsewhere FROM all_placed"
CTE["kept"] = f"""
SELECT poi_id, pos, title, url, content, engine FROM (
  SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY pos) AS kn FROM placed WHERE NOT {noise_sql()} AND NOT {elsewhere_sql()}) WHERE kn <= 8"""
FINAL["snippet_topk"] = "SELECT poi_id, pos, title, engine FROM kept"
CTE["previews"] = """
SELECT 'p' || n AS poi_id, n, 'https://www.place' || n || '.example.com/' AS url, 'https://www.place' || n || '.example.com/home' AS final_url,
  CASE WHEN n % 6 <> 4 THEN 'Place ' || n END AS title, CASE WHEN n % 8 = 0 THEN 'Welcome to place ' || n END AS description,
  CASE WHEN n % 8 = 2 THEN 'Some text of the page' END AS excerpt, n % 10 <> 8 AS has_data,
  CASE WHEN n % 10 <> 8 AND n % 3 = 0 THEN 'House of n ' || n END AS sd_description,
  CASE WHEN n % 10 <> 8 AND n % 7 = 0 THEN '€€' END AS sd_price,
  CASE WHEN n % 10 <> 8 AND n % 4 = 0 THEN 'Mo-Fr 09:00-18:00; Sa 10:00-12:00' END AS sd_hours,
  CASE WHEN n % 10 <> 8 THEN CASE n % 6 WHEN 0 THEN 4.4 WHEN 2 THEN 4.0 END END AS sd_rating,
  CASE WHEN n % 10 <> 8 AND n % 12 = 0 THEN 87 END AS sd_count
FROM (SELECT doc_id // 9 AS n FROM documents WHERE doc_id % 18 = 0)"""
CTE["map_previews"] = """
SELECT 'p' || n AS poi_id, n, coalesce(CASE WHEN n % 5 = 0 THEN 'https://maps.google.com/place/' || n END, 'https://maps.google.com/?q=' || n) AS url,
  CASE WHEN n % 4 <> 1 THEN 'Map place ' || n END AS title, CASE WHEN n % 3 = 0 THEN 'Restaurant' END AS category,
  CASE WHEN n % 2 = 0 THEN '4.5' WHEN n % 7 = 1 THEN '3' END AS rating, CASE WHEN n % 4 = 0 THEN 120 END AS review_count,
  CASE WHEN n % 6 = 3 THEN 2 END AS price_level,
  CASE WHEN n % 5 = 1 THEN 'Mon: 08:00-19:00; Sun: closed' WHEN n % 5 = 2 THEN 'Open until 19:00' END AS hours, n % 5 = 1 AS has_table,
  CASE WHEN n % 8 = 0 THEN '1 rue Nationale' END AS address, CASE WHEN n % 9 = 0 THEN '+33 2 41 00 00 00' END AS phone,
  CASE WHEN n % 10 = 0 THEN 'https://example.com' END AS website, CASE WHEN n % 7 = 0 THEN 'Nice terrace' END AS snippet
FROM (SELECT doc_id // 9 AS n FROM documents WHERE doc_id % 9 = 0 AND doc_id % 27 <> 18)"""
CTE["web_snips"] = f"""
SELECT * FROM (
  SELECT poi_id, 0 AS pos, coalesce(title, 'Official site') AS title, final_url AS url, sd_description AS content, 'official_website' AS engine FROM previews
  UNION ALL SELECT poi_id, 1, 'Official opening hours', final_url, 'Opening hours: ' || sd_hours, 'official_website' FROM previews
  UNION ALL SELECT poi_id, 2, 'Official structured data', final_url, nullif(concat_ws('. ', 'Rating ' || {num('sd_rating')} || '/5', sd_count || ' reviews', 'Price ' || sd_price), ''), 'official_website' FROM previews)
WHERE content IS NOT NULL"""
CTE["map_snips"] = """
SELECT * FROM (
  SELECT poi_id, 0 AS pos, coalesce(title, 'Google Maps') AS title, url, snippet AS content, 'google_maps' AS engine FROM map_previews
  UNION ALL SELECT poi_id, 1, coalesce(title, 'Google Maps') || ' facts', url, nullif(concat_ws('. ', category, 'Rating ' || rating || '/5', review_count || ' reviews',
    'Price ' || repeat('$', price_level), hours, address, phone), ''), 'google_maps' FROM map_previews)
WHERE content IS NOT NULL"""
FINAL["preview_snippets"] = "SELECT * FROM web_snips UNION ALL SELECT * FROM map_snips"
CTE["own"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY sr, pos) AS un FROM (
  SELECT *, 0 AS sr FROM web_snips UNION ALL SELECT *, 1 FROM kept)) WHERE un <= 8"""
CTE["united"] = """
SELECT poi_id, rn - 1 AS pos, title, url, content, engine FROM (
  SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY sr, un) AS rn FROM (
    SELECT poi_id, sr, un, title, url, content, engine FROM own
    UNION ALL SELECT m.poi_id, 2, m.pos, m.title, m.url, m.content, m.engine FROM map_snips m
      LEFT JOIN (SELECT poi_id, count(*) AS c FROM own GROUP BY 1) o USING (poi_id) LEFT JOIN places p USING (poi_id)
      WHERE coalesce(o.c, 0) < 2 OR coalesce(p.n_unresponsive, 0) >= 2)) WHERE rn <= 8"""
FINAL["snippet_union"] = "SELECT poi_id, pos, title, url, engine FROM united"
_SCORE = "CASE " + " ".join(f"WHEN regexp_matches(lower(url), {quote(p)}) THEN {v}" for p, v in rules.DOMAIN_QUALITY) + " ELSE 1 END"
CTE["ranked"] = f"""
SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY score DESC, length(content) DESC, pos0) - 1 AS pos FROM (
  SELECT poi_id, pos AS pos0, title, url, content, engine, {_SCORE} AS score FROM united) WHERE score > 0"""
FINAL["snippet_rank"] = "SELECT poi_id, pos, url, CAST(score AS INT) AS score FROM ranked"


def platform_sql(url: str) -> str:
    arms = " ".join(f"WHEN contains({url_host(url)}, {quote(p)}) THEN {quote(n)}" for p, n in rules.PLATFORM_BY_HOST)
    return f"CASE {arms} ELSE 'other' END"


FINAL["platform_classify"] = f"SELECT poi_id, pos, {platform_sql('url')} AS platform FROM snippets"
FINAL["official_flag"] = f"""
SELECT s.poi_id, s.pos, coalesce(regexp_replace({url_host('s.url')}, '^www\\.', '') = site_host OR {url_host('s.url')} LIKE '%.' || site_host, false) AS is_official
FROM snippets s LEFT JOIN (SELECT poi_id, regexp_replace({url_host('site')}, '^www\\.', '') AS site_host FROM places) p USING (poi_id)"""
FINAL["engine_set"] = """
SELECT poi_id, string_agg(engine, ',' ORDER BY pos) AS engines FROM (SELECT poi_id, engine, min(pos) AS pos FROM snippets GROUP BY 1, 2) GROUP BY 1"""

# --- extraction ---------------------------------------------------------------------------
CTE["gathered"] = """
SELECT poi_id, list({'pos': pos, 'title': title, 'url': url, 'content': content, 'engine': engine} ORDER BY pos) AS l FROM distinct_pages GROUP BY 1"""
_RATE = r"(?i)(\d(?:[.,]\d)?)\s*(?:/\s*5|stars?|étoiles?)"


def each(pattern: str, group: int = 0, column: str = "l") -> str:
    return f"flatten([regexp_extract_all(s.content, {quote(pattern)}, {group}) FOR s IN {column}])"


def rating_sql(column: str = "l") -> str:
    values = f"[CAST(replace(r, ',', '.') AS DOUBLE) FOR r IN {each(_RATE, 1, column)}]"
    return f"(floor(([v FOR v IN {values} IF v BETWEEN 1 AND 5])[1] * 10 + 0.5) / 10)"


def reviews_sql(column: str = "l") -> str:
    return f"CAST(({each('(?i)([0-9]{1,5})' + _WS + '+(?:reviews?|avis|opiniones)', 1, column)})[1] AS BIGINT)"


def hours_text_sql(column: str = "l") -> str:
    source = r"(?i)((?:mon|tue|wed|thu|fri|sat|sun|lun|mar|mer|jeu|ven|sam|dim)[^.;]{0,80}\d{1,2}[:h]\d{2}[^.;]{0,40})"
    found = f"[h FOR h IN [nullif(regexp_extract(s.content, {quote(source)}, 1), '') FOR s IN {column}] IF h IS NOT NULL]"
    return f"regexp_replace(({found})[1], '^{_WS}+|{_WS}+$', '', 'g')"


def price_sql(category: str, column: str = "l") -> str:
    sym = f"[length(regexp_replace(m, '{_WS}', '', 'g')) FOR m IN {each('€' + _WS + '*€{1,3}|[$]' + _WS + '*[$]{1,3}|£' + _WS + '*£{1,3}|¥' + _WS + '*¥{1,3}', 0, column)}]"
    b, e = rf"(?:^|[\s,;:!?.(])", rf"(?:$|[\s,;:!?.)])"
    text = f"array_to_string([s.content FOR s IN {column}], ' ')"
    said = f"regexp_replace({text}, '(?i){b}pas\\s+cher(?:$|[\\s,;:!?.)])', ' cheap ', 'g')"
    words = [
        (4, r"very\s+expensive|très\s+cher"), (3, "expensive|cher"), (2, r"moderate|moderately\s+priced|modéré|prix\s+moyens?"),
        (1, r"inexpensive|cheap|bon\s+marché|économique"),
    ]
    word = "CASE " + " ".join(f"WHEN regexp_matches({said}, '(?i){b}({w}){e}') THEN {n}" for n, w in words) + " END"
    prices = (
        f"[v FOR v IN [CAST(replace(regexp_replace(m, '[€$£¥]|{_WS}', '', 'g'), ',', '.') AS DOUBLE) FOR m IN "
        f"{each('(?:[€$£¥]' + _WS + '*[0-9]+(?:[.,][0-9]{1,2})?)|(?:[0-9]+(?:[.,][0-9]{1,2})?' + _WS + '*[€$£¥])', 0, column)}] IF v > 0 AND v < 10000]"
    )
    middle = lambda x: f"(list_sort({x}))[len({x}) // 2 + 1]"
    m = middle(prices)
    bracket = lambda a, c, d: f"CASE WHEN {m} <= {a} THEN 1 WHEN {m} <= {c} THEN 2 WHEN {m} <= {d} THEN 3 WHEN {m} IS NOT NULL THEN 4 END"
    return f"CAST(coalesce({middle(sym)}, {word}, CASE WHEN {category} = 'Sleeping place' THEN {bracket(30, 70, 150)} ELSE {bracket(8, 20, 45)} END) AS INT)"


_D = "(monday|tuesday|wednesday|thursday|friday|saturday|sunday|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|mon|tue|wed|thu|fri|sat|sun|lun|mar|mer|jeu|ven|sam|dim)"
_ROW = rf"(?i)\b{_D}[\s.:–-]*([0-9]{{1,2}}[h:][0-9]{{2}})\s*[–\-]\s*([0-9]{{1,2}}[h:][0-9]{{2}})"
_SHUT = rf"(?i)(?:fermé|closed|ferme)\s+le\s+{_D}\b"
_BOTH = _ROW + "|" + _SHUT.replace("(?i)", "")


def clock_sql(expr: str) -> str:
    return f"lpad(regexp_extract({expr}, '^[0-9]+'), 2, '0') || ':' || right({expr}, 2)"


def hours_cte(source: str) -> str:
    day = case_map("d", rules.SNIPPET_DAYS)
    return f"""
SELECT poi_id, string_agg(day || ': ' || CASE WHEN o IS NULL THEN 'closed' ELSE {clock_sql('o')} || '-' || {clock_sql('c')} END, '; ' ORDER BY list_position({rules.WEEK}, day)) AS table_text,
  count(*) AS n_days
FROM (
  SELECT poi_id, day, first(o ORDER BY pos, i) AS o, first(c ORDER BY pos, i) AS c FROM (
    SELECT poi_id, pos, i, {day} AS day, nullif(regexp_extract(m, {quote(_ROW)}, 2), '') AS o, nullif(regexp_extract(m, {quote(_ROW)}, 3), '') AS c
    FROM (SELECT *, lower(coalesce(nullif(regexp_extract(m, {quote(_ROW)}, 1), ''), regexp_extract(m, {quote(_SHUT)}, 1))) AS d FROM (
      SELECT poi_id, s.pos AS pos, unnest(range(len(ms))) AS i, unnest(ms) AS m FROM (
        SELECT poi_id, s, regexp_extract_all(s.title || ' ' || s.content, {quote(_BOTH)}) AS ms FROM (SELECT poi_id, unnest(l) AS s FROM {source}))))) GROUP BY 1, 2)
GROUP BY 1 HAVING count(*) >= 2"""


CTE["hours_tab"] = hours_cte("gathered")
FINAL["rating_extract"] = f"SELECT poi_id, coalesce(CASE n % 4 WHEN 1 THEN 4.5 END, {rating_sql()}) AS rating FROM gathered LEFT JOIN (SELECT poi_id, n FROM places) USING (poi_id)"
FINAL["review_count_extract"] = f"SELECT poi_id, coalesce(CASE n % 4 WHEN 1 THEN 99 END, {reviews_sql()}) AS review_count FROM gathered LEFT JOIN (SELECT poi_id, n FROM places) USING (poi_id)"
FINAL["hours_text_extract"] = f"SELECT poi_id, coalesce(CASE n % 4 WHEN 1 THEN 'Mo-Fr; Sa' END, {hours_text_sql()}) AS hours FROM gathered LEFT JOIN (SELECT poi_id, n FROM places) USING (poi_id)"
FINAL["price_level"] = f"SELECT poi_id, {price_sql('category')} AS price_level FROM gathered LEFT JOIN places USING (poi_id)"
FINAL["hours_table"] = "SELECT poi_id, table_text AS hours FROM gathered LEFT JOIN hours_tab USING (poi_id)"


def diverge_sql(column: str = "l") -> str:
    ranges = f"[lower(r) FOR r IN {each(r'(?i)[0-9]{1,2}[h:][0-9]{2}\s*[-–]\s*[0-9]{1,2}[h:][0-9]{2}', 0, column)}]"
    rates = f"[v FOR v IN [CAST(r AS DOUBLE) FOR r IN {each(r'(?i)([0-9](?:[.][0-9])?)\s*(?:/\s*5|stars?|étoiles?)', 1, column)}] IF v BETWEEN 1 AND 5]"
    closed = f"len([1 FOR s IN {column} IF regexp_matches(s.content, '(?i)\\b(ferm[eé]\\s+d[eé]finitivement|permanently\\s+closed|temporairement\\s+ferm[eé]|temporarily\\s+closed)\\b')]) > 0"
    liked = f"len([1 FOR s IN {column} IF regexp_matches(s.content, '(?i)\\b(open|ouvert|excellent|great|recomm)')]) > 0"
    return f"""[m FOR m IN [
      CASE WHEN len({ranges}) >= 2 AND len(list_distinct({ranges})) > 1 THEN 'Sources report different opening hours — verify locally.' END,
      CASE WHEN len({rates}) >= 2 AND list_max({rates}) - list_min({rates}) >= 1 THEN
        'Rating varies across sources (' || printf('%.1f', list_min({rates})) || ' to ' || printf('%.1f', list_max({rates})) || '/5).' END,
      CASE WHEN {closed} AND {liked} THEN 'Some sources suggest this place may be closed — verify before counting on it.'
        WHEN {closed} THEN 'Closure signals detected in sources — may be permanently or temporarily closed.' END] IF m IS NOT NULL]"""


FINAL["divergences"] = f"SELECT poi_id, array_to_string({diverge_sql()}, '|') AS divergences FROM gathered"
FINAL["preview_fields"] = """
SELECT poi_id, concat_ws(',', CASE WHEN hours IS NOT NULL THEN 'openingHours' END, CASE WHEN rating IS NOT NULL THEN 'rating' END,
  CASE WHEN review_count IS NOT NULL THEN 'reviewCount' END, CASE WHEN address IS NOT NULL THEN 'address' END, CASE WHEN phone IS NOT NULL THEN 'phone' END,
  CASE WHEN website IS NOT NULL THEN 'website' END, CASE WHEN price_level IS NOT NULL THEN 'priceLevel' END, CASE WHEN category IS NOT NULL THEN 'category' END) AS fields
FROM map_previews"""
FINAL["hours_display"] = """
SELECT 'p' || n AS id, CASE WHEN n % 5 = 1 THEN 'Mon: 08:00-19:00; Sun: closed' WHEN n % 5 = 2 THEN 'Open until 19:00' END AS shown
FROM map_previews UNION ALL
SELECT poi_id, array_to_string([trim(x) FOR x IN regexp_split_to_array(hours, '[;\\n]|\\s/\\s') IF trim(x) <> ''], '|') FROM poi_enr"""

# --- map pages, structured data, synthesis checks ----------------------------------------------
CTE["map_pages"] = f"""
SELECT doc_id, CASE WHEN doc_id % 6 = 2 OR doc_id % 5 IN (2, 4) THEN 'yandex' ELSE 'google' END AS source,
  'https://maps.example.com/' || doc_id || CASE WHEN doc_id % 31 = 3 THEN '/showcaptcha' ELSE '' END AS url,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Chez Zoé - Google Maps' END AS title,
  {testbed._MAP_HEAD} || {testbed._MAP_HOURS} || text AS body_text FROM documents"""
_BODY = "body_text"
_SIM_RATE = "(?i)Hôtels similaires|Nearby hotels?|Similar places|À proximité|Nearby places"
_SIM_COUNT = "(?i)Hôtels similaires|Nearby hotels|À proximité"
_SEC = "(?:Présentation|Overview|Prix|About|À propos|Directions|Itinéraires)"


def ex(col: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({col}, {quote(pattern)}, {group}), '')"


CTE["map_local"] = f"""
SELECT *, regexp_split_to_array(loc, {quote(_SIM_RATE)})[1] AS loc_r, regexp_split_to_array(loc, {quote(_SIM_COUNT)})[1] AS loc_c FROM (
  SELECT *, CASE WHEN title IS NULL OR strpos(lower(body_text), 'chez zoé') = 0 THEN substr(body_text, 1, 800)
    ELSE substr(body_text, strpos(lower(body_text), 'chez zoé'), 900) END AS loc FROM map_pages)"""
FINAL["mappage_extract"] = f"""
SELECT source, url, CASE WHEN rating BETWEEN 1 AND 5 THEN rating END AS rating, CAST(regexp_replace(cnt, '[\\s.,]', '', 'g') AS BIGINT) AS review_count,
  trim(regexp_replace(cat, '\\s+', ' ', 'g')) AS category, regexp_replace(trim(regexp_replace(ph, '\\s+', ' ', 'g')), '^[^+0-9]+', '') AS phone,
  CASE WHEN source = 'google' THEN trim(regexp_replace({ex(_BODY, chr(92) + 'b[0-9]{4,5}[^' + chr(92) + 'n]{10,120}')}, '\\s+', ' ', 'g')) END AS address,
  CASE WHEN source = 'google' THEN CAST(length({ex(_BODY, '[$]{1,4}|€{1,4}|£{1,4}')}) AS INT) END AS price_level,
  url LIKE '%showcaptcha%' OR regexp_matches(body_text, '(?i)(are you a robot|подтвердите.+не робот|captcha|smartcaptcha)') AS is_captcha
FROM (
  SELECT *, CAST(replace(CASE WHEN source = 'yandex' THEN {ex('substr(loc, 1, 800)', chr(92) + 'b([1-5][.,][0-9])' + chr(92) + 'b', 1)}
      ELSE {ex('loc_r', chr(92) + 'b([0-9][.,][0-9])' + chr(92) + 'b', 1)} END, ',', '.') AS DOUBLE) AS rating,
    CASE WHEN source = 'yandex' THEN {ex('substr(loc, 1, 1200)', '(?i)([0-9][0-9' + chr(92) + 's.,]*)' + chr(92) + 's+(?:reviews?|оценок|оценки|оценка|отзывов|отзыва|отзыв|değerlendirme|yorum|avis)', 1)}
      ELSE coalesce({ex('loc_c', '[(]([0-9][0-9' + chr(92) + 's.,]*)[)]', 1)}, {ex('loc_c', '(?i)([0-9][0-9' + chr(92) + 's.,]*)' + chr(92) + 's+(?:reviews?|avis)', 1)}) END AS cnt,
    CASE WHEN source = 'yandex' THEN {ex('loc', '^([^·' + chr(92) + 'n]{3,60})' + chr(92) + 's*·' + chr(92) + 's*[0-9.,]', 1)}
      ELSE coalesce({ex('loc', '(?i)[(][0-9][0-9' + chr(92) + 's.,]*[)]' + chr(92) + 's*·' + chr(92) + 's*([^·]{3,60})' + chr(92) + 's*·', 1)},
        {ex('loc', '(?i)[0-9](?:[.,][0-9])' + chr(92) + 's*(?:[(]([0-9' + chr(92) + 's.,]+)[)])?' + chr(92) + 's*([^·]{3,60}?)(?:·' + chr(92) + 's*)?' + _SEC, 2)},
        {ex('loc', '(?i)[0-9](?:[.,][0-9])' + chr(92) + 's+([^·]{3,60}?)' + _SEC, 1)}) END AS cat,
    {ex(_BODY, '[+]?[0-9][0-9' + chr(92) + 's().-]{6,}')} AS ph
  FROM map_local)"""
FINAL["mappage_hours"] = r"""
SELECT source, url, CASE WHEN length(v) >= 4 AND regexp_matches(v, CASE WHEN source = 'yandex' THEN '(?i)(open|closed|открыто|закрыто|круглосуточно|[0-9]{1,2}[:h][0-9]{2})'
    ELSE '(?i)(open|closed|ouvre|fermé|ferme|[0-9]{1,2}[:h][0-9]{2})' END) THEN v END AS hours
FROM (SELECT source, url, trim(regexp_replace(array_to_string(string_split(body_text, chr(10))[3:4], '  '), '\s+', ' ', 'g')) AS v FROM map_pages)"""
# The opening-hours lines of the heads, written out; documents hold none.
CTE["head_hours"] = """
SELECT * FROM (VALUES
  (0, 0, 'Mon', '08:00', '22:00', '08:00', '22:00'), (0, 1, 'Tue', 'closed', NULL, 'closed', NULL), (0, 3, 'Wed', '00:00', '23:59', '00:00', '23:59'),
  (0, 7, 'Thu', '09:00', '17:00', '09:00', '17:00'),
  (1, 0, 'Mon', '09:00', '18:00', '09:00', '18:00'), (1, 1, 'Tue', 'closed', NULL, 'closed', NULL),
  (2, 0, 'Mon', NULL, NULL, '09:00', '18:00'), (2, 1, 'Tue', NULL, NULL, '00:00', '23:59'), (2, 2, 'Wed', NULL, NULL, 'closed', NULL), (2, 3, 'Fri', NULL, NULL, '08:30', '17:00'),
  (3, 0, 'Sun', '00:00', '23:30', '00:00', '23:30'),
  (4, 0, 'Mon', NULL, NULL, '09:00', '22:00'), (4, 1, 'Tue', NULL, NULL, 'closed', NULL), (4, 3, 'Sat', NULL, NULL, '00:00', '23:59')
) AS t(kind, line, day, g_open, g_close, y_open, y_close)"""
CTE["hour_lines"] = """
SELECT source, url, doc_id, line, line + CASE doc_id % 6 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 2 END AS line_no, day,
  CASE WHEN source = 'google' THEN g_open ELSE y_open END AS open, CASE WHEN source = 'google' THEN g_close ELSE y_close END AS close
FROM map_pages JOIN head_hours ON kind = doc_id % 5 WHERE CASE WHEN source = 'google' THEN g_open ELSE y_open END IS NOT NULL"""
FINAL["hours_rows"] = 'SELECT source, url, CAST(line_no AS INT) AS line_no, day, "open", "close" FROM hour_lines'
FINAL["hours_block"] = """
SELECT source, url, CAST(line_no AS INT) AS line_no, day, "open", "close" FROM (
  SELECT *, count(*) OVER (PARTITION BY url) AS n FROM hour_lines WHERE NOT (doc_id % 5 = 0 AND line = 7)) WHERE n >= 2"""
FINAL["jsonld_extract"] = """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Sub ' || page_id WHEN 1 THEN 'A place' WHEN 3 THEN 'Main' END AS description,
  CASE page_id % 6 WHEN 0 THEN '+33 1' WHEN 3 THEN '02 41' END AS telephone, CASE page_id % 6 WHEN 1 THEN '€€' END AS price_range,
  CASE page_id % 6 WHEN 0 THEN 'Mo-Fr 09:00-18:00;Sa 10:00-12:00' WHEN 1 THEN 'Mo-Su' WHEN 3 THEN '' WHEN 5 THEN '' END AS opening_hours,
  CAST(CASE page_id % 6 WHEN 1 THEN 4.5 WHEN 5 THEN 3.0 END AS DOUBLE) AS rating, CAST(CASE page_id % 6 WHEN 1 THEN 12.0 WHEN 5 THEN 7.0 END AS DOUBLE) AS review_count FROM pages"""
CTE["raw_parts"] = f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fr' ELSE 'en' END AS language, doc_id % 13 NOT IN (2, 3, 4) AS usable,
  {testbed._RAW_RATING} AS r, {testbed._RAW_COUNT} AS c, {testbed._RAW_PRICE} AS p, {testbed._RAW_REVIEW} AS rev,
  CASE WHEN doc_id % 10 < 3 THEN NULL WHEN doc_id % 10 < 6 THEN 'A quiet stop near the canal.' ELSE text END AS des FROM documents"""


def sentence_sql(col: str) -> str:
    flat = f"nullif(trim(regexp_replace({col}, '{_WS}+', ' ', 'g')), '')"
    return f"trim(coalesce(nullif(regexp_extract({flat}, '^(.{{1,180}}?[.!?])(?:\\s|$)', 1), ''), substr({flat}, 1, 180)))"


def unreadable_sql(col: str) -> str:
    letters = "|".join(f"{c}{{6,}}|{c.upper()}{{6,}}" for c in "abcdefghijklmnopqrstuvwxyz")
    odd = f"length({col}) - length(regexp_replace({col}, '[^\\p{{L}}\\p{{N}}\\s.,:;!?()''\"\\-/%&]', '', 'g'))"
    return (
        f"coalesce(length({col}) < 4 OR regexp_matches({col}, '!{{4,}}|\\?{{4,}}|\\.{{4,}}|,{{4,}}') OR regexp_matches({col}, '{letters}') "
        f"OR ({odd}) / length({col}) > 0.15, false)"
    )


from .operators.extract import NOT_ENGLISH, NOT_FRENCH  # noqa: E402


def foreign_sql(col: str) -> str:
    return (
        f"coalesce(CASE language WHEN 'en' THEN regexp_matches({col}, {quote('(?i)' + NOT_ENGLISH)}) "
        f"ELSE regexp_matches({col}, {quote('(?i)' + NOT_FRENCH)}) END, false)"
    )


FINAL["llm_output_gate"] = f"""
SELECT doc_id, CAST(CASE WHEN usable THEN CASE r WHEN '4.26' THEN 4.3 WHEN '3' THEN 3.0 END END AS DOUBLE) AS rating,
  CAST(CASE WHEN usable THEN CASE c WHEN '12.5' THEN 13 WHEN '40' THEN 40 END END AS BIGINT) AS review_count,
  CAST(CASE WHEN usable AND p = '2' THEN 2 END AS BIGINT) AS price_level,
  CASE WHEN usable THEN CASE doc_id % 4 WHEN 0 THEN 'Mon-Fri: 08:00-19:00; Sun: closed' WHEN 1 THEN 'All: daily 9-18' END END AS hours,
  CASE WHEN usable THEN d END AS description, CASE WHEN usable THEN v END AS review,
  CASE WHEN NOT usable THEN 'invalid-json' WHEN {foreign_sql('d')} OR {foreign_sql('v')} THEN 'bad-language'
    WHEN {unreadable_sql('d')} OR {unreadable_sql('v')} THEN 'unreadable' END AS reason
FROM (SELECT *, {sentence_sql('des')} AS d, {sentence_sql('rev')} AS v FROM raw_parts)"""

# --- structured content -----------------------------------------------------------------------
CTE["final_lists"] = """
SELECT poi_id, list({'pos': pos, 'title': title, 'url': url, 'content': content, 'engine': engine} ORDER BY pos) AS l FROM ranked GROUP BY 1"""
CTE["final_hours"] = hours_cte("final_lists")


def shorten_sql(col: str, limit: int) -> str:
    v = f"trim(regexp_replace({col}, '{_WS}+', ' ', 'g'))"
    return f"CASE WHEN length({v}) <= {limit} THEN {v} ELSE trim(substr({v}, 1, {limit - 1})) || '…' END"


CTE["digests"] = f"""
SELECT poi_id, platform, {case_map('platform', {n: v[0] for n, v in rules.PLATFORMS.items()})} AS label, {case_map('platform', {n: str(v[1]) for n, v in rules.PLATFORMS.items()})} AS prio,
  {shorten_sql('content', 180)} AS brief, url FROM (
  SELECT poi_id, platform, content, url FROM (
    SELECT *, row_number() OVER (PARTITION BY poi_id, platform ORDER BY length(content) DESC, pos) AS dn FROM (
      SELECT *, {platform_sql('url')} AS platform FROM ranked)) WHERE dn = 1
  UNION ALL SELECT poi_id, 'official_website', coalesce(description, excerpt, title), final_url FROM previews JOIN final_lists USING (poi_id)
    WHERE coalesce(description, excerpt, title) IS NOT NULL)"""
CTE["rollups"] = f"""
SELECT poi_id, string_agg(platform || '=' || label || ': ' || brief || '=' || url, '|' ORDER BY prio) AS rollup, string_agg(label, ', ' ORDER BY prio) AS labels,
  bool_or(platform = 'official_website') AS official, bool_or(platform IN {in_list(rules.REPUTATION_PLATFORMS)}) AS reviews FROM digests GROUP BY 1"""
_CONF = "CASE WHEN official AND reviews THEN 'both' WHEN official THEN 'official' WHEN reviews THEN 'reviews-only' ELSE 'none' END"
_NOT_SEARCHED = f"(lower(trim(name)) IN {in_list(rules.GENERIC_NAMES)} OR {_POLICY} <> 'full')"
FINAL["source_rollup"] = f"SELECT poi_id, rollup FROM rollups"
FINAL["source_confirmation"] = f"SELECT poi_id, {_CONF} AS confirmation FROM rollups"
CTE["place_facts"] = f"""
SELECT p.*, f.l, CASE WHEN lower(trim(p.name)) IN {in_list(rules.GENERIC_NAMES)} THEN 'generic' ELSE {_POLICY.replace('CASE category', 'CASE p.category')} END AS policy,
  v.poi_id IS NOT NULL AS has_preview, v.sd_rating, v.sd_count, v.sd_hours, h.table_text, m.has_table, m.hours AS map_hours, pf.fields AS map_fields,
  r.labels, r.official, r.reviews
FROM places p LEFT JOIN final_lists f USING (poi_id) LEFT JOIN previews v USING (poi_id) LEFT JOIN final_hours h USING (poi_id)
LEFT JOIN map_previews m USING (poi_id) LEFT JOIN rollups r USING (poi_id) LEFT JOIN ({FINAL['preview_fields']}) pf USING (poi_id)"""
CTE["values_found"] = f"""
SELECT *, coalesce(hours_text, hours_flat) AS hours FROM (
  SELECT *, policy = 'full' AND l IS NOT NULL AS found, policy = 'full' AND l IS NOT NULL AND len([1 FOR s IN l IF s.engine = 'google_maps']) > 0 AS used_map,
    CASE WHEN policy = 'full' AND l IS NOT NULL THEN coalesce(sd_rating, {rating_sql()}) END AS rating,
    CASE WHEN policy = 'full' AND l IS NOT NULL THEN coalesce(sd_count, {reviews_sql()}) END AS review_count,
    CASE WHEN policy = 'full' AND l IS NOT NULL THEN coalesce(sd_hours, {hours_text_sql()}) END AS hours_text,
    CASE WHEN policy = 'full' AND l IS NOT NULL THEN coalesce(CASE WHEN has_table AND len([1 FOR s IN l IF s.engine = 'google_maps']) > 0 THEN map_hours END, table_text) END AS hours_flat,
    CASE WHEN policy = 'full' AND l IS NOT NULL THEN {price_sql('category')} END AS price_level,
    CASE WHEN policy = 'full' AND l IS NOT NULL THEN {diverge_sql()} ELSE [] END AS div,
    name || ', ' || coalesce(replace(amenity, '_', ' '), shop, category) || ', useful stop near the route.' AS description
  FROM place_facts)"""


def listed(items: list[str], limit: int) -> str:
    return f"([x FOR x IN [{', '.join(items)}] IF x IS NOT NULL])[1:{limit}]"


CTE["enr"] = f"""
SELECT *, CASE WHEN rating IS NOT NULL AND review_count IS NOT NULL THEN 'Web reviews: ' || printf('%.1f', rating) || '/5 from ' || review_count || ' reviews.'
    WHEN rating IS NOT NULL THEN 'Web reviews: ' || printf('%.1f', rating) || '/5.' WHEN review_count IS NOT NULL THEN 'Review volume confirmed: ' || review_count || '.' END AS review,
  {shorten_sql('description', 320)} AS headline,
  {shorten_sql("concat_ws(' ', CASE WHEN hours IS NOT NULL THEN 'Hours available.' ELSE 'Hours unclear.' END, CASE WHEN rating IS NOT NULL THEN 'Reputation signals present.' ELSE 'Reputation signals limited.' END, 'Coverage: ' || labels || '.', CASE WHEN len(div) > 0 THEN 'Some source disagreements detected.' END)", 240)} AS op_summary,
  {listed(["CASE WHEN coalesce(amenity, shop) <> lower(name) THEN 'Type (OSM): ' || replace(coalesce(amenity, shop), '_', ' ') END",
           "'Reported rating: ' || printf('%.1f', rating) || '/5' || coalesce(' (' || review_count || ' reviews)', '')",
           "trim('Hours: ' || hours)", "'Price level: ' || repeat('$', price_level)", "'Phone: ' || phone", "'Locality: ' || locality"], 6)} AS practicalities,
  {listed([f"CASE WHEN labels IS NULL THEN coalesce({case_map('category', rules.CONTRACT_WEAK_SOURCE)}, 'No identifiable review or discovery platform found.') END",
           "CASE WHEN rating IS NULL THEN 'No explicit rating found in the collected sources.' END",
           "CASE WHEN hours IS NULL THEN 'Opening hours were not confirmed from the collected sources.' END",
           "CASE WHEN review_count IS NULL AND rating IS NOT NULL THEN 'Rating found, but review volume was not confirmed.' END",
           "CASE WHEN labels IS NOT NULL AND NOT reviews THEN 'Sources are limited to social profiles or generic directories — reliability uncertain.' END"], 4)} AS cautions,
  CASE WHEN labels IS NOT NULL THEN 'Exact type or specialty could not be determined from sources.' END AS unknown
FROM values_found"""
CTE["scored"] = """
SELECT *, CASE WHEN n_s = 0 OR NOT found THEN 0.0 ELSE least(greatest(floor((least(n_s / 15::DOUBLE, 0.4::DOUBLE) + least(n_e * 0.05::DOUBLE, 0.15::DOUBLE) + least(n_f * 0.04::DOUBLE, 0.2::DOUBLE)
    + CASE WHEN site_used THEN 0.1::DOUBLE ELSE 0 END + least(least(n_c / n_s::DOUBLE / 1500, 0.1::DOUBLE) + least(n_h * 0.025::DOUBLE, 0.05::DOUBLE), 0.15::DOUBLE) - least(len(div) * 0.05::DOUBLE, 0.15::DOUBLE)) * 100 + 0.5) / 100, 0), 1) END AS confidence
FROM (SELECT *, coalesce(len(l), 0) AS n_s, len(list_distinct([s.engine FOR s IN l])) AS n_e, list_sum([length(s.content) FOR s IN l]) AS n_c,
  len(list_distinct([h FOR h IN [""" + url_host("s.url") + """ FOR s IN l] IF h IS NOT NULL])) AS n_h, has_preview AND policy IN ('full', 'minimal') AS site_used,
  (rating IS NOT NULL)::INT + (review_count IS NOT NULL)::INT + (hours IS NOT NULL)::INT + found::INT + (review IS NOT NULL)::INT AS n_f FROM enr)"""
FINAL["structured_content"] = f"""
SELECT poi_id, headline, op_summary AS operational_summary, array_to_string(practicalities, '|') AS practicalities, array_to_string(cautions, '|') AS cautions,
  coalesce(unknown, '') AS unknowns, array_to_string(div, '|') AS divergences, {_CONF} AS source_confirmation,
  {shorten_sql("concat_ws(' ', headline, op_summary, CASE WHEN len(practicalities) > 0 THEN 'Key facts: ' || array_to_string(practicalities, '; ') || '.' END, CASE WHEN len(div) > 0 THEN 'Divergences: ' || array_to_string(div, ' ') END, CASE WHEN len(cautions) > 0 THEN 'Cautions: ' || array_to_string(cautions, ' ') END, 'Unknown: ' || unknown)", 700)} AS essentials
FROM enr WHERE found"""
FINAL["confidence"] = "SELECT poi_id, confidence FROM scored"
_STATUS = "CASE WHEN policy = 'minimal' OR found THEN 'done' ELSE 'skipped' END"
FINAL["deterministic_enrich"] = f"""
SELECT poi_id, {_STATUS} AS status, CASE WHEN policy = 'generic' THEN 'generic-name' WHEN policy = 'skip' THEN 'low-value-category' WHEN policy = 'full' AND NOT found THEN 'no-results' END AS skip_reason,
  rating, CAST(review_count AS BIGINT) AS review_count, hours, CAST(price_level AS INT) AS price_level, CASE WHEN found THEN description END AS description, review,
  CAST(CASE WHEN found THEN n_s ELSE 0 END AS INT) AS source_count, CASE WHEN used_map AND map_fields <> '' THEN map_fields END AS google_maps_fields, confidence
FROM scored"""
FINAL["run_summary"] = f"""
SELECT count(*) FILTER (WHERE s = 'done') AS done, count(*) FILTER (WHERE s = 'skipped') AS skipped, count(*) FILTER (WHERE s = 'error') AS error
FROM (SELECT {_STATUS} AS s FROM values_found)"""
FINAL["engine_failures"] = """
SELECT engine, arg_min(reason, {'o': k, 'p': p}) AS reason, count(*) AS n_places FROM (
  SELECT k, 0 AS p, 'bing' AS engine, 'timed out ' || k AS reason FROM poi_enr WHERE k % 3 = 0
  UNION ALL SELECT k, 1, 'e' || k % 4, 'CAPTCHA' FROM poi_enr WHERE k % 3 = 0) GROUP BY 1"""
FINAL["merge_precedence"] = f"""
SELECT v.poi_id, coalesce(CASE WHEN n % 3 = 0 THEN 5.0 END, rating) AS rating, CAST(coalesce(CASE WHEN n % 4 = 0 THEN 1 END, review_count) AS BIGINT) AS review_count,
  coalesce(CASE WHEN n % 3 = 0 THEN 'All: daily' END, hours) AS hours,
  CASE WHEN n % 3 = 0 THEN 'All: daily' WHEN n % 2 = 0 THEN CASE WHEN used_map AND has_table THEN map_hours END ELSE hours_flat END AS opening_hours
FROM values_found v WHERE found"""

# --- jobs, exports, streams' table twins --------------------------------------------------------
CTE["job_log"] = """
SELECT 'j' || event_id // 7 AS job_id, event_id // 7 AS job_no, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'error' ELSE 'done' END AS status,
  CASE WHEN user_id % 3 = 0 THEN 'yandex-maps' ELSE 'google-maps' END AS source, CAST(1 + event_id % 3 AS INT) AS attempt,
  CASE WHEN event_type = 'error' THEN 'E' || event_id % 10 END AS error, ts AS updated_at, event_id FROM events"""
CTE["job_now"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM job_log) WHERE rn = 1"""
FINAL["job_latest"] = "SELECT job_id, status, source, attempt, error FROM job_now"
FINAL["job_stats"] = """
SELECT source AS label, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running,
  count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'error') AS error FROM job_now GROUP BY 1
UNION ALL SELECT * FROM (SELECT job_id, (status = 'queued')::INT, (status = 'running')::INT, (status = 'done')::INT, (status = 'error')::INT FROM job_now ORDER BY job_no DESC LIMIT 20)"""
FINAL["job_prune"] = """
SELECT job_id, status FROM job_now WHERE NOT (status IN ('done', 'error') AND updated_at < TIMESTAMP '2024-01-29' - INTERVAL 7 DAY)"""
CTE["requests"] = """
SELECT 'c' || user_id AS client, CASE WHEN event_id % 3 = 0 THEN 'search:0' ELSE CASE WHEN event_id % 3 = 1 THEN 'search:' ELSE 'geo:' END || user_id END AS key,
  CASE WHEN event_id % 3 = 2 THEN 'geocode' ELSE 'search' END AS cache, ts, event_id FROM events"""
CTE["key_times"] = "SELECT key, list(DISTINCT ts ORDER BY ts) AS times FROM requests GROUP BY 1"
CTE["misses"] = """
SELECT key, times[1] AS ts, [t FOR t IN times IF t >= times[1] + INTERVAL 1 DAY] AS left_over FROM key_times
UNION ALL SELECT key, left_over[1], [t FOR t IN left_over IF t >= left_over[1] + INTERVAL 1 DAY] FROM misses WHERE len(left_over) > 0"""
FINAL["ttl_misses"] = "SELECT key, ts FROM misses"
FINAL["request_cache_stats"] = """
SELECT r.cache, count(DISTINCT r.key) AS n_keys, CAST(count(*) - max(m.n) AS BIGINT) AS hits, CAST(max(m.n) AS BIGINT) AS misses FROM requests r JOIN (
  SELECT CASE WHEN key LIKE 'geo:%' THEN 'geocode' ELSE 'search' END AS cache, count(*) AS n FROM misses GROUP BY 1) m USING (cache) GROUP BY 1"""
FINAL["rate_windows"] = """
SELECT date_trunc('hour', ts) AS window_start, client, count(*) AS n_requests FROM requests GROUP BY 1, 2 HAVING count(*) > 1"""
CTE["engine_log"] = """
SELECT * FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'e0' ELSE 'e' || (1 + user_id) END AS engine, event_type NOT IN ('error', 'view') AS success,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'CAPTCHA required' WHEN 1 THEN 'Too many requests' ELSE 'parsing error' END
    WHEN event_type = 'view' THEN 'request timed out' END AS reason, ts, event_id FROM events) WHERE success OR reason <> 'parsing error'"""
FINAL["engine_health"] = """
SELECT engine, failures, suspended_until, last_reason, coalesce(suspended_until > TIMESTAMP '2024-01-30 23:50:00', false) AS is_suspended FROM (
  SELECT engine, count(*) FILTER (WHERE NOT success AND run = last_run) AS failures,
    CASE WHEN count(*) FILTER (WHERE NOT success AND run = last_run) >= 2 THEN max(ts) FILTER (WHERE NOT success AND run = last_run) + INTERVAL 30 MINUTE END AS suspended_until,
    last(reason ORDER BY ts, event_id) FILTER (WHERE NOT success) AS last_reason
  FROM (SELECT *, max(run) OVER (PARTITION BY engine) AS last_run FROM (
    SELECT *, sum(success::INT) OVER (PARTITION BY engine ORDER BY ts, event_id) AS run FROM engine_log)) GROUP BY 1)"""
FINAL["geojson_export"] = f"""
SELECT poi_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']}},"properties":{{"name":' || to_json(coalesce({tag('name')}, name))
  || ',"category":' || to_json(category) || ',"icon":' || to_json(icon) || ',"distanceToTrace":' || {metres('d')}
  || coalesce(array_to_string([',' || to_json(x.key) || ':' || to_json(x.value) FOR x IN tags IF x.key <> 'name'], ''), '') || '}}}}' AS feature FROM corridor"""


def truncate_sql(col: str, limit: int) -> str:
    v = f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"
    head = f"substr({v}, 1, {limit - 1})"
    at = f"(length({head}) - strpos(reverse({head}), ' '))"
    cut = f"CASE WHEN contains({head}, ' ') AND {at} > {limit * 0.6} THEN substr({head}, 1, {at}) ELSE {head} END"
    return f"CASE WHEN length({v}) <= {limit} THEN {v} ELSE regexp_replace({cut}, '[,.;:!?\\-—\\s]+$', '') || '…' END"


CTE["desc_lines"] = f"""
SELECT poi_id, [x FOR x IN [
  concat_ws(' · ', category, CASE WHEN st = 'done' THEN '★' || printf('%.1f', rating) || coalesce(' (' || review_count || ')', '') END,
    CASE WHEN st = 'done' THEN repeat('$', price_level) END, 'km ' || printf('%.1f', along / 1000) || ' — ' || {metres('d')} || 'm'),
  CASE WHEN st = 'done' THEN {truncate_sql('description', 150)} END,
  CASE WHEN st = 'done' AND k % 4 = 2 THEN 'Mo-Fr 8-18:30 · Sa 9-12 · Su closed'
    WHEN st = 'done' AND hours IS NOT NULL THEN 'Mon-Fri: 8:00-12:00, 14:00-18:00 · Sat: 9:00-12:00 · Sun: closed'
    ELSE replace({tag('opening_hours')}, '; ', ' · ') END,
  coalesce('☎ ' || coalesce({tag('phone')}, {tag('contact:phone')}), nullif(coalesce({tag('website')}, {tag('contact:website')}), '')),
  CASE WHEN k % 4 = 3 THEN '⚠ Opening hours were not confirmed from the collected sources.' END] IF x IS NOT NULL] AS lines
FROM (SELECT c.*, e.status AS st, e.rating, e.review_count, e.price_level, e.description, e.hours, e.k FROM corridor c LEFT JOIN poi_enr e USING (poi_id))"""
CTE["compact"] = """
SELECT poi_id, array_to_string(CASE WHEN length(array_to_string(lines, chr(10))) <= 400 THEN lines WHEN length(array_to_string(lines[1:-2], chr(10))) <= 400 THEN lines[1:-2]
  ELSE lines[1:-3] END, chr(10)) AS description FROM desc_lines"""
FINAL["compact_desc"] = "SELECT * FROM compact"


def number(expr: str) -> str:
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"


def escaped(expr: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        expr = f"replace({expr}, {quote(char)}, {quote(entity)})"
    return expr


CTE["gpx_near"] = f"""
SELECT c.*, x.description, {metres('c.along')} AS metre, {case_map('c.category', rules.GPX_SYMBOL, quote(rules.GPX_SYMBOL_FALLBACK))} AS symbol,
  coalesce(([i FOR i IN [{case_map("x.key || '=' || x.value", rules.OSMAND_TAG_ICON)} FOR x IN c.tags] IF i IS NOT NULL])[1],
    {case_map('c.category', rules.OSMAND_ICON, quote(rules.OSMAND_ICON_FALLBACK))}) AS sign,
  {case_map('c.category', rules.OSMAND_ICON, quote(rules.OSMAND_ICON_FALLBACK))} AS group_sign,
  {case_map('c.category', rules.BACKGROUND_COLOUR, quote(rules.OSMAND_COLOUR_FALLBACK))} AS colour,
  {case_map('c.category', rules.OSMAND_BACKGROUND, quote(rules.OSMAND_BACKGROUND_FALLBACK))} AS back
FROM corridor c JOIN compact x USING (poi_id)"""


def gpx_sql(osmand: bool) -> str:
    """The lines of GPX documents, sections as in the documents: head, groups, waypoints, track, tail."""
    nl = "chr(10)"
    space = f" || {nl} || '  xmlns:osmand=\"https://osmand.net\"'" if osmand else ""
    more = (
        f" || '    <extensions>' || {nl} || '      <osmand:icon>' || sign || '</osmand:icon>' || {nl} || '      <osmand:color>' || colour"
        f" || '</osmand:color>' || {nl} || '      <osmand:background>' || back || '</osmand:background>' || {nl} || '    </extensions>' || {nl}"
    ) if osmand else ""
    parts = [
        f"""SELECT track_id AS doc_id, 0 AS section, 0::BIGINT AS ord, '' AS tie, '<?xml version="1.0" encoding="UTF-8"?>' || {nl}
  || '<gpx version="1.1" creator="trailspan" xmlns="http://www.topografix.com/GPX/1/1"'{space} || '>' || {nl} || '  <metadata>' || {nl}
  || '    <name>Places along the route</name>' || {nl} || '  </metadata>' AS text FROM points WHERE seq = 0""",
        f"""SELECT track_id, 4, metre, poi_id, '  <wpt lat="' || {number('round(lat, 7)')} || '" lon="' || {number('round(lon, 7)')} || '">' || {nl} || '    <name>' || {escaped('name')}
  || '</name>' || {nl} || '    <desc>' || {escaped('description')} || '</desc>' || {nl} || '    <type>' || {escaped('category')} || '</type>' || {nl} || '    <sym>' || symbol
  || '</sym>' || {nl}{more} || '  </wpt>' FROM gpx_near""",
        f"""SELECT track_id, 5, 0, '', '  <trk>' || {nl} || '    <name>Route &amp; ' || track_id || '</name>' || {nl} || '    <trkseg>' FROM points WHERE seq = 0""",
        f"""SELECT track_id, 6, seq, '', '      <trkpt lat="' || {number('round(lat, 7)')} || '" lon="' || {number('round(lon, 7)')} || '">'
  || coalesce({nl} || '        <ele>' || {number('round(ele, 3)')} || '</ele>', '') || {nl} || '      </trkpt>' FROM points""",
        f"""SELECT track_id, 7, 0, '', '    </trkseg>' || {nl} || '  </trk>' || {nl} || '</gpx>' FROM points WHERE seq = 0""",
    ]
    if osmand:
        parts += [
            f"SELECT track_id, 1, 0, '', '  <extensions>' || {nl} || '    <osmand:points_groups>' FROM points WHERE seq = 0",
            f"SELECT track_id, 3, 0, '', '    </osmand:points_groups>' || {nl} || '  </extensions>' FROM points WHERE seq = 0",
            f"""SELECT track_id, 2, min(metre), category, '      <group name="' || {escaped('category')} || '" color="' || colour || '" icon="' || group_sign
  || '" background="' || back || '" />' FROM gpx_near GROUP BY track_id, category, colour, group_sign, back""",
        ]
    return "\nUNION ALL ".join(parts)


FINAL["gpx_plain"] = gpx_sql(False)
FINAL["gpx_export"] = gpx_sql(True)


def shown(expr: str) -> str:
    return f"coalesce(to_json({expr})::VARCHAR, 'null')"


# Property, and what the test table has for it; the rest is null there.
_ENRICHED = {
    "rating": "coalesce(CAST(rating AS VARCHAR), 'null')", "reviewCount": shown("review_count"), "hours": shown("hours"),
    "openingHours": shown("CASE WHEN k % 4 = 2 THEN 'Mon-Fri: 08:00-18:30; Saturday: 09:00-12:00; Sun: Closed' END"),
    "description": shown("description"), "review": shown("""CASE WHEN k % 6 = 1 THEN 'Good "reviews".' END"""), "summary": "'null'", "translatedSummary": "'null'",
    "essentials": "'null'", "specialty": "'null'", "priceLevel": shown("price_level"), "googleMapsUrl": "'null'",
    "locality": shown("CASE WHEN k % 8 = 2 THEN 'Saumur' END"), "sourceCount": shown("k % 9"), "sourceEngines": "'null'",
    "confidence": "CAST(confidence AS VARCHAR)", "synthesisSource": "'null'", "synthesisReason": "'null'", "googleMapsFields": "'null'",
    "structured_headline": "'null'", "structured_operationalSummary": "'null'", "structured_practicalities": "'null'",
    "structured_cautions": shown("CASE WHEN k % 4 = 3 THEN 'Opening hours were not confirmed from the collected sources.' ELSE '' END"),
    "structured_unknowns": "'null'", "structured_sourceRollup": "'null'", "structured_divergences": "'null'", "structured_sourceConfirmation": "'null'",
}
_ADDED = " || ".join(f"',\"enrichment_{name}\":' || {value}" for name, value in _ENRICHED.items())
FINAL["geojson_enriched"] = f"""
SELECT c.poi_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']}},"properties":{{"name":' || to_json(coalesce({tag('name')}, name))
  || ',"category":' || to_json(category) || ',"icon":' || to_json(icon) || ',"distanceToTrace":' || {metres('d')}
  || coalesce(array_to_string([',' || to_json(x.key) || ':' || to_json(x.value) FOR x IN tags IF x.key <> 'name'], ''), '')
  || CASE WHEN e.status = 'done' THEN {_ADDED} ELSE '' END || '}}}}' AS feature FROM corridor c LEFT JOIN poi_enr e USING (poi_id)"""
