"""DuckDB SQL of the further queries."""

from __future__ import annotations

from wayloom.plans.oracles import _cell, _inside, _t  # noqa: F401

_WHITE = "(SELECT cell FROM white)"
_SLICE_EDGES = "fs AS (SELECT DISTINCT o_cell AS src, d_cell AS dst FROM slices WHERE {} AND o_cell <> d_cell)"
_CONTINGENCY = """t AS (SELECT label AS a, CAST(embedding[1] > 0 AS INT)*2 + CAST(embedding[2] > 0 AS INT) AS b FROM embeddings),
c AS (SELECT a, b, count(*)::DOUBLE AS n FROM t GROUP BY ALL), ra AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), tot AS (SELECT sum(n) AS n FROM c)"""

MORE = {
    "numbered_all": _t("SELECT trip_key, row_number() OVER (ORDER BY trip_key) - 1 AS number FROM trips"),
    "od_order_slice": _t("SELECT trip_key, start_sec FROM (SELECT trip_key, start_sec, row_number() OVER (ORDER BY start_sec, trip_key) - 1 AS r, count(*) OVER () AS n FROM trips) WHERE r BETWEEN n//3 AND n//3 + n//5 - 1"),
    "hot_cell_flow": _t(f"SELECT o_cell - 1 AS o_cell, d_cell - 1 AS d_cell, flow FROM flows WHERE o_cell IN {_WHITE} AND d_cell IN {_WHITE}"),
    "masked_pairs": _t(f"SELECT row_number() OVER (ORDER BY o_cell*100 + d_cell) - 1 AS number, o_cell, d_cell FROM (SELECT * FROM flows WHERE o_cell IN {_WHITE} AND d_cell IN {_WHITE} ORDER BY o_cell*100 + d_cell LIMIT 200)"),
    "slice_line_nodes": _t(f"SELECT src||'_'||dst AS name, src, dst FROM (SELECT DISTINCT o_cell AS src, d_cell AS dst FROM slices WHERE slice = 528 AND o_cell <> d_cell)"),
    "slice_line_edges": _t("SELECT a.src||'_'||a.dst AS source, b.src||'_'||b.dst AS target FROM (SELECT DISTINCT o_cell AS src, d_cell AS dst FROM slices WHERE slice % 96 // 8 = 6 AND o_cell <> d_cell) a JOIN (SELECT DISTINCT o_cell AS src, d_cell AS dst FROM slices WHERE slice % 96 // 8 = 6 AND o_cell <> d_cell) b ON a.dst = b.src"),
    "sliding_history": _t("""SELECT s.slice, p.o_cell, p.d_cell, coalesce(own.flow, 0) AS flow, (SELECT string_agg(CAST(coalesce(h.flow, 0) AS VARCHAR), ',' ORDER BY r.k) FROM (SELECT range AS k FROM range(576 - 96, 579)) r LEFT JOIN slices h ON h.slice = r.k AND h.o_cell = p.o_cell AND h.d_cell = p.d_cell WHERE r.k BETWEEN s.slice - 96 AND s.slice - 1) AS history
FROM (SELECT DISTINCT o_cell, d_cell FROM slices WHERE slice BETWEEN 480 AND 579) p CROSS JOIN (SELECT range AS slice FROM range(576, 580)) s LEFT JOIN slices own ON own.slice = s.slice AND own.o_cell = p.o_cell AND own.d_cell = p.d_cell"""),
    "flow_totals": _t("SELECT count(*) AS rows, CAST(sum(flow) AS BIGINT) AS flow FROM flows"),
    "od_index_pairs": _t("SELECT o_cell*100 + d_cell AS od, o_cell, d_cell FROM flows"),
    "nearest_centre": _t("SELECT event_id, arg_min(cell, (s, cell)) AS cell FROM (SELECT event_id, c.cell, (c.lon - g.lon)*(c.lon - g.lon) + (c.lat - g.lat)*(c.lat - g.lat) AS s FROM gps g CROSS JOIN centre c) GROUP BY 1"),
    "region_time_filter": _t(f"SELECT event_id FROM gps WHERE {_inside('lon', 'lat')} AND sec BETWEEN 21600 AND 72000"),
    "polygon_time_cell": _t("SELECT event_id, CAST(sec//900 AS BIGINT)*7 + user_id % 7 AS cell FROM gps"),
    "gps_keys": _t("SELECT event_id, printf('%.5f', round(lon, 5))||'_'||printf('%.6f', round(lat, 6))||'_'||sec AS key FROM gps"),
    "trip_key_parts": _t("SELECT trip_key, day||'_'||idx AS short, day, idx FROM (SELECT trip_key, day, CAST(row_number() OVER (PARTITION BY month, day ORDER BY user_id) - 1 AS INT) AS idx FROM trips)"),
    "node_name_parts": _t("SELECT src||'_'||dst AS name, src, dst FROM noloop"),
    "colour_scale": _t("SELECT o_cell, d_cell, round(CASE WHEN flow < 3 THEN (flow - 1)/2.0::DOUBLE*0.5::DOUBLE ELSE least(1.0::DOUBLE, 0.5::DOUBLE + (flow - 3)/6.0::DOUBLE*0.5::DOUBLE) END, 6) AS place FROM flows"),
    "array_places": "SELECT vec_id, list_position(embedding, list_min(embedding)) - 1 AS least, list_position(embedding, list_max(embedding)) - 1 AS greatest FROM embeddings",
    "neighbour_distance": _t("""SELECT e.src, e.dst, round(1 - count(*) FILTER (x.n = 2)/count(*)::DOUBLE, 6) AS distance FROM noloop e JOIN (SELECT DISTINCT dst FROM edges WHERE false UNION SELECT DISTINCT src FROM edges) s ON s.dst = e.dst, LATERAL (SELECT d, count(*) AS n FROM (SELECT dst AS d FROM edges WHERE src = e.src UNION ALL SELECT dst FROM edges WHERE src = e.dst) GROUP BY d) x GROUP BY ALL"""),
    "repeated_keys": _t(f"SELECT trip_key, n, first_sec, last_sec FROM (SELECT trip_key, count(*) AS n, min(sec) AS first_sec, max(sec) AS last_sec FROM ends WHERE {_inside('lon', 'lat')} GROUP BY 1) WHERE n >= 2 ORDER BY trip_key LIMIT 500"),
    "poi_in_bounds": _t("SELECT poi_id FROM poi, (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM ends WHERE month = 1 AND day = 5 AND start_sec BETWEEN 0 AND 86400) b WHERE lon BETWEEN w AND e AND lat BETWEEN s AND n"),
    "sequence_batches": _t(f"""SELECT trip_key, number // 128 AS batch, number % 128 AS row, length, tokens||repeat(',0', CAST(max(length) OVER (PARTITION BY number // 128) - length AS INT)) AS tokens
FROM (SELECT *, row_number() OVER (ORDER BY length DESC, trip_key) - 1 AS number FROM (SELECT trip_key, count(*) AS length, string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ',' ORDER BY seq) AS tokens FROM p LEFT JOIN vocab v ON p.inside AND v.cell = p.cell GROUP BY 1))"""),
    "length_buckets": _t("""SELECT trip_key, CASE WHEN a <= 2 AND b <= 2 THEN 0 WHEN a <= 4 AND b <= 4 THEN 1 ELSE 2 END AS bucket
FROM (SELECT trip_key, count(*) AS a, count(*) FILTER (seq = 0 OR t <> before) AS b FROM (SELECT trip_key, seq, t, lag(t) OVER (PARTITION BY trip_key ORDER BY seq) AS before FROM (SELECT trip_key, seq, CASE WHEN inside THEN cell + 4 ELSE 3 END AS t FROM p)) GROUP BY 1) WHERE a <= 8 AND b <= 6"""),
    "trip_embedding": _t("SELECT trip_key, 1.0::DOUBLE AS square FROM trips"),
    "mean_conductance": _t("SELECT round(avg(cut/(cut + volume)), 8) AS mean FROM (SELECT community, sum(x)::DOUBLE AS cut, count(*)::DOUBLE AS volume FROM (SELECT unnest([c1, c2]) AS community, CAST(c1 <> c2 AS INT) AS x FROM lab2) GROUP BY 1) WHERE cut > 0"),
    "mean_tpr": _t("""SELECT round(avg(coalesce(h.n, 0)/m.n::DOUBLE), 8) AS mean FROM (SELECT community, count(*) AS n FROM labels GROUP BY 1) m LEFT JOIN (SELECT c, count(*) AS n FROM (SELECT DISTINCT x.c1 AS c, unnest([x.src, x.dst, y.dst]) AS cell FROM (SELECT * FROM lab2 WHERE c1 = c2 AND src <> dst) x JOIN (SELECT * FROM lab2 WHERE c1 = c2 AND src <> dst) y ON x.dst = y.src AND x.src <> y.dst JOIN lab2 z ON z.src = x.src AND z.dst = y.dst) GROUP BY 1) h ON h.c = m.community"""),
    "community_members": _t("SELECT community, count(*) AS n, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) AS members FROM labels WHERE cell IN (SELECT src FROM edges UNION SELECT dst FROM edges) GROUP BY 1"),
    "community_lines": _t("""SELECT community, line_name, row_number() OVER (PARTITION BY community ORDER BY line_name, k) - 1 AS index, round(lon, 6) AS lon, round(lat, 6) AS lat
FROM (SELECT l.c1 AS community, l.src||'_'||l.dst AS line_name, k, CASE k WHEN 0 THEN o.lon ELSE e.lon END AS lon, CASE k WHEN 0 THEN o.lat ELSE e.lat END AS lat FROM lab2 l JOIN centre o ON o.cell = l.src JOIN centre e ON e.cell = l.dst CROSS JOIN (SELECT unnest([0, 1]) AS k) WHERE c1 = c2 AND src <> dst)"""),
    "community_trips": _t("SELECT DISTINCT l.c1 AS community, t.trip_key FROM lab2 l JOIN trips t ON t.o_cell = l.src AND t.d_cell = l.dst AND t.od_in_region WHERE l.c1 = l.c2 AND l.src <> l.dst"),
    "node_trip_counts": _t("SELECT src||'_'||dst AS name, flow AS trips, round(coalesce((flow - min(flow) OVER ())/nullif(max(flow) OVER () - min(flow) OVER (), 0)::DOUBLE, 0), 6) AS share FROM brushed"),
    "mean_trips": _t("SELECT CAST(floor(sum(flow)/count(*)) AS BIGINT) AS mean_trips FROM brushed"),
    "connected_labels": _t("SELECT src||'_'||dst AS name, src % 10 AS community FROM brushed WHERE src % 10 = dst % 10 AND src||'_'||dst IN (SELECT source FROM bline UNION SELECT target FROM bline)"),
    "silhouette": """WITH f AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e)*list_distance(a.e, b.e)) AS d, count(*) AS n FROM f a JOIN f b ON true GROUP BY ALL),
s AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other THEN d/nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN d/n END) AS b FROM m GROUP BY 1)
SELECT round(avg(CASE WHEN n > 1 THEN (b - a)/greatest(a, b) ELSE 0 END), 5) AS silhouette FROM s""",
}
