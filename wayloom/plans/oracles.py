"""DuckDB SQL for the named queries, written from their definitions."""

from __future__ import annotations

_R = "0.017453292519943295::DOUBLE"


def _x(lon: str) -> str:
    return f"(6378137.0::DOUBLE*{lon}*{_R})"


def _y(lat: str) -> str:
    return f"(3189068.5::DOUBLE*ln((1+sin({lat}*{_R}))/(1-sin({lat}*{_R}))))"


def _cell(lon: str, lat: str) -> str:
    return f"(CAST(floor(round({_y(lat)} - 3533599.5404260196::DOUBLE, 6)/876.5::DOUBLE) AS BIGINT)*10 + CAST(floor(round({_x(lon)} - 13370450.455791138::DOUBLE, 6)/928.4045532159507::DOUBLE) AS BIGINT))"


def _inside(lon: str, lat: str) -> str:
    return f"({lon} BETWEEN 120.1088::DOUBLE AND 120.1922::DOUBLE AND {lat} BETWEEN 30.2335::DOUBLE AND 30.3015::DOUBLE)"


def _metres(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(({_x(a)}-{_x(c)})*({_x(a)}-{_x(c)})+({_y(b)}-{_y(d)})*({_y(b)}-{_y(d)}))"


def _clock(sec: str) -> str:
    return f"(lpad(CAST({sec}//3600 AS VARCHAR),2,'0')||':'||lpad(CAST({sec}%3600//60 AS VARCHAR),2,'0')||':'||lpad(CAST({sec}%60 AS VARCHAR),2,'0'))"


_GPS = """gps AS (SELECT event_id, user_id, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(hour(ts)*3600+minute(ts)*60+second(ts) AS INT) AS sec,
120.1::DOUBLE + CAST((event_id*7919 + user_id*104729) % 10000 AS DOUBLE)*0.00001::DOUBLE AS lon, 30.2275::DOUBLE + CAST((event_id*6271 + user_id*15485863) % 10000 AS DOUBLE)*0.000008::DOUBLE AS lat FROM events)"""
_TRIPS = f"""{_GPS},
pt AS (SELECT *, concat_ws('_', user_id, month, day) AS trip_key, CAST(row_number() OVER (PARTITION BY user_id, month, day ORDER BY sec, event_id) - 1 AS INT) AS seq, CAST(count(*) OVER (PARTITION BY user_id, month, day) AS INT) AS n FROM gps),
p AS (SELECT *, {_inside('lon', 'lat')} AS inside, {_cell('lon', 'lat')} AS cell FROM pt WHERE n >= 2),
trips AS (SELECT o.trip_key, o.user_id, o.month, o.day, o.n, o.sec AS start_sec, d.sec AS end_sec, o.lon AS o_lon, o.lat AS o_lat, o.sec AS o_sec, d.lon AS d_lon, d.lat AS d_lat, d.sec AS d_sec,
CASE WHEN o.inside THEN o.cell END AS o_cell, CASE WHEN d.inside THEN d.cell END AS d_cell, o.inside AND d.inside AS od_in_region FROM p o JOIN p d ON o.trip_key = d.trip_key AND o.seq = 0 AND d.seq = d.n - 1),
ends AS (SELECT trip_key, month, day, 0 AS flag, o_lon AS lon, o_lat AS lat, o_sec AS sec, start_sec FROM trips UNION ALL SELECT trip_key, month, day, 1, d_lon, d_lat, d_sec, start_sec FROM trips),
flows AS (SELECT o_cell, d_cell, count(*) AS flow FROM trips WHERE od_in_region GROUP BY ALL),
edges AS (SELECT o_cell AS src, d_cell AS dst, flow FROM flows),
seg AS (SELECT a.trip_key, a.seq, a.sec AS sec_a, b.sec AS sec_b, a.lon AS lon_a, a.lat AS lat_a, b.lon AS lon_b, b.lat AS lat_b, {_metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS metres FROM p a JOIN p b ON a.trip_key = b.trip_key AND b.seq = a.seq + 1),
spd AS (SELECT *, CASE WHEN sec_b > sec_a THEN metres*3.6::DOUBLE/(sec_b - sec_a) END AS speed FROM seg),
lev AS (SELECT *, CASE WHEN speed <= 20 THEN 1 WHEN speed < 40 THEN 2 WHEN speed < 60 THEN 3 WHEN speed IS NOT NULL THEN 4 END AS level FROM spd),
cells AS (SELECT range AS cell FROM range(100)),
labels AS (SELECT cell, cell % 10 AS community FROM cells),
brush AS (SELECT unnest([11,12,13,21,22,23,31,32,33])::BIGINT AS cell),
white AS (SELECT range AS cell FROM range(0, 100, 3)),
brushed AS (SELECT * FROM edges WHERE src <> dst AND (src IN (SELECT cell FROM brush) OR dst IN (SELECT cell FROM brush))),
noloop AS (SELECT * FROM edges WHERE src <> dst),
line AS (SELECT a.src||'_'||a.dst AS source, b.src||'_'||b.dst AS target FROM noloop a JOIN noloop b ON a.dst = b.src),
bline AS (SELECT a.src||'_'||a.dst AS source, b.src||'_'||b.dst AS target FROM brushed a JOIN brushed b ON a.dst = b.src),
centre AS (SELECT cell, (13370450.455791138::DOUBLE + (cell % 10 + 0.5::DOUBLE)*928.4045532159507::DOUBLE)/6378137.0::DOUBLE/{_R} AS lon, asin((exp((3533599.5404260196::DOUBLE + (cell // 10 + 0.5::DOUBLE)*876.5::DOUBLE)/3189068.5::DOUBLE)-1)/(exp((3533599.5404260196::DOUBLE + (cell // 10 + 0.5::DOUBLE)*876.5::DOUBLE)/3189068.5::DOUBLE)+1))/{_R} AS lat FROM cells),
slices AS (SELECT CAST((day-1)*96 + o_sec//900 AS BIGINT) AS slice, o_cell, d_cell, count(*) AS flow FROM trips WHERE od_in_region GROUP BY ALL),
counts AS (SELECT {_cell('lon', 'lat')} AS cell, count(*) AS n FROM gps WHERE {_inside('lon', 'lat')} GROUP BY 1),
vocab AS (SELECT cell, n, CAST(row_number() OVER (ORDER BY n DESC, cell) + 3 AS INT) AS id FROM (SELECT * FROM counts WHERE n >= 2 ORDER BY n DESC, cell LIMIT 60)),
knn AS (SELECT p, q FROM (SELECT a.cell AS p, b.cell AS q, row_number() OVER (PARTITION BY a.cell ORDER BY (a.cell%10-b.cell%10)*(a.cell%10-b.cell%10)+(a.cell//10-b.cell//10)*(a.cell//10-b.cell//10), b.cell) AS r FROM cells a JOIN cells b ON a.cell <> b.cell) WHERE r <= 4),
und AS (SELECT DISTINCT unnest([src, dst]) AS i, unnest([dst, src]) AS j FROM noloop WHERE flow > 1),
lo AS (SELECT i, j, count(*)::DOUBLE AS w FROM (SELECT i, j FROM und UNION ALL SELECT DISTINCT i, i FROM und) GROUP BY ALL),
dg AS (SELECT i, sum(w) AS d FROM lo GROUP BY 1),
sy AS (SELECT lo.i, lo.j, w/sqrt(a.d*b.d) + CASE WHEN lo.i = lo.j THEN 1 ELSE 0 END AS w FROM lo JOIN dg a ON lo.i = a.i JOIN dg b ON lo.j = b.i),
nrm AS (SELECT sy.i, sy.j, sy.w/s.s AS w FROM sy JOIN (SELECT i, sum(w) AS s FROM sy GROUP BY 1) s USING (i)),
poi AS (SELECT p_partkey AS poi_id, p_type AS category, 120.1::DOUBLE + CAST(p_partkey*7919 % 10000 AS DOUBLE)*0.00001::DOUBLE AS lon, 30.2275::DOUBLE + CAST(p_partkey*6271 % 10000 AS DOUBLE)*0.000008::DOUBLE AS lat FROM part),
gxy AS (SELECT event_id, {_x('lon')} AS x, {_y('lat')} AS y FROM gps), pxy AS (SELECT poi_id, category, {_x('lon')} AS x, {_y('lat')} AS y FROM poi),
nb AS (SELECT event_id, poi_id, category, sqrt((g.x-q.x)*(g.x-q.x)+(g.y-q.y)*(g.y-q.y)) AS metres FROM gxy g JOIN pxy q ON q.x BETWEEN g.x-300 AND g.x+300 AND q.y BETWEEN g.y-300 AND g.y+300 WHERE (g.x-q.x)*(g.x-q.x)+(g.y-q.y)*(g.y-q.y) <= 90000),
top60 AS (SELECT o_cell||'_'||d_cell AS name, o_cell, d_cell FROM (SELECT * FROM flows WHERE o_cell <> d_cell ORDER BY flow DESC, o_cell, d_cell LIMIT 60)),
tp AS (SELECT name, o.lon AS o_lon, o.lat AS o_lat, d.lon AS d_lon, d.lat AS d_lat FROM top60 JOIN centre o ON o.cell = o_cell JOIN centre d ON d.cell = d_cell),
pairs AS (SELECT a.name AS a, b.name AS b, least({_metres('a.o_lon', 'a.o_lat', 'b.o_lon', 'b.o_lat')} + {_metres('a.d_lon', 'a.d_lat', 'b.d_lon', 'b.d_lat')}, {_metres('a.o_lon', 'a.o_lat', 'b.d_lon', 'b.d_lat')} + {_metres('a.d_lon', 'a.d_lat', 'b.o_lon', 'b.o_lat')})/100 AS distance FROM tp a JOIN tp b ON a.name < b.name),
feat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
lab2 AS (SELECT src, dst, a.community AS c1, b.community AS c2 FROM edges JOIN labels a ON a.cell = src JOIN labels b ON b.cell = dst)"""


def _t(body: str) -> str:
    return f"WITH {_TRIPS}\n{body}"


def _scoped(hours: bool = True) -> str:
    return "month = 1 AND day BETWEEN 5 AND 20" + (" AND start_sec BETWEEN 21600 AND 72000" if hours else "")


_UNIT = "(cell % 10 + 0.5::DOUBLE)*928.4045532159507::DOUBLE/(6378137.0::DOUBLE*120.1922::DOUBLE*0.017453292519943295::DOUBLE - 13370450.455791138::DOUBLE)"
_UNIT_Y = f"(cell // 10 + 0.5::DOUBLE)*876.5::DOUBLE/({_y('30.3015::DOUBLE')} - 3533599.5404260196::DOUBLE)"

ORACLES = {
    "grid_cell_assign": _t(f"SELECT event_id, CASE WHEN {_inside('lon', 'lat')} THEN {_cell('lon', 'lat')} ELSE -1 END AS cell FROM gps"),
    "spacetime_cell": _t(f"SELECT event_id, CAST(sec//900 AS BIGINT)*100 + {_cell('lon', 'lat')} AS st_cell FROM gps WHERE {_inside('lon', 'lat')}"),
    "mercator_round_trip": _t(f"SELECT event_id, round({_x('lon')}, 3) AS x, round({_y('lat')}, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM gps"),
    "region_centres": _t(f"SELECT cell, round(lon, 6) AS lon, round(lat, 6) AS lat, round({_UNIT}, 6) AS unit_x, round({_UNIT_Y}, 6) AS unit_y FROM centre"),
    "circular_range": _t("SELECT event_id, sec FROM gps WHERE sec >= 79200 OR sec <= 7200"),
    "slice_angle": _t("SELECT event_id, CAST(sec//900 AS BIGINT) AS slice, round(pi()*(0.5::DOUBLE - 2*(sec//900)/96.0::DOUBLE), 6) AS angle FROM gps"),
    "clock_format": _t(f"SELECT event_id, {_clock('sec')} AS clock FROM gps"),
    "point_lists": _t("SELECT trip_key, n, start_sec AS first_sec, end_sec AS last_sec FROM trips"),
    "poi_labels": "SELECT p_partkey AS poi_id, CASE WHEN p_type = 'ECONOMY' THEN 'BASIC' ELSE p_type END AS label FROM part",
    "region_filter_points": _t(f"SELECT trip_key, flag, sec FROM ends WHERE {_inside('lon', 'lat')}"),
    "region_filter_trips": _t("SELECT trip_key, n FROM trips WHERE od_in_region"),
    "rect_trips": _t("SELECT trip_key, n FROM trips WHERE o_lon BETWEEN 120.12::DOUBLE AND 120.18::DOUBLE AND d_lon BETWEEN 120.12::DOUBLE AND 120.18::DOUBLE AND o_lat BETWEEN 30.24::DOUBLE AND 30.29::DOUBLE AND d_lat BETWEEN 30.24::DOUBLE AND 30.29::DOUBLE"),
    "hour_filter_od": _t(f"SELECT trip_key, flag, sec FROM ends WHERE {_scoped()}"),
    "od_pairs_strict": _t(f"SELECT trip_key, o_cell, d_cell FROM trips WHERE od_in_region AND {_scoped()} AND end_sec BETWEEN 21600 AND 72000"),
    "clipped_trips": _t("SELECT trip_key, count(*) AS n FROM p WHERE n BETWEEN 2 AND 6 AND inside GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6"),
    "trip_endpoints": _t("SELECT trip_key, month, day, flag, round(lon, 6) AS lon, round(lat, 6) AS lat, sec FROM ends"),
    "trip_numbers": _t("SELECT trip_key, row_number() OVER (PARTITION BY month, day ORDER BY user_id) - 1 AS idx FROM trips"),
    "stride_sample": _t("SELECT trip_key FROM (SELECT trip_key, row_number() OVER (PARTITION BY month, day ORDER BY user_id) - 1 AS idx FROM trips) WHERE idx % 5 = 0"),
    "bbox": _t("SELECT round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat FROM p"),
    "distinct_coords": _t("SELECT DISTINCT round(lon, 5) AS lon, round(lat, 6) AS lat FROM ends"),
    "trip_segments": _t("SELECT trip_key, CAST(seq AS BIGINT) AS seq, sec_a, sec_b, round(metres, 3) AS metres FROM seg"),
    "segment_speed": _t("SELECT trip_key, CAST(seq AS BIGINT) AS seq, round(speed, 4) AS speed, level FROM lev"),
    "trip_speed_summary": _t(f"SELECT trip_key, round(CASE WHEN end_sec > start_sec THEN {_metres('o_lon', 'o_lat', 'd_lon', 'd_lat')}*3.6::DOUBLE/(end_sec-start_sec) END, 4) AS displacement_speed, round(m, 4) AS mean_segment_speed, round(lo_, 4) AS min_speed, round(hi, 4) AS max_speed, coalesce(levels, '') AS levels FROM trips JOIN (SELECT trip_key, avg(speed) AS m, min(speed) AS lo_, max(speed) AS hi, string_agg(CAST(level AS VARCHAR), ',' ORDER BY seq) AS levels FROM lev GROUP BY 1) USING (trip_key)"),
    "trip_lookup": _t("SELECT trip_key, n, start_sec, end_sec FROM (SELECT *, row_number() OVER (PARTITION BY month, day ORDER BY user_id) - 1 AS idx FROM trips) WHERE idx % 7 = 0"),
    "gis_rows": _t("SELECT trip_key||'_'||seq AS line_name, seq*2 AS index, round(lon_a, 6) AS lon, round(lat_a, 6) AS lat FROM seg UNION ALL SELECT trip_key||'_'||seq, seq*2+1, round(lon_b, 6), round(lat_b, 6) FROM seg"),
    "daily_counts": _t("SELECT CAST(r.range AS INT) AS day, count(trip_key) AS trips FROM range(1, 32) r LEFT JOIN trips ON day = r.range AND month = 1 GROUP BY 1"),
    "hourly_counts": _t("SELECT CAST(r.range AS INT) AS hour, count(trip_key) AS trips FROM range(24) r LEFT JOIN trips ON start_sec//3600 = r.range AND month = 1 AND day BETWEEN 5 AND 20 GROUP BY 1"),
    "od_flow": _t("SELECT * FROM flows"),
    "od_flow_topk": _t("SELECT * FROM flows ORDER BY flow DESC, o_cell, d_cell LIMIT 50"),
    "od_hot_endpoints": _t("SELECT trip_key, o_cell, d_cell FROM (SELECT *, row_number() OVER (PARTITION BY o_cell, d_cell ORDER BY trip_key) AS r FROM trips WHERE od_in_region) WHERE r > 1"),
    "hot_grid_graph": _t("SELECT o_cell, d_cell, flow - 1 AS flow FROM flows WHERE flow > 1"),
    "od_cells_used": _t("SELECT DISTINCT unnest([o_cell, d_cell]) AS cell FROM (SELECT * FROM flows ORDER BY flow DESC, o_cell, d_cell LIMIT 50)"),
    "od_heat": _t("SELECT CAST(d.range AS INT) AS day, CAST(h.range AS INT) AS hour, count(trip_key) AS trips FROM range(14, 21) d CROSS JOIN range(24) h LEFT JOIN trips ON day = d.range AND start_sec//3600 = h.range AND month = 1 AND o_cell < 50 AND d_cell >= 50 AND od_in_region GROUP BY ALL"),
    "flow_slices": _t("SELECT * FROM slices"),
    "flow_slices_same": _t("SELECT CAST((day-1)*96 + o_sec//900 AS BIGINT) AS slice, o_cell, d_cell, count(*) AS flow FROM trips WHERE od_in_region AND o_sec//900 = d_sec//900 GROUP BY ALL"),
    "flow_slices_dense": _t("SELECT s.range AS slice, o.c AS o_cell, d.c AS d_cell, coalesce(flow, 0) AS flow FROM range(480, 576) s CROSS JOIN (SELECT unnest([0,11,22,33,44,55])::BIGINT AS c) o CROSS JOIN (SELECT unnest([0,11,22,33,44,55])::BIGINT AS c) d LEFT JOIN slices x ON x.slice = s.range AND x.o_cell = o.c AND x.d_cell = d.c"),
    "flow_grid_export": _t("SELECT row_number() OVER (ORDER BY s.range, o.c, d.c) - 1 AS dyna_id, 'state' AS type, lpad(CAST(s.range//96+1 AS VARCHAR),2,'0')||'T'||" + _clock("(CAST(s.range%96*900 AS INT))") + " AS time, CAST(o.c//10 AS INT) AS origin_row_id, CAST(o.c%10 AS INT) AS origin_column_id, CAST(d.c//10 AS INT) AS destination_row_id, CAST(d.c%10 AS INT) AS destination_column_id, coalesce(flow, 0) AS flow FROM range(480, 576) s CROSS JOIN (SELECT unnest([0,11,22])::BIGINT AS c) o CROSS JOIN (SELECT unnest([0,11,22])::BIGINT AS c) d LEFT JOIN slices x ON x.slice = s.range AND x.o_cell = o.c AND x.d_cell = d.c"),
    "flow_history_vec": _t("SELECT o_cell, d_cell, string_agg(CAST(coalesce(flow, 0) AS VARCHAR), ',' ORDER BY s.range) AS history FROM (SELECT DISTINCT o_cell, d_cell FROM slices WHERE slice BETWEEN 480 AND 575) k CROSS JOIN range(480, 576) s LEFT JOIN slices x ON x.slice = s.range AND x.o_cell = k.o_cell AND x.d_cell = k.d_cell GROUP BY k.o_cell, k.d_cell").replace("SELECT o_cell, d_cell, string_agg", "SELECT k.o_cell, k.d_cell, string_agg"),
    "od_union_days": _t("SELECT trip_key, flag, sec FROM ends WHERE month = 1 AND day IN (5, 6)"),
    "cell_points": _t(f"SELECT {_cell('lon', 'lat')} AS cell, trip_key, flag FROM ends WHERE {_inside('lon', 'lat')}"),
    "adjacency_out": _t("SELECT o_cell AS cell, string_agg(CAST(d_cell AS VARCHAR), ',' ORDER BY d_cell) AS neighbours FROM flows GROUP BY 1"),
    "adjacency_in": _t("SELECT d_cell AS cell, string_agg(CAST(o_cell AS VARCHAR), ',' ORDER BY o_cell) AS neighbours FROM flows GROUP BY 1"),
    "cluster_centers": _t(f"SELECT {_cell('lon', 'lat')} AS cell, round(avg(lon), 9) AS lon, round(avg(lat), 9) AS lat, count(*) AS n FROM ends WHERE {_inside('lon', 'lat')} GROUP BY 1"),
    "cluster_degree": _t("SELECT cell, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o*flow) AS BIGINT) AS out_flow, CAST(sum(i*flow) AS BIGINT) AS in_flow FROM (SELECT o_cell AS cell, 1 AS o, 0 AS i, flow FROM flows UNION ALL SELECT d_cell, 0, 1, flow FROM flows) GROUP BY 1"),
    "cluster_flow_history": _t("SELECT cell, day, CAST(sum(o) AS BIGINT) AS out_flow, CAST(sum(1-o) AS BIGINT) AS in_flow FROM (SELECT o_cell AS cell, day, 1 AS o FROM trips WHERE od_in_region UNION ALL SELECT d_cell, day, 0 FROM trips WHERE od_in_region) GROUP BY ALL"),
    "whitelist_intersect": _t("SELECT o_cell AS cell, coalesce(string_agg(CAST(d_cell AS VARCHAR), ',' ORDER BY d_cell) FILTER (d_cell IN (SELECT cell FROM white)), '') AS neighbours FROM flows WHERE o_cell IN (SELECT cell FROM white) GROUP BY 1"),
    "od_graph_filtered": _t("SELECT * FROM brushed"),
    "line_graph_nodes": _t("SELECT src||'_'||dst AS name, src, dst FROM noloop"),
    "line_graph_edges": _t("SELECT * FROM line"),
    "node_degree": _t("SELECT name, count(*) AS degree FROM (SELECT source AS name FROM bline UNION ALL SELECT target FROM bline) GROUP BY 1"),
    "brush_expand": _t("SELECT src AS cell FROM edges WHERE dst IN (SELECT cell FROM brush) UNION SELECT dst FROM edges WHERE src IN (SELECT cell FROM brush) UNION SELECT cell FROM brush"),
    "odpair_distance": _t("SELECT a, b, round(distance, 4) AS distance FROM pairs"),
    "fake_edges": _t("SELECT a, b, round(distance, 4) AS distance, NOT EXISTS (SELECT 1 FROM line WHERE (source = a AND target = b) OR (source = b AND target = a)) AS fake FROM pairs"),
    "edge_communities": _t("SELECT DISTINCT src||'_'||dst AS name, c1 AS community FROM lab2 WHERE c1 = c2"),
    "community_sizes": _t("SELECT community, count(*) AS members, count(*) > 5 AS ok FROM labels WHERE cell IN (SELECT o_cell FROM flows UNION SELECT d_cell FROM flows) GROUP BY 1"),
    "community_links": _t("SELECT DISTINCT c1, c2 FROM lab2 WHERE c1 <> c2"),
    "anti_remaining": _t("SELECT cell FROM cells WHERE cell NOT IN (SELECT unnest([o_cell, d_cell]) FROM (SELECT * FROM flows ORDER BY flow DESC, o_cell, d_cell LIMIT 30))"),
    "conductance": _t("SELECT community, CAST(sum(cut) AS BIGINT) AS cut, count(*) AS volume, round(CASE WHEN sum(cut) > 0 THEN sum(cut)::DOUBLE/(sum(cut)+count(*)) END, 6) AS conductance FROM (SELECT c1 AS community, (c1 <> c2)::INT AS cut FROM lab2 UNION ALL SELECT c2, (c1 <> c2)::INT FROM lab2) GROUP BY 1"),
    "modularity": _t("SELECT round(sum((a.c1 = b.c2)::INT*((e.src IS NOT NULL)::INT - a.k*b.k/m)/m), 8) AS q FROM (SELECT src, c1, count(*)::DOUBLE AS k FROM lab2 GROUP BY ALL) a CROSS JOIN (SELECT dst, c2, count(*)::DOUBLE AS k FROM lab2 GROUP BY ALL) b CROSS JOIN (SELECT count(*)::DOUBLE AS m FROM lab2) LEFT JOIN edges e ON e.src = a.src AND e.dst = b.dst"),
    "tpr": _t("SELECT community, count(*) AS members, count(t.cell) AS in_triangle, round(count(t.cell)::DOUBLE/count(*), 6) AS tpr FROM labels LEFT JOIN (SELECT DISTINCT unnest([x.src, x.dst, y.dst]) AS cell FROM lab2 x JOIN lab2 y ON x.dst = y.src AND y.dst <> x.src JOIN lab2 z ON z.src = x.src AND z.dst = y.dst WHERE x.src <> x.dst AND y.src <> y.dst AND x.c1 = x.c2 AND y.c1 = y.c2) t USING (cell) GROUP BY 1"),
    "trips_by_node": _t("SELECT o_cell||'_'||d_cell AS name, trip_key FROM trips JOIN brushed ON o_cell = src AND d_cell = dst WHERE od_in_region"),
    "node_features_mean": _t("SELECT b.src||'_'||b.dst AS name, count(DISTINCT trip_key) AS n, CAST(ks.range AS INT) AS k, round(coalesce(avg(x), 0), 6) AS x FROM brushed b CROSS JOIN range(64) ks LEFT JOIN trips t ON t.o_cell = b.src AND t.d_cell = b.dst AND t.od_in_region LEFT JOIN feat ON vec_id = (user_id*31+day) % (SELECT count(*) FROM embeddings) AND feat.k = ks.range GROUP BY ALL"),
    "poi_within_radius": _t("SELECT event_id, poi_id, round(metres, 3) AS metres FROM nb"),
    "poi_profile": _t("SELECT category, count(DISTINCT poi_id) AS n FROM nb GROUP BY 1"),
    "poi_top3": _t("SELECT event_id, rank, category, n FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, category) AS rank FROM (SELECT event_id, category, count(*) AS n FROM nb GROUP BY ALL)) WHERE rank <= 3"),
    "poi_knn": _t(f"SELECT trip_key, poi_id, rank, round(sqrt(sq), 3) AS metres FROM (SELECT trip_key, poi_id, sq, row_number() OVER (PARTITION BY trip_key ORDER BY sq, poi_id) AS rank FROM (SELECT trip_key, poi_id, (px-x)*(px-x)+(py-y)*(py-y) AS sq FROM (SELECT trip_key, {_x('o_lon')} AS px, {_y('o_lat')} AS py FROM trips) CROSS JOIN pxy)) WHERE rank <= 3"),
    "trip_detail": _t(f"SELECT o_cell||'_'||d_cell AS name, t.trip_key, {_clock('start_sec')} AS start, {_clock('end_sec')} AS \"end\", w.category AS origin_poi, round(m, 2) AS mean_speed, coalesce(levels, '') AS levels FROM trips t JOIN brushed ON o_cell = src AND d_cell = dst LEFT JOIN (SELECT trip_key, avg(speed) AS m, string_agg(CAST(level AS VARCHAR), ',' ORDER BY seq) AS levels FROM lev GROUP BY 1) s ON s.trip_key = t.trip_key LEFT JOIN (SELECT trip_key, category FROM (SELECT *, row_number() OVER (PARTITION BY trip_key ORDER BY c DESC, category) AS r FROM (SELECT trip_key, category, count(*) AS c FROM (SELECT trip_key, {_x('o_lon')} AS px, {_y('o_lat')} AS py FROM trips) JOIN pxy ON x BETWEEN px-300 AND px+300 AND y BETWEEN py-300 AND py+300 WHERE (px-x)*(px-x)+(py-y)*(py-y) <= 90000 GROUP BY ALL)) WHERE r = 1) w ON w.trip_key = t.trip_key WHERE od_in_region"),
    "cell_histogram": _t("SELECT * FROM counts"),
    "hot_vocab": _t("SELECT * FROM vocab"),
    "vocab_knn": _t("SELECT cell, neighbour, rank, square FROM (SELECT a.cell, b.cell AS neighbour, (a.cell%10-b.cell%10)*(a.cell%10-b.cell%10)+(a.cell//10-b.cell//10)*(a.cell//10-b.cell//10) AS square, row_number() OVER (PARTITION BY a.cell ORDER BY (a.cell%10-b.cell%10)*(a.cell%10-b.cell%10)+(a.cell//10-b.cell//10)*(a.cell//10-b.cell//10), b.cell) AS rank FROM vocab a JOIN vocab b ON a.cell <> b.cell) WHERE rank <= 5"),
    "cell_to_vocab": _t("SELECT cell, id FROM (SELECT a.cell, b.id, row_number() OVER (PARTITION BY a.cell ORDER BY (a.cell%10-b.cell%10)*(a.cell%10-b.cell%10)+(a.cell//10-b.cell//10)*(a.cell//10-b.cell//10), b.cell) AS rank FROM counts a CROSS JOIN vocab b) WHERE rank = 1"),
    "trip_tokens": _t("SELECT trip_key, string_agg(CAST(coalesce(id, 3) AS VARCHAR), ',' ORDER BY seq) AS tokens FROM p LEFT JOIN vocab ON vocab.cell = p.cell AND inside GROUP BY 1"),
    "dedup_tokens": _t("SELECT trip_key, string_agg(CAST(tok AS VARCHAR), ',' ORDER BY seq) AS tokens FROM (SELECT trip_key, seq, tok, lag(tok) OVER (PARTITION BY trip_key ORDER BY seq) AS before FROM (SELECT trip_key, seq, CASE WHEN inside THEN cell + 4 ELSE 3 END AS tok FROM p)) WHERE before IS NULL OR before <> tok GROUP BY 1"),
    "token_padding": _t("SELECT trip_key, string_agg(CAST(CASE WHEN inside THEN cell + 4 ELSE 3 END AS VARCHAR), ',' ORDER BY seq) || repeat(',0', (SELECT max(n) FROM p) - max(n)) AS tokens, CAST(max(n) AS BIGINT) AS length FROM p GROUP BY 1"),
    "split_80_10_10": _t("SELECT trip_key, CASE WHEN r <= m*8//10 THEN 'train' WHEN r <= m*8//10 + m//10 THEN 'valid' ELSE 'test' END AS part FROM (SELECT trip_key, row_number() OVER (PARTITION BY month, day ORDER BY user_id) AS r, count(*) OVER (PARTITION BY month, day) AS m FROM trips)"),
    "noise_variants": _t("SELECT trip_key, CAST(variant AS INT) AS variant, CAST(seq AS BIGINT) AS seq, seq = 0 OR seq = n - 1 OR (h*31+11) % 101 < 60 AS kept, CAST((h*37+11) % 61 - 30 AS INT) AS dx, CAST((h*41+11) % 61 - 30 AS INT) AS dy, CAST(((sec + (h*43+11) % 1801 - 900) % 86400 + 86400) % 86400 AS INT) AS sec FROM (SELECT p.*, v.range AS variant, user_id*7919 + day*104729 + seq*1299709::BIGINT + v.range*15485863 AS h FROM p CROSS JOIN range(4) v)"),
    "jaccard_edges": _t("SELECT a, b, round(1 - (SELECT count(*) FROM knn x JOIN knn y ON x.q = y.q WHERE x.p = a AND y.p = b)::DOUBLE/(SELECT count(DISTINCT q) FROM knn WHERE p = a OR p = b), 6) AS distance FROM (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM knn)"),
    "shared_neighbors": _t("SELECT k.p AS a, k.q AS b, count(*) AS shared FROM knn k JOIN knn m ON m.p = k.q AND m.q = k.p JOIN knn x ON x.p = k.p JOIN knn y ON y.p = k.q AND y.q = x.q WHERE k.p < k.q GROUP BY ALL"),
    "adjacency_normalized": _t("SELECT i, j, round(w, 8) AS w FROM nrm"),
    "feature_propagation": _t("SELECT a.i, k, round(sum(a.w*b.w*((b.j*37 + k*11) % 19)), 6) AS x FROM nrm a JOIN nrm b ON a.j = b.i CROSS JOIN (SELECT unnest([0,1,2]) AS k) GROUP BY ALL"),
    "contingency": "SELECT label AS \"true\", (embedding[1] > 0)::INT AS pred, count(*) AS n FROM embeddings GROUP BY ALL",
    "inertia": _t("SELECT round(sum(s), 3) AS inertia FROM (SELECT vec_id, min(s) AS s FROM (SELECT f.vec_id, c.label, sum((f.x-c.x)*(f.x-c.x)) AS s FROM feat f JOIN (SELECT label, k, avg(x) AS x FROM feat GROUP BY ALL) c ON c.k = f.k GROUP BY ALL) GROUP BY 1)"),
    "davies_bouldin": _t("SELECT round(avg(w), 5) AS davies_bouldin FROM (SELECT a.label, max((a.s+b.s)/d) AS w FROM (SELECT label, avg(s) AS s FROM (SELECT f.vec_id, f.label, sqrt(sum((f.x-c.x)*(f.x-c.x))) AS s FROM feat f JOIN (SELECT label, k, avg(x) AS x FROM feat GROUP BY ALL) c ON c.k = f.k AND c.label = f.label GROUP BY ALL) GROUP BY 1) a JOIN (SELECT label, avg(s) AS s FROM (SELECT f.vec_id, f.label, sqrt(sum((f.x-c.x)*(f.x-c.x))) AS s FROM feat f JOIN (SELECT label, k, avg(x) AS x FROM feat GROUP BY ALL) c ON c.k = f.k AND c.label = f.label GROUP BY ALL) GROUP BY 1) b ON a.label <> b.label JOIN (SELECT x.label AS l1, y.label AS l2, sqrt(sum((x.x-y.x)*(x.x-y.x))) AS d FROM (SELECT label, k, avg(x) AS x FROM feat GROUP BY ALL) x JOIN (SELECT label, k, avg(x) AS x FROM feat GROUP BY ALL) y ON x.k = y.k GROUP BY ALL) ON l1 = a.label AND l2 = b.label GROUP BY 1)"),
    "run_summary": "SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events",
    "metric_log": "SELECT 'acc' AS metric, CAST('0.'||event_id AS DOUBLE) AS value, 0.5::DOUBLE AS std FROM events WHERE event_type = 'click' UNION ALL SELECT 'nmi', CAST('1.'||user_id AS DOUBLE), NULL FROM events WHERE event_type = 'click'",
    "event_slices": "SELECT CAST(epoch(time_bucket(INTERVAL '15 minutes', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}


from wayloom.plans.extended_sql import MORE  # noqa: E402 - builds on the parts above

ORACLES |= MORE
