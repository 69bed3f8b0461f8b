"""The registered queries once more, in DuckDB SQL."""

from __future__ import annotations

EPS, MIN_SAMPLES, EPS_M = 0.001, 5, 100.0

PTS = """
h AS (SELECT event_id, user_id, ts,
  CAST((event_id*7919+13)%10007 AS DOUBLE)/CAST(10007 AS DOUBLE) a, CAST((event_id*104729+7)%9973 AS DOUBLE)/CAST(9973 AS DOUBLE) b,
  CAST((event_id*1299709+3)%10009 AS DOUBLE)/CAST(10009 AS DOUBLE) c, CAST((event_id*15485863+11)%9967 AS DOUBLE)/CAST(9967 AS DOUBLE) d,
  (event_id*31)%10 g FROM events),
pts AS (SELECT event_id AS pt_id, user_id AS taxi_id, ts,
  CASE WHEN g<3 THEN 39.9::DOUBLE WHEN g<6 THEN 40.0::DOUBLE WHEN g<9 THEN 39.8::DOUBLE ELSE 39.7::DOUBLE END
  + CASE WHEN g<9 THEN (a+b-1::DOUBLE)*0.02::DOUBLE ELSE a*0.4::DOUBLE END AS lat,
  CASE WHEN g<3 THEN 116.3::DOUBLE WHEN g<6 THEN 116.5::DOUBLE WHEN g<9 THEN 116.4::DOUBLE ELSE 116.2::DOUBLE END
  + CASE WHEN g<9 THEN (c+d-1::DOUBLE)*0.02::DOUBLE ELSE c*0.5::DOUBLE END AS lon FROM h)
"""
DIRTY = PTS + """,
soiled AS (SELECT pt_id, taxi_id, ts, CASE WHEN pt_id%97=0 THEN NULL ELSE lat END AS lat, lon FROM pts),
dirty AS (SELECT * FROM soiled UNION ALL SELECT * FROM soiled WHERE pt_id%50=0)
"""
INSIDE = "lat BETWEEN 39.75 AND 40.05 AND lon BETWEEN 116.25 AND 116.55"


def hav(a: str, b: str, c: str, d: str) -> str:
    s = f"(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))"
    return f"(2*6371000.0::DOUBLE*atan2(sqrt({s}),sqrt(greatest(1::DOUBLE-{s},0))))"


def features(src: str, name: str = "feat") -> str:
    return f"""
{name}0 AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY taxi_id) AS cnt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
  (epoch_us(ts)-epoch_us(lag(ts) OVER w))/1e6::DOUBLE AS dt0 FROM {src} WINDOW w AS (PARTITION BY taxi_id ORDER BY ts, pt_id)),
{name}1 AS (SELECT *, {hav("plat", "plon", "lat", "lon")} AS distance_from_prev, CASE WHEN dt0<=0 THEN 1::DOUBLE ELSE dt0 END AS time_from_prev,
  fmod(degrees(atan2(sin(radians(lon-plon))*cos(radians(lat)), cos(radians(plat))*sin(radians(lat))-sin(radians(plat))*cos(radians(lat))*cos(radians(lon-plon))))+360, 360) AS bearing FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN rn=1 AND cnt>1 THEN 0::DOUBLE ELSE distance_from_prev/time_from_prev END AS speed, distance_from_prev/time_from_prev*3.6 AS speed_kmh,
  CASE WHEN rn=1 AND cnt>1 THEN 0::DOUBLE ELSE bearing END AS direction FROM {name}1),
{name} AS (SELECT *, CASE WHEN rn<=2 AND cnt>1 THEN 0::DOUBLE ELSE (speed-lag(speed) OVER (PARTITION BY taxi_id ORDER BY ts, pt_id))/time_from_prev END AS acceleration FROM {name}2)
"""


POINTS = f"WITH {PTS} SELECT pt_id, taxi_id, ts, round(lat,6) AS lat, round(lon,6) AS lon FROM pts"
CLEAN_POINTS = f"WITH {DIRTY} SELECT pt_id, taxi_id, ts, round(lat,6) AS lat, round(lon,6) AS lon FROM dirty WHERE {INSIDE} AND ts IS NOT NULL AND year(ts) BETWEEN 2000 AND 2030"
CLEAN_DEDUP = f"WITH {DIRTY} SELECT DISTINCT pt_id, taxi_id, ts, round(lat,6) AS lat, round(lon,6) AS lon FROM dirty WHERE {INSIDE} AND ts IS NOT NULL"
TRAJECTORY_RUNS = """
WITH l AS (SELECT user_id, event_type, event_id, ts, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run_id FROM l)
SELECT user_id, run_id, event_type AS taxi_id, count(*) AS n_points FROM r GROUP BY ALL
"""
FEAT = f"WITH {PTS}, {features('pts')}"
MOVEMENT_FEATURES = f"{FEAT} SELECT pt_id, taxi_id, CAST(rn AS INT) AS rn, round(distance_from_prev,3) AS distance_from_prev, round(time_from_prev,3) AS time_from_prev, round(speed,3) AS speed, round(speed_kmh,3) AS speed_kmh, round(direction,3) AS direction, round(acceleration,3)+0 AS acceleration FROM feat"
OUTLIER_FILTER = f"{FEAT} SELECT pt_id, taxi_id, round(speed_kmh,3) AS speed_kmh FROM feat WHERE cnt<3 OR rn=1 OR NOT (speed_kmh>60 OR abs(acceleration)>5)"
SEG = f"""WITH {PTS},
cut AS (SELECT *, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER w) > 360*60000000::BIGINT THEN 1 ELSE 0 END AS c FROM pts WINDOW w AS (PARTITION BY taxi_id ORDER BY ts, pt_id)),
run AS (SELECT *, sum(c) OVER (PARTITION BY taxi_id ORDER BY ts, pt_id ROWS UNBOUNDED PRECEDING) AS s FROM cut),
many AS (SELECT *, count(*) OVER (PARTITION BY taxi_id, s) AS n FROM run),
seg AS (SELECT pt_id, taxi_id, ts, lat, lon, taxi_id || '_segment_' || (dense_rank() OVER (PARTITION BY taxi_id ORDER BY s)-1) AS segment_id FROM many WHERE n>1)
"""
SEGMENTS = f"{SEG} SELECT pt_id, taxi_id, segment_id FROM seg"
SEGMENT_STATS = f"""{SEG}, d AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM seg WINDOW w AS (PARTITION BY segment_id ORDER BY ts, pt_id))
SELECT taxi_id, segment_id, count(*) AS n_points, round(sum({hav("plat", "plon", "lat", "lon")}),3) AS length_m, min(ts) AS start_time, max(ts) AS end_time,
  round((epoch_us(max(ts))-epoch_us(min(ts)))/1e6::DOUBLE,3) AS duration_s FROM d GROUP BY taxi_id, segment_id"""
STATS = f"""{FEAT},
s0 AS (SELECT taxi_id, count(*) AS n_points, min(ts) AS start_time, max(ts) AS end_time, coalesce(sum(distance_from_prev),0) AS m, coalesce(avg(speed) FILTER (rn>1),0) AS av, coalesce(max(speed) FILTER (rn>1),0) AS mx,
  (epoch_us(max(ts))-epoch_us(min(ts)))/1e6::DOUBLE AS secs FROM feat GROUP BY taxi_id),
stats AS (SELECT taxi_id, n_points, start_time, end_time, m/1000 AS total_distance_km, secs/3600 AS duration_hours, av*3.6 AS avg_speed_kmh, mx*3.6 AS max_speed_kmh,
  CASE WHEN m>0 THEN n_points/(m/1000) ELSE 0 END AS point_density_per_km, CASE WHEN secs>0 THEN n_points/(secs/3600) ELSE 0 END AS sampling_rate_per_hour FROM s0)
"""
TRAJECTORY_STATS = f"{STATS} SELECT taxi_id, n_points, start_time, end_time, round(total_distance_km,3) AS total_distance_km, round(duration_hours,4) AS duration_hours, round(avg_speed_kmh,3) AS avg_speed_kmh, round(max_speed_kmh,3) AS max_speed_kmh, round(point_density_per_km,3) AS point_density_per_km, round(sampling_rate_per_hour,3) AS sampling_rate_per_hour FROM stats"
TRAJECTORY_VALIDITY = f"{STATS} SELECT taxi_id, n_points, n_points>=60 AND total_distance_km>=500 AS is_valid FROM stats"
SAMPLING_RATE = f"{STATS} SELECT taxi_id, round(sampling_rate_per_hour,6) AS sampling_rate_per_hour FROM stats"
BBOX_CENTROID = f"WITH {PTS} SELECT taxi_id, round(min(lat),6) AS min_lat, round(max(lat),6) AS max_lat, round(min(lon),6) AS min_lon, round(max(lon),6) AS max_lon, round(avg(lat),6) AS centroid_lat, round(avg(lon),6) AS centroid_lon FROM pts GROUP BY taxi_id"


def resampled(src: str, cols: list[str], step: int, name: str = "grid") -> str:
    """Nearest point to each tick, ties to the earlier: as-of joins either way."""
    keep = ", ".join(cols)
    prev = ", ".join(f"b.{c} AS b_{c}, f.{c} AS f_{c}" for c in cols)
    pick = ", ".join(f"CASE WHEN f_us IS NULL OR us-b_us<=f_us-us THEN b_{c} ELSE f_{c} END AS {c}" for c in cols)
    return f"""
{name}_one AS (SELECT taxi_id, ts, epoch_us(ts) AS us, {keep} FROM (SELECT *, row_number() OVER (PARTITION BY taxi_id, ts ORDER BY pt_id) AS first_ FROM {src}) WHERE first_=1),
{name}_ends AS (SELECT taxi_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi, count(*) AS n FROM {src} GROUP BY taxi_id),
{name}_tick AS (SELECT taxi_id, unnest(range(lo, hi+1, {step * 1000000})) AS us FROM {name}_ends WHERE n>1),
{name}_both AS (SELECT t.taxi_id, t.us, b.us AS b_us, f.us AS f_us, {prev} FROM {name}_tick t
  ASOF LEFT JOIN {name}_one b ON t.taxi_id=b.taxi_id AND t.us>=b.us ASOF LEFT JOIN {name}_one f ON t.taxi_id=f.taxi_id AND t.us<=f.us),
{name} AS (SELECT taxi_id, make_timestamp(us) AS ts, {pick} FROM {name}_both UNION ALL SELECT s.taxi_id, s.ts, {", ".join("s." + c for c in cols)} FROM {src} s JOIN {name}_ends e USING (taxi_id) WHERE e.n<=1)
"""


RESAMPLE = f"WITH {PTS}, {resampled('pts', ['lat', 'lon'], 3600)} SELECT taxi_id, ts, round(lat,6) AS lat, round(lon,6) AS lon FROM grid"
PIPELINE = f"""WITH {PTS},
ok AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY taxi_id) AS n0 FROM pts WHERE lat BETWEEN 39.4 AND 40.6 AND lon BETWEEN 115.7 AND 117.4 AND year(ts) BETWEEN 2000 AND 2030) WHERE n0>=5), {features('ok')},
slow AS (SELECT * FROM feat WHERE cnt<3 OR rn=1 OR NOT (speed_kmh>60 OR abs(acceleration)>5)),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY taxi_id) AS n1 FROM slow) WHERE n1>=5), {resampled('kept', ['lat', 'lon', 'speed'], 3600)}
SELECT taxi_id, ts, round(lat,6) AS lat, round(lon,6) AS lon, round(speed,3) AS speed FROM (SELECT *, count(*) OVER (PARTITION BY taxi_id) AS n2 FROM grid) WHERE n2>=5"""
HAVERSINE_PAIRS = f"WITH {PTS}, l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pts WINDOW w AS (PARTITION BY taxi_id ORDER BY ts, pt_id)) SELECT pt_id, round({hav('plat', 'plon', 'lat', 'lon')},3) AS distance_m FROM l"
DISTANCE_MATRIX = f"""WITH p AS (SELECT n_nationkey::BIGINT AS id, 39.5::DOUBLE+n_nationkey::DOUBLE*0.03::DOUBLE AS lat, 116.0::DOUBLE+fmod(n_nationkey::DOUBLE*7,25)*0.04::DOUBLE AS lon FROM nation)
SELECT a.id AS i, b.id AS j, round(CASE WHEN a.id=b.id THEN 0 ELSE {hav("a.lat", "a.lon", "b.lat", "b.lon")} END,3) AS dist FROM p a, p b"""
NEAR = "sqrt((a.lat-b.lat)*(a.lat-b.lat)+(a.lon-b.lon)*(a.lon-b.lon))"
REGION_QUERY = f"WITH {PTS} SELECT pt_id, round(sqrt((39.9::DOUBLE-lat)*(39.9::DOUBLE-lat)+(116.3::DOUBLE-lon)*(116.3::DOUBLE-lon)),6) AS dist FROM pts WHERE sqrt((39.9::DOUBLE-lat)*(39.9::DOUBLE-lat)+(116.3::DOUBLE-lon)*(116.3::DOUBLE-lon)) <= 0.01"


def edges(eps: float, name: str = "edges", expr: str = NEAR, cell: str | None = None) -> str:
    size = cell or f"{eps * 1.01!r}::DOUBLE"
    return f"""
{name}_c AS (SELECT pt_id, lat, lon, floor(lat/{size})::BIGINT AS cx, floor(lon/({size}*1.35))::BIGINT AS cy FROM pts),
{name}_d AS (SELECT pt_id, lat, lon, cx+dx AS cx, cy+dy AS cy FROM {name}_c, (SELECT unnest([-1,0,1]) AS dx), (SELECT unnest([-1,0,1]) AS dy)),
{name} AS (SELECT a.pt_id AS i, b.pt_id AS j, {expr} AS dist FROM {name}_d a JOIN {name}_c b ON a.cx=b.cx AND a.cy=b.cy WHERE a.pt_id<>b.pt_id AND {expr} <= {eps!r})
"""


def labelled(e: str = "edges", least: int = MIN_SAMPLES, name: str = "lab") -> str:
    """Labels from an edge table, by least-label propagation."""
    return f"""
{name}_core AS MATERIALIZED (SELECT i AS p FROM {e} GROUP BY i HAVING count(*)>={least}),
{name}_ce AS MATERIALIZED (SELECT i, j FROM {e} WHERE i IN (SELECT p FROM {name}_core) AND j IN (SELECT p FROM {name}_core)),
{name}_cc(i, l) USING KEY (i) AS (SELECT p, p FROM {name}_core UNION SELECT x.i, min(c.l) FROM {name}_ce x JOIN {name}_cc c ON c.i=x.j JOIN recurring.{name}_cc r ON r.i=x.i GROUP BY x.i, r.l HAVING min(c.l)<r.l),
{name}_num AS (SELECT i AS pt_id, dense_rank() OVER (ORDER BY l) AS k FROM {name}_cc),
{name}_bor AS (SELECT x.i AS pt_id, min(n.k) AS k, min(n.k) FILTER (n.k>1) AS k2 FROM {e} x JOIN {name}_num n ON n.pt_id=x.j GROUP BY x.i),
{name} AS (SELECT p.pt_id, p.taxi_id, p.lat, p.lon, n.k IS NOT NULL AS is_core, CAST(coalesce(n.k, b.k, 0) AS INT) AS cluster_id, n.k AS own, b.k2 FROM pts p LEFT JOIN {name}_num n USING (pt_id) LEFT JOIN {name}_bor b USING (pt_id))
"""


LAB = f"WITH RECURSIVE {PTS}, {edges(EPS)}, {labelled()}"
EPS_NEIGHBORS = f"WITH {PTS}, {edges(EPS)} SELECT i, j, round(dist,6) AS dist FROM edges"
NEIGHBOR_COUNTS = f"WITH {PTS}, {edges(EPS)} SELECT pt_id, count(j) AS n_neighbors FROM pts LEFT JOIN edges ON i=pt_id GROUP BY pt_id"
CORE_POINTS = f"WITH {PTS}, {edges(EPS)} SELECT pt_id, count(j)>={MIN_SAMPLES} AS is_core FROM pts LEFT JOIN edges ON i=pt_id GROUP BY pt_id"
LABELS = f"{LAB} SELECT pt_id, is_core, cluster_id FROM lab"
LABELS_HAVERSINE = f"WITH RECURSIVE {PTS}, {edges(EPS_M, expr=hav('a.lat', 'a.lon', 'b.lat', 'b.lon'), cell='0.00092::DOUBLE')}, {labelled()} SELECT pt_id, is_core, cluster_id FROM lab"
LEGACY = f"{LAB} SELECT pt_id, CAST(CASE WHEN is_core THEN own-1 ELSE coalesce(k2-1, 0) END AS INT) AS label FROM lab"
CLUSTER_STATS = f"{LAB} SELECT count(DISTINCT cluster_id) FILTER (cluster_id>0) AS n_clusters, count(*) FILTER (cluster_id=0) AS n_noise, count(*) FILTER (is_core) AS n_core_points, count(*) AS n_points FROM lab"
CLUSTER_SIZES = f"{LAB} SELECT cluster_id, count(*) AS size FROM lab WHERE cluster_id>0 GROUP BY cluster_id"
TOP_CLUSTERS = CLUSTER_SIZES + " ORDER BY cluster_id LIMIT 10"
CENTROIDS = f"{LAB} SELECT cluster_id, round(avg(lat),6) AS lat, round(avg(lon),6) AS lon, count(*) AS size FROM lab WHERE cluster_id>0 GROUP BY cluster_id"
SHAPES = f"""{LAB}, c AS (SELECT cluster_id, count(*) AS size, avg(lat) AS la, avg(lon) AS lo, max(lat)-min(lat) AS dla, max(lon)-min(lon) AS dlo FROM lab WHERE cluster_id>0 GROUP BY cluster_id HAVING count(*)>=2),
r AS (SELECT cluster_id, max(sqrt((lat-la)*(lat-la)+(lon-lo)*(lon-lo))) AS radius FROM lab JOIN c USING (cluster_id) GROUP BY cluster_id)
SELECT cluster_id, size, round(size/(dla+1e-10::DOUBLE)/(dlo+1e-10::DOUBLE),0) AS density, round(radius,6) AS radius, round(size/(radius+1e-10::DOUBLE),0) AS compactness FROM c JOIN r USING (cluster_id)"""
MAJORITY = f"{LAB}, n AS (SELECT taxi_id, cluster_id AS label, count(*) AS n FROM lab GROUP BY ALL) SELECT taxi_id, label, n FROM n QUALIFY row_number() OVER (PARTITION BY taxi_id ORDER BY n DESC, label)=1"
GRID_MEMBERS = f"""WITH {PTS}, e AS (SELECT min(lat) AS x0, max(lat) AS x1, min(lon) AS y0, max(lon) AS y1 FROM pts), s AS (SELECT *, (x1-x0)/3 AS sx, (y1-y0)/3 AS sy FROM e),
m AS (SELECT pt_id, lat, lon, i*3+j AS cell, NOT (lat>=x0+i*sx AND (CASE WHEN i=2 THEN lat<=x0+(i+1)*sx ELSE lat<x0+(i+1)*sx END) AND lon>=y0+j*sy AND (CASE WHEN j=2 THEN lon<=y0+(j+1)*sy ELSE lon<y0+(j+1)*sy END)) AS is_halo
  FROM pts, s, (SELECT unnest([0,1,2]) AS i), (SELECT unnest([0,1,2]) AS j)
  WHERE lat BETWEEN (x0+i*sx)-sx*0.1::DOUBLE AND (x0+(i+1)*sx)+sx*0.1::DOUBLE AND lon BETWEEN (y0+j*sy)-sy*0.1::DOUBLE AND (y0+(j+1)*sy)+sy*0.1::DOUBLE),
g AS (SELECT CAST(dense_rank() OVER (ORDER BY cell)-1 AS INT) AS partition_id, pt_id, lat, lon, is_halo FROM m)
"""
GRID = f"{GRID_MEMBERS} SELECT partition_id, pt_id, is_halo FROM g"
GRID_INFO = f"{GRID_MEMBERS}, n AS (SELECT count(*) AS n FROM g GROUP BY partition_id) SELECT count(*) AS n_partitions, sum(n)::BIGINT AS total_points, min(n) AS min_size, max(n) AS max_size, round(avg(n),4) AS avg_size, round(stddev_pop(n),4) AS std_size FROM n"
PARTITION_SUMMARY = f"{GRID_MEMBERS} SELECT partition_id, count(*) AS n_points, round(min(lat),6) AS min_x, round(max(lat),6) AS max_x, round(min(lon),6) AS min_y, round(max(lon),6) AS max_y, round(avg(lat),6) AS centroid_x, round(avg(lon),6) AS centroid_y FROM g GROUP BY partition_id"
HASH_MEMBERS = f"""WITH {PTS}, e AS (SELECT min(lat) AS x0, min(lon) AS y0 FROM pts), k AS (SELECT pt_id, floor((lat-x0)/0.1::DOUBLE) AS kx, floor((lon-y0)/0.1::DOUBLE) AS ky FROM pts, e),
f AS (SELECT kx, ky, min(pt_id) AS p, count(*) AS n FROM k GROUP BY kx, ky), ids AS (SELECT kx, ky, n, CAST(row_number() OVER (ORDER BY p)-1 AS INT) AS partition_id FROM f)
"""
HASH = f"{HASH_MEMBERS} SELECT partition_id, pt_id FROM k JOIN ids USING (kx, ky)"
SCHEDULED = f"{HASH_MEMBERS}, t AS (SELECT partition_id, n AS n_points, n*0.001::DOUBLE*2 AS est FROM ids), s AS (SELECT *, row_number() OVER (ORDER BY est DESC, partition_id)-1 AS pos FROM t)"
SCHEDULE = f"{SCHEDULED} SELECT partition_id, n_points, round(est,6) AS estimate_s, CAST(pos AS INT) AS position, CAST(pos%4 AS INT) AS worker FROM s"
IMBALANCE = f"{SCHEDULED}, l AS (SELECT pos%4 AS w, sum(est) AS l FROM s GROUP BY 1) SELECT count(*) AS n_workers, round(min(l),6) AS min_load, round(max(l),6) AS max_load, round(avg(l),6) AS avg_load, round((max(l)-min(l))/avg(l),6) AS imbalance, (max(l)-min(l))/avg(l)>0.3 AS rebalance FROM l"
TWO = "ab AS (SELECT event_id AS pt_id, user_id%7 AS l1, CASE WHEN event_id%3=0 THEN user_id%7 ELSE (user_id*3+event_id%2)%9 END AS l2 FROM events)"
CONTINGENCY = f"WITH {TWO} SELECT CAST(l1 AS INT) AS l1, CAST(l2 AS INT) AS l2, count(*) AS n FROM ab GROUP BY ALL"
MERGE = f"""WITH {TWO}, t AS (SELECT l1, l2, count(*) AS n FROM ab WHERE l2<>0 GROUP BY ALL), z AS (SELECT l2, sum(n) AS size FROM t GROUP BY l2),
b AS (SELECT * FROM t WHERE l1>0 QUALIFY row_number() OVER (PARTITION BY l2 ORDER BY n DESC, l1)=1),
r AS (SELECT z.l2, b.l1 AS target, coalesce(b.n/z.size>=0.3,false) AS adopt FROM z LEFT JOIN b USING (l2)),
m AS (SELECT l2, CASE WHEN adopt THEN target ELSE (SELECT max(l1) FROM ab)+sum(CASE WHEN adopt THEN 0 ELSE 1 END) OVER (ORDER BY l2 ROWS UNBOUNDED PRECEDING) END AS dest FROM r)
SELECT pt_id, CAST(coalesce(dest, l1) AS INT) AS label FROM ab LEFT JOIN m USING (l2)"""
ARI = """WITH ab AS (SELECT label AS l1, CASE WHEN embedding[1]>0 THEN 1 ELSE 0 END*2+CASE WHEN embedding[2]>0 THEN 1 ELSE 0 END+1 AS l2 FROM embeddings), c AS (SELECT l1, l2, count(*)::DOUBLE AS n FROM ab GROUP BY ALL),
x AS (SELECT sum(n*(n-1)/2) AS s, sum(n) AS n, coalesce(sum(n) FILTER (l1=l2),0) AS same FROM c), a AS (SELECT sum(n*(n-1)/2) AS s1 FROM (SELECT sum(n) AS n FROM c GROUP BY l1)), b AS (SELECT sum(n*(n-1)/2) AS s2 FROM (SELECT sum(n) AS n FROM c GROUP BY l2)),
y AS (SELECT *, s1*s2/(n*(n-1)/2) AS e, (s1+s2)/2 AS m FROM x, a, b)
SELECT n::BIGINT AS n_points, round((s-e)/(m-e),9) AS adjusted_rand, round(same/n,9) AS match_rate FROM y"""
_PAIRS = [(EPS / 2, 5), (EPS / 2, 10), (EPS, 5), (EPS, 10)]
GRID_SEARCH = (
    f"WITH RECURSIVE {PTS}, {edges(EPS)}, "
    + ", ".join(f"e{k} AS (SELECT i, j FROM edges WHERE dist<={e!r}), {labelled(f'e{k}', m, f'g{k}')}" for k, (e, m) in enumerate(_PAIRS))
    + " UNION ALL ".join(f"SELECT {e!r}::DOUBLE AS eps, {m} AS min_samples, count(DISTINCT cluster_id) FILTER (cluster_id>0) AS n_clusters, count(*) FILTER (cluster_id=0) AS n_noise, count(*) FILTER (is_core) AS n_core_points FROM g{k}" for k, (e, m) in enumerate(_PAIRS))
)
MISSING = f"WITH {DIRTY} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*)-count({c}) AS n_missing, round((count(*)-count({c}))/count(*)*100,2) AS pct_missing FROM dirty" for c in ("pt_id", "taxi_id", "ts", "lat", "lon"))
DUPLICATES = f"WITH {DIRTY} SELECT (SELECT count(*) FROM dirty)-(SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS n_duplicates"
DISTINCT = f"WITH {DIRTY} SELECT count(DISTINCT taxi_id) AS n_taxi_id, count(DISTINCT ts) AS n_ts, count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon FROM dirty"
DESCRIBE = f"WITH {DIRTY} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}),6) AS mean, round(stddev_samp({c}),6) AS std, round(min({c}),6) AS min, round(quantile_cont({c},0.25),6) AS q25, round(quantile_cont({c},0.5),6) AS q50, round(quantile_cont({c},0.75),6) AS q75, round(max({c}),6) AS max FROM dirty" for c in ("lat", "lon"))


def counts_by(part: str) -> str:
    e = {"hour": "hour(ts)", "weekday": "isodow(ts)-1", "day": "day(ts)", "month": "month(ts)"}[part]
    return f"SELECT CAST({e} AS INT) AS {part}, count(*) AS n FROM events GROUP BY 1"


ACTIVITY = f"WITH {PTS} SELECT taxi_id, count(*) AS n_points, min(ts) AS first_seen, max(ts) AS last_seen, round(avg(lat),4) AS mean_lat, round(stddev_samp(lat),4) AS std_lat, round(avg(lon),4) AS mean_lon, round(stddev_samp(lon),4) AS std_lon FROM pts GROUP BY taxi_id"
ACT = "a AS (SELECT user_id AS taxi_id, count(*) AS n_points FROM events GROUP BY user_id)"
HISTOGRAM = f"""WITH {ACT}, e AS (SELECT min(n_points)::DOUBLE AS lo, (max(n_points)-min(n_points))::DOUBLE/30 AS w FROM a), k AS (SELECT least(floor((n_points-lo)/w),29) AS bin, count(*) AS n FROM a, e GROUP BY 1)
SELECT CAST(b AS INT) AS bin, round(lo+b*w,6) AS low, round(lo+(b+1)*w,6) AS high, coalesce(n,0) AS n FROM (SELECT unnest(range(30)) AS b) CROSS JOIN e LEFT JOIN k ON k.bin=b"""
SHARES = f"WITH {ACT}, r AS (SELECT taxi_id, n_points, row_number() OVER w AS rank, sum(n_points) OVER w AS run, sum(n_points) OVER () AS total FROM a WINDOW w AS (ORDER BY n_points DESC, taxi_id ROWS UNBOUNDED PRECEDING))"
PARETO_SHARE = f"{SHARES} SELECT taxi_id, n_points, CAST(rank AS INT) AS rank, round(run/total*100,6) AS cum_share FROM r"
PARETO = f"{SHARES} SELECT CAST(level AS INT) AS level, min(rank) AS n_taxis, round(min(rank)/(SELECT count(*) FROM a)*100,4) AS pct_taxis FROM r, (SELECT unnest([20,50,80]) AS level) WHERE run*100>=level*total GROUP BY level"
IN_BOUNDS = f"WITH {PTS} SELECT count(*) AS n_points, count(*) FILTER ({INSIDE}) AS n_inside, count(*) FILTER (NOT ({INSIDE})) AS n_outside, round(count(*) FILTER ({INSIDE})/count(*)*100,6) AS pct_inside FROM pts"
HEXBIN = f"""WITH {PTS}, s AS (SELECT (lon-116.0::DOUBLE)/(1.0::DOUBLE/50) AS x, (lat-39.5::DOUBLE)/(1.0::DOUBLE/28) AS y FROM pts),
d AS (SELECT *, pow(x-floor(x+0.5),2)+3*pow(y-floor(y+0.5),2) AS d1, pow(x-floor(x)-0.5,2)+3*pow(y-floor(y)-0.5,2) AS d2 FROM s),
k AS (SELECT CASE WHEN d1<d2 THEN floor(x+0.5) ELSE floor(x)+0.5 END AS kx, CASE WHEN d1<d2 THEN floor(y+0.5) ELSE floor(y)+0.5 END AS ky, CASE WHEN d1<d2 THEN 0 ELSE 1 END AS lattice FROM d)
SELECT round(116.0::DOUBLE+kx*(1.0::DOUBLE/50),6) AS cx, round(39.5::DOUBLE+ky*(1.0::DOUBLE/28),6) AS cy, lattice, count(*) AS n FROM k GROUP BY kx, ky, lattice"""
AREA = f"WITH {PTS} SELECT count(*) AS n_points, round((max(lat)-min(lat))*(max(lon)-min(lon)),6) AS area_deg2, round(count(*)/((max(lat)-min(lat))*(max(lon)-min(lon))),2) AS points_per_deg2 FROM pts"
SUMMARY = f"{STATS} SELECT (SELECT count(*) FROM pts) AS n_points, (SELECT count(DISTINCT taxi_id) FROM pts) AS n_taxis, (SELECT min(ts) FROM pts) AS first_ts, (SELECT max(ts) FROM pts) AS last_ts, round(avg(n_points),4) AS mean_points, round(avg(duration_hours),4) AS mean_hours, round(avg(total_distance_km),3) AS mean_km FROM stats"
CHUNKS = "SELECT event_id//1000 AS chunk, min(event_id) AS start, max(event_id)+1 AS stop, count(*) AS n_points FROM events GROUP BY 1"
RUNS = "runs AS (SELECT 'impl_' || r_regionkey AS implementation, CAST(pow(2,r_regionkey) AS INT) AS n_jobs, k AS k, 100*(k+1)*(k+1) AS n, 0.5::DOUBLE+0.2::DOUBLE*(k+1)*(k+1)+0.03::DOUBLE*k*k*k AS seconds, 12/(k+1)+1.5::DOUBLE AS execution_time, 50+10*k AS memory_usage_mb, 0.8::DOUBLE+0.04::DOUBLE*k AS accuracy FROM (SELECT r_regionkey, r_regionkey::DOUBLE AS k FROM region))"
COMPARISON = f"""WITH {RUNS}, c AS (SELECT implementation, execution_time, memory_usage_mb, accuracy, min(execution_time) OVER ()/execution_time AS rs, min(memory_usage_mb) OVER ()/greatest(memory_usage_mb,0.1) AS me, memory_usage_mb/greatest(max(memory_usage_mb) OVER (),0.1) AS us FROM runs)
SELECT implementation, round(execution_time,6) AS execution_time, memory_usage_mb, round(accuracy,6) AS accuracy, round(rs,6) AS relative_speed, round(me,6) AS memory_efficiency, round(0.5*rs+0.3/greatest(us,0.1)+0.2*accuracy,6) AS overall_score FROM c"""
SCALABILITY = f"""WITH {RUNS}, q AS (SELECT n, n*n AS n2, seconds AS y, n*log2(n+1) AS l FROM runs),
s AS (SELECT regr_r2(y,n) AS lin, regr_r2(y,l) AS nlog, var_pop(n) AS a, covar_pop(n,n2) AS b, var_pop(n2) AS c, covar_pop(n,y) AS d, covar_pop(n2,y) AS e, var_pop(y) AS t FROM q),
f AS (SELECT 'linear' AS model, lin AS r2, 0 AS k FROM s UNION ALL SELECT 'quadratic', ((c*d-b*e)*d+(a*e-b*d)*e)/(a*c-b*b)/t, 1 FROM s UNION ALL SELECT 'n_log_n', nlog, 2 FROM s)
SELECT model, round(r2,6) AS r2, row_number() OVER (ORDER BY r2 DESC, k)=1 AS best FROM f"""
SPEEDUP = f"""WITH {RUNS}, s AS (SELECT n_jobs, execution_time AS seconds, (SELECT min(execution_time) FROM runs WHERE n_jobs=1)/execution_time AS speedup FROM runs)
SELECT n_jobs, round(seconds,6) AS seconds, round(speedup,6) AS speedup, round(speedup/n_jobs,6) AS efficiency, round((SELECT greatest(0,least(1,sum((1-1/n_jobs::DOUBLE)*(1-1/speedup))/sum(pow(1-1/n_jobs::DOUBLE,2)))) FROM s),6) AS parallel_fraction FROM s"""
COMPLEXITY = f"WITH {RUNS}, e AS (SELECT n, ln(seconds/lag(seconds) OVER (ORDER BY n))/ln(n/lag(n) OVER (ORDER BY n)) AS x FROM runs) SELECT round(x,6) AS exponent, CASE WHEN x<1.2 THEN 'near linear' WHEN x<1.8 THEN 'n log n' ELSE 'near quadratic' END AS class FROM e ORDER BY n DESC LIMIT 1"
BOTTLENECKS = "WITH t AS (SELECT event_type AS function, sum(abs(value)) AS s, count(*) AS n FROM events GROUP BY 1), u AS (SELECT *, s/sum(s) OVER () AS share FROM t) SELECT function, round(s,3) AS seconds, n AS n_calls, round(share,6) AS share, CASE WHEN share>0.3 THEN 'high' WHEN share>0.2 THEN 'medium' ELSE 'low' END AS priority FROM u WHERE share>0.1"
MEMORY = """WITH m AS (SELECT CAST(datediff('day', DATE '1970-01-01', ts::DATE) AS BIGINT) AS seq, round(sum(value),3) AS mb FROM events GROUP BY ts::DATE, seq), d AS (SELECT *, coalesce(mb-lag(mb) OVER (ORDER BY seq),0) AS x FROM m)
SELECT seq, round(mb,3) AS mb, round(x,3) AS diff_mb, x > avg(x) OVER ()+2*stddev_samp(x) OVER () AS is_peak FROM d"""
TIMES = "SELECT event_id, CASE WHEN event_id%5 IN (0,1) THEN date_trunc('second', ts) WHEN event_id%5 IN (2,3) THEN date_trunc('minute', ts) END AS ts FROM events"
SAMPLE = "SELECT event_id AS pt_id FROM events ORDER BY (event_id*48271)%2147483647, event_id LIMIT 500"
_GRID_STATS = f"""{PIPELINE.rsplit("SELECT taxi_id, ts, round(lat,6)", 1)[0]},
long_ AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY taxi_id) AS n2 FROM grid) WHERE n2>=5),
hop AS (SELECT *, row_number() OVER w AS place, lag(lat) OVER w AS glat, lag(lon) OVER w AS glon FROM long_ WINDOW w AS (PARTITION BY taxi_id ORDER BY ts)),
s0 AS (SELECT taxi_id, count(*) AS n_points, min(ts) AS start_time, max(ts) AS end_time, coalesce(sum({hav("glat", "glon", "lat", "lon")}),0) AS m, coalesce(avg(speed) FILTER (place>1),0) AS av, coalesce(max(speed) FILTER (place>1),0) AS mx,
  (epoch_us(max(ts))-epoch_us(min(ts)))/1e6::DOUBLE AS secs FROM hop GROUP BY taxi_id)"""
PIPELINE_STATS = f"""{_GRID_STATS} SELECT taxi_id, n_points, start_time, end_time, round(m/1000,3) AS total_distance_km, round(secs/3600,4) AS duration_hours, round(av*3.6,3) AS avg_speed_kmh, round(mx*3.6,3) AS max_speed_kmh,
  round(CASE WHEN m>0 THEN n_points/(m/1000) ELSE 0 END,3) AS point_density_per_km, round(CASE WHEN secs>0 THEN n_points/(secs/3600) ELSE 0 END,3) AS sampling_rate_per_hour FROM s0"""
PARTITION_MERGE = f"""{HASH_MEMBERS.replace("WITH ", "WITH RECURSIVE ", 1)}, sized AS (SELECT partition_id, n, row_number() OVER (ORDER BY partition_id) AS k, sum(n) OVER ()/4 AS goal FROM ids),
fold(k, partition_id, merged, size) AS (SELECT k, partition_id, 0, n FROM sized WHERE k=1
  UNION ALL SELECT s.k, s.partition_id, CASE WHEN f.size>=s.goal*0.8::DOUBLE THEN f.merged+1 ELSE f.merged END, CASE WHEN f.size>=s.goal*0.8::DOUBLE THEN s.n ELSE f.size+s.n END FROM fold f JOIN sized s ON s.k=f.k+1)
SELECT CAST(partition_id AS INT) AS partition_id, CAST(merged AS INT) AS merged_id FROM fold"""
SPATIAL = f"WITH {PTS}, v AS (SELECT p.*, e.value FROM pts p JOIN events e ON e.event_id=p.pt_id) SELECT count(*) AS n_points, count(DISTINCT taxi_id) AS n_taxis, round(avg(lat),6) AS center_lat, round(avg(lon),6) AS center_lon, round(min(lat),6) AS min_lat, round(max(lat),6) AS max_lat, round(min(lon),6) AS min_lon, round(max(lon),6) AS max_lon, round(min(value),6) AS min_value, round(max(value),6) AS max_value FROM v"
QUALITY = f"""WITH {PTS}, v AS (SELECT p.*, e.value FROM pts p JOIN events e ON e.event_id=p.pt_id), k AS (SELECT count(*) AS n FROM v WHERE lat BETWEEN 39.4 AND 40.6 AND lon BETWEEN 115.7 AND 117.4 AND year(ts) BETWEEN 2000 AND 2030),
u AS (SELECT 'lat' AS name, lat AS x FROM v UNION ALL SELECT 'lon', lon FROM v UNION ALL SELECT 'value', value FROM v)
SELECT name AS "column", round(min(x),6) AS least, round(max(x),6) AS most, round(100*(count(*)-count(x))/count(*)::DOUBLE,4) AS missing_pct, (SELECT round(100*k.n/(SELECT count(*) FROM v)::DOUBLE,4) FROM k) AS retention_pct FROM u GROUP BY name"""
MEMORY_TREND = """WITH m AS (SELECT CAST(datediff('day', DATE '1970-01-01', ts::DATE) AS BIGINT) AS seq, round(sum(value),3) AS mb FROM events GROUP BY ts::DATE, seq)
SELECT count(*) AS n_snapshots, round(min(mb),3) AS least_mb, round(max(mb),3) AS most_mb, round(arg_max(mb,seq)-arg_min(mb,seq),3) AS growth_mb, round(CASE WHEN max(seq)>min(seq) THEN (arg_max(mb,seq)-arg_min(mb,seq))/(max(seq)-min(seq)) ELSE 0 END,6) AS growth_per_step FROM m"""
CALLS_TOP = "SELECT event_type AS function, round(sum(value),3) AS seconds, count(*) AS n_calls FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"
