"""The fixture views in SQL, to be put before the SQL of a query."""

from __future__ import annotations

PARTICLES = """particles0 AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
    l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS Area,
    greatest(l_quantity, CAST(p_size AS DOUBLE)) AS Major, least(l_quantity, CAST(p_size AS DOUBLE)) AS Minor,
    l_extendedprice * (1 + l_tax) AS ConvexArea, 1 - 5 * l_discount AS Circularity, 0.2::DOUBLE + 10 * l_tax AS Extent,
    p_retailprice AS Perimeter, 128 + s_acctbal / 100 AS MeanIntensity,
    (l_quantity - p_size) * (l_quantity - p_size) / 10 AS Gray_var, (l_quantity - p_size) / 50 AS Gray_skew,
    abs((l_quantity - p_size) / 50) AS Gray_skew_abs,
    CASE WHEN l_partkey % 97 <> 0 THEN o_totalprice / 100000 - 3 END AS Gray_kur,
    CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) AS dis,
    CAST(CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 3 WHEN l_linestatus = 'F' THEN 1 ELSE 4 END AS INTEGER) AS type,
    ['3mM-1', '3mM-4', '6mM-4', '6mM-10', '6mM-12'][CAST(n_regionkey AS INTEGER) + 1] AS experiment,
    CASE WHEN l_linenumber <= 5 THEN 'train' WHEN l_linenumber = 6 THEN 'test' ELSE 'val' END AS split
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), particles AS (
  SELECT *, sqrt(1 - (Minor / Major) * (Minor / Major)) + CASE WHEN l_partkey % 50 = 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS Eccentricity,
    Major / Minor AS Major_Minor_ratio, (abs(dis) + 1) / 1000 AS dis_normal, MeanIntensity / 255 AS normalized_local_mean_gray,
    concat(experiment, '_', split) AS source_file
  FROM particles0
)"""

PREDICTIONS = (
    PARTICLES
    + """, predictions0 AS (
  SELECT row_id, type, experiment, split, source_file, l_partkey, l_suppkey,
    CAST(CASE WHEN l_partkey % 5 <> 0 THEN type ELSE 1 + l_suppkey % 4 END AS INTEGER) AS enhanced,
    CAST(CASE WHEN l_partkey % 3 <> 0 THEN type ELSE 1 + l_suppkey % 4 END AS INTEGER) AS original,
    0.3::DOUBLE + 0.7::DOUBLE * ((31 * l_partkey + 17 * l_suppkey) % 1000) / 1000 AS confidence,
    CAST(CASE WHEN l_partkey % 37 = 0 THEN -1 ELSE l_suppkey % 6 END AS INTEGER) AS cluster
  FROM particles
), predictions AS (
  SELECT *, CASE WHEN enhanced = 1 THEN confidence ELSE (1 - confidence) / 3 END AS prob_class_1,
    CASE WHEN enhanced = 2 THEN confidence ELSE (1 - confidence) / 3 END AS prob_class_2,
    CASE WHEN enhanced = 3 THEN confidence ELSE (1 - confidence) / 3 END AS prob_class_3,
    CASE WHEN enhanced = 4 THEN confidence ELSE (1 - confidence) / 3 END AS prob_class_4
  FROM predictions0
)"""
)

PIXELS = """pixels AS (
  SELECT frame_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
    CAST(floor(least(255::DOUBLE, greatest(0::DOUBLE, 128::DOUBLE + 240::DOUBLE * CAST(e AS DOUBLE)))) AS INTEGER) AS v
  FROM (SELECT vec_id AS frame_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
), filtered AS (SELECT frame_id, y, x, CAST((v // 8) * 8 AS INTEGER) AS v FROM pixels)"""

FRAMES = """frames0 AS (
  SELECT vec_id AS frame_id, vec_id // 45 AS k,
    TIMESTAMP '2025-06-28 00:00:00' + to_minutes(CAST(vec_id * 7 AS INTEGER)) + to_milliseconds(vec_id % 1000) AS ts
  FROM embeddings
), frames1 AS (
  SELECT frame_id, concat(CASE WHEN k % 2 = 1 THEN '2`5+100mM' ELSE '3mM' END, '-0628-', k, '-mix') AS folder, ts FROM frames0
), frames AS (
  SELECT frame_id, folder, concat(folder, '_', strftime(ts, '%Y%m%d%H%M%S%g'), '_', frame_id % 45, '_AfterFPN.bmp') AS filename, ts FROM frames1
)"""

BOXES = """boxes AS (
  SELECT vec_id AS frame_id, concat('[', 1 + vec_id % 5, ', ', 1 + vec_id % 4, ', ', 1 + vec_id % 4, ', ', 1 + vec_id % 3, ']') AS BoundingBox FROM embeddings
)"""

FILES = """files AS (
  SELECT doc_id, concat(source, '/', doc_id, ['.bmp', '.tiff', '_nlm_filtered.tiff', '._x.h5'][CAST(doc_id % 4 AS INTEGER) + 1]) AS path,
    n_chars AS length, doc_id AS mtime
  FROM documents
)"""

SERIES = """series AS (SELECT user_id AS folder, event_id AS frame_id, ts, value FROM events)"""


def with_views(sql: str, *views: str) -> str:
    """``sql`` after its views; a leading WITH of ``sql`` is continued."""
    body = sql.strip()
    return "WITH " + ",\n".join(views) + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
