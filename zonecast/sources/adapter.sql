WITH e AS (
 SELECT event_id, user_id, ts, value,
   substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(user_id % 32 AS INT) + 1, 1) AS c6,
   substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(floor(user_id / 32) AS INT) % 32 + 1, 1) AS c5,
   substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(floor(user_id / 1024) AS INT) % 32 + 1, 1) AS c4
 FROM events)
SELECT event_id AS row_id,
  CASE WHEN user_id % 50 = 7 THEN concat('dr5', c4, c5, c6)
       WHEN user_id % 50 = 23 THEN concat('qp0z', c5, c6)
       ELSE concat('qp0', c4, c5, c6) END AS geohash,
  CAST(dayofyear(ts) AS INT) AS day,
  concat(CAST(hour(ts) AS STRING), ':', CAST(minute(ts) AS STRING)) AS timestamp,
  CASE WHEN event_id % 19 = 0 THEN NULL
       ELSE substr('Residential Highway     Street      ', CAST(user_id % 3 AS INT) * 12 + 1, 12) END AS RoadType,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(user_id % 5 + 1 AS DOUBLE) END AS NumberofLanes,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'n/a'
       ELSE CAST(user_id % 5 + 1 AS STRING) END AS lanes_text,
  CASE WHEN event_id % 29 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'Allowed' ELSE 'Not Allowed' END AS LargeVehicles,
  CASE WHEN user_id % 3 = 0 THEN 'Yes' ELSE 'No' END AS Landmarks,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id * 37) % 451 AS DOUBLE) / 10.0 - 5.0 END AS Temperature,
  CASE WHEN event_id % 17 = 0 THEN NULL
       ELSE substr('Sunny Rainy Foggy Snowy CloudyHail  ', CAST(floor(event_id / 7) AS INT) % 6 * 6 + 1, 6) END AS Weather,
  least(value / 500.0, 1.0) AS demand,
  (dayofyear(ts) <= 24 AND user_id % 10 <> 9 AND user_id % 50 NOT IN (7, 23)
     AND NOT (CAST(floor(user_id / 32) AS INT) % 32 = 3)) AS is_train
FROM e
