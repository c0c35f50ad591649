"""Views of the given tables shaped like manifests, scores and sequences."""

from corpuslens.plans.catalog import fixture

# Scores with heavy ties: 11 distinct values, a third of the rows on a few.
fixture(
    "scored_ties",
    """
    SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING)
             || ':' || CAST(l_suppkey AS STRING) AS id,
           l_linestatus AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount AS score
    FROM {lineitem}
    """,
)
# Nearly continuous scores with a probability and a logit.
fixture(
    "scored",
    """
    SELECT event_id AS id, user_id AS grp, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, value AS score,
           value / 600e0 AS p, (value - 100e0) / 50e0 AS logit, 'd' || CAST(user_id % 4 AS STRING) AS dataset
    FROM {events}
    """,
)
fixture(
    "split_scored",
    """
    SELECT *, CASE WHEN substr(md5('s:' || CAST(id AS STRING)), 1, 1) <= '9' THEN 'train'
                   WHEN substr(md5('s:' || CAST(id AS STRING)), 1, 1) <= 'c' THEN 'val' ELSE 'test' END AS split
    FROM {scored}
    """,
)
fixture(
    "quality_scored",
    """
    SELECT d.doc_id, l.quality AS y, d.n_chars AS score, d.source, d.lang, l.toxic, d.text
    FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
    """,
)
fixture(
    "modality",
    """
    SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING)
             || ':' || CAST(l_suppkey AS STRING) AS id,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS video_label,
           CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS audio_label,
           CASE WHEN l_discount >= 0.05e0 THEN 1 ELSE 0 END AS video_pred,
           CASE WHEN l_tax >= 0.04e0 THEN 1 ELSE 0 END AS audio_pred,
           l_discount * 10e0 AS video_score, l_tax * 10e0 AS audio_score, (l_discount + l_tax) * 5e0 AS fusion_score,
           CASE WHEN l_quantity <= 40e0 THEN 1 ELSE 0 END AS has_audio,
           CASE WHEN l_quantity = 50e0 THEN 'Unknown' ELSE
             (CASE WHEN l_returnflag = 'R' THEN 'FakeVideo' ELSE 'RealVideo' END) || '-' ||
             (CASE WHEN l_linestatus = 'F' THEN 'FakeAudio' ELSE 'RealAudio' END) END AS category
    FROM {lineitem}
    """,
)
fixture(
    "doc_paths",
    """
    SELECT doc_id, lang, n_chars,
           '/in/' || (CASE doc_id % 5 WHEN 0 THEN 'RealVideo-RealAudio' WHEN 1 THEN 'RealVideo-FakeAudio'
                      WHEN 2 THEN 'FakeVideo-RealAudio' WHEN 3 THEN 'FakeVideo-FakeAudio' ELSE 'misc' END)
             || '/' || lang || '/' || source || '/id' || lpad(CAST(doc_id % 200 AS STRING), 5, '0')
             || '/id' || lpad(CAST(doc_id % 200 AS STRING), 5, '0')
             || (CASE WHEN doc_id % 7 = 0 THEN '_id' || lpad(CAST((doc_id * 13) % 200 AS STRING), 5, '0') ELSE '' END)
             || (CASE WHEN doc_id % 9 = 0 THEN '_real' ELSE '' END)
             || '_' || CAST(doc_id AS STRING) || '.mp4' AS path
    FROM {documents}
    """,
)
# Host and path numbers of a page: most pages fall into one giant component.
fixture(
    "page_names",
    """
    SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
           regexp_extract_all(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '([0-9]+)', 1) AS numbers
    FROM {pages}
    """,
)
# One corpus copy per root: canonical, flat, and canonical at the wrong level.
fixture(
    "layouts",
    """
    SELECT root, root || (CASE
             WHEN root = '/r1' OR doc_id % 7 = 0 THEN '/' || (CASE WHEN family = 'source' THEN 'original' ELSE family END)
             WHEN family = 'source' THEN '/x/original_sequences/youtube/' || level || '/videos'
             ELSE '/x/manipulated_sequences/' || family || '/' || level || '/videos' END)
           || '/' || CAST(doc_id % 1000 AS STRING) || '.mp4' AS path
    FROM (SELECT doc_id, '/r' || CAST(doc_id % 3 AS STRING) AS root,
                 CASE WHEN doc_id % 3 = 2 OR doc_id % 2 = 1 THEN 'c40' ELSE 'c23' END AS level,
                 CASE doc_id % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'Deepfakes' WHEN 2 THEN 'Face2Face'
                                 WHEN 3 THEN 'FaceSwap' ELSE 'NeuralTextures' END AS family
          FROM {documents}) AS d
    """,
)
# Target and source ids of pairs, from keys of the order lines.
fixture(
    "pairs",
    """
    SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING)
             || ':' || CAST(l_suppkey AS STRING) AS key,
           l_partkey AS target_id, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS source_id,
           CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS label,
           'g' || CAST(l_suppkey AS STRING) AS identity_group,
           CASE WHEN l_quantity <= 40e0 THEN 1 ELSE 0 END AS has_audio
    FROM {lineitem}
    """,
)
fixture(
    "frames",
    """
    SELECT CAST(floor(vec_id / 20e0) AS BIGINT) AS clip, CAST(vec_id % 20 AS INT) AS frame_idx,
           CAST(vec_id % 20 AS DOUBLE) / 25e0 AS ts, label NOT IN (0, 1) AS valid, embedding, label, vec_id
    FROM {embeddings}
    """,
)
# Every clip whole, then cut short, then without a valid frame.
fixture(
    "frames_more",
    """
    SELECT 3 * clip AS clip, frame_idx, ts, valid, embedding FROM {frames}
    UNION ALL SELECT 3 * clip + 1, frame_idx, ts, valid, embedding FROM {frames} WHERE frame_idx <= clip % 11
    UNION ALL SELECT 3 * clip + 2, frame_idx, ts, false, embedding FROM {frames}
    """,
)
# Windows of 0.32 s over clips of 25 frames a second; the last ones run out of frames.
fixture(
    "cuts",
    """
    SELECT clip, win, win * 16e-2 - 8e-2 AS t0, win * 16e-2 + 24e-2 AS t1
    FROM (SELECT DISTINCT clip, CAST(frame_idx % 6 AS INT) AS win FROM {frames_more}) AS c
    """,
)
fixture(
    "boxes",
    """
    SELECT clip, frame_idx, valid AS detected,
           CASE WHEN valid THEN CAST((vec_id * 37) % 500 AS DOUBLE) + 0.5e0 END AS x1,
           CASE WHEN valid THEN CAST((vec_id * 53) % 300 AS DOUBLE) END AS y1,
           CASE WHEN valid THEN CAST((vec_id * 37) % 500 + 3 + (vec_id * 11) % 150 AS DOUBLE) + 0.5e0 END AS x2,
           CASE WHEN valid THEN CAST((vec_id * 53) % 300 + 3 + (vec_id * 7) % 120 AS DOUBLE) END AS y2,
           640 AS w, 360 AS h
    FROM {frames}
    """,
)
fixture(
    "mc_base",
    """
    SELECT event_id AS clip, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS v_label,
           CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS a_label,
           CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS has_audio, value
    FROM {events}
    """,
)
fixture(
    "train_log",
    """
    SELECT run, epoch, CASE WHEN epoch >= 3 THEN 1 ELSE 0 END AS phase,
           CAST((epoch + 1) * 600 + run * 100 AS DOUBLE) AS elapsed_s, round(avg(value), 6) AS metric
    FROM (SELECT user_id % 50 AS run, CAST(dayofmonth(ts) - 1 AS INT) AS epoch, value FROM {events}) AS e
    GROUP BY run, epoch
    """,
)
# Events with an exact microsecond clock.
fixture(
    "event_us",
    "SELECT event_id, user_id, event_type, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM {events}",
    """
    SELECT event_id, user_id, event_type, value,
           (datediff(CAST(ts AS DATE), DATE '2024-01-01') * 86400L + hour(ts) * 3600 + minute(ts) * 60) * 1000000
             + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT) AS us
    FROM {events}
    """,
)
fixture(
    "series",
    """
    SELECT e.user_id AS clip, e.event_id, e.event_type AS band, e.value, CAST(e.us - f.first_us AS DOUBLE) / 1e6 AS t
    FROM {event_us} e JOIN (SELECT user_id, min(us) AS first_us FROM {event_us} GROUP BY user_id) f ON f.user_id = e.user_id
    """,
)
fixture(
    "spans",
    """
    SELECT w.clip, w.win, w.win * 21600e0 AS t0, (w.win + 1) * 21600e0 AS t1, 1810e0 AS pad, d.dur
    FROM (SELECT DISTINCT clip, CAST(floor(t / 21600e0) AS BIGINT) AS win FROM {series}) w
    JOIN (SELECT clip, max(t) AS dur FROM {series} GROUP BY clip) d ON d.clip = w.clip
    """,
)
