"""DuckDB SQL with the same rows as the queries of the catalogue."""

from __future__ import annotations

PIXELS = """
px AS (
  SELECT frame_id, stream_id, p, p // 8 AS y, p % 8 AS x, (e + 1) / 2 AS v, floor((e + 1) * 127.5)::INT AS u8
  FROM (SELECT vec_id AS frame_id, label::BIGINT AS stream_id, unnest(range(len(embedding))) AS p, unnest(embedding)::DOUBLE AS e FROM embeddings)
)"""
STATS = """
stats AS (SELECT frame_id, count(*) AS n_pixels, avg(v) AS m, var_pop(v) AS va FROM px {where} GROUP BY frame_id)"""
ADAPTIVE = """
SELECT frame_id, round(0.7 * (0.18 - m), 6) AS ae_gain, round(m / m, 6) AS awb_r, round(m, 6) AS awb_g, round(m / m, 6) AS awb_b,
       round(least(greatest(1 / 2.2 + 0.35 * (0.18 - m), 0.25), 1.2), 6) AS gamma,
       round(least(greatest(10 * va, 0), 3), 6) AS noise, round(1 / (1 + 0.6 * least(greatest(10 * va, 0), 3)), 6) AS sharp
FROM stats"""
MEASURED = """
me AS (
  SELECT stream_id, frame_id, avg(v) AS mean_y, avg(v) FILTER (y % 2 = 0 AND x % 2 = 0) AS r,
         avg(v) FILTER (y % 2 <> x % 2) AS g, avg(v) FILTER (y % 2 = 1 AND x % 2 = 1) AS b, max(v) - min(v) AS af_score
  FROM px GROUP BY stream_id, frame_id
)"""
RAW = """
raw AS (
  SELECT user_id AS stream_id, event_id, value, event_type = 'error' AS sc, 1 + (props->>'k')::INT % 16 AS gain,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events
)"""
ITEMS = """
i0 AS (
  SELECT event_id, user_id, (props->>'k')::INT AS k, date_diff('day', DATE '2024-01-01', ts::DATE) // 7 AS batch,
         CASE WHEN event_type <> 'error' THEN user_id * 1000 + date_diff('day', DATE '2024-01-01', ts::DATE) // 7 * 20 + (props->>'k')::INT % 16 END AS token
  FROM events
), it AS (
  SELECT event_id AS packet_id, user_id AS worker, batch, (CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END) AS publish, token, k,
         CASE WHEN token % 23 = 0 THEN 1 WHEN token IS NOT NULL THEN 0 END AS owner, CASE WHEN token % 7 = 0 THEN 1 WHEN token IS NOT NULL THEN 0 END AS hw
  FROM i0
), fw AS (
  SELECT *, token IS NULL OR (owner = 0 AND row_number() OVER (PARTITION BY worker, batch, token ORDER BY packet_id) = 1) AS claimed,
         sum(publish) OVER (PARTITION BY worker, batch, token ORDER BY packet_id ROWS UNBOUNDED PRECEDING) AS published
  FROM it
), ro AS (
  SELECT *, CASE WHEN ff THEN 'FF' WHEN publish = 0 THEN 'EPOCH' WHEN token IS NOT NULL AND (owner <> 0 OR published > 1) THEN 'FAIL'
                 WHEN token IS NULL THEN 'FIFO' WHEN hw = 1 THEN 'RECLAIM' ELSE 'CTRL' END AS outcome
  FROM (SELECT *, bool_and(claimed) OVER (PARTITION BY worker, batch) AS ff FROM fw)
)"""
CONTROL = """
co AS (
  SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'RETURN_TO_POOL' WHEN 'click' THEN 'RELEASE_FRAME' ELSE 'OTHER' END AS control_type,
         user_id AS frame_id, event_id & 4294967295 AS slot_index, 1 + (props->>'k')::BIGINT % 4 AS epoch, user_id * 100 + (props->>'k')::BIGINT AS idempotency_key
  FROM events
), fifo AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) AS free_seq, slot_index, epoch FROM co WHERE control_type <> 'OTHER'
)"""

DONE = "done AS (SELECT o_orderkey AS order_id, o_custkey AS frame_id, TIMESTAMP '2024-01-01' + to_days((o_orderkey % 31)::INT) AS ts FROM orders)"


def fold(targets: str, first: str, alpha: str, low: float, high: float, step: float | None, cells: bool) -> str:
    """A recursive CTE over the rows of each stream; ``targets`` selects (pos, raw) per row as t, ``first`` is the initial state by pos."""
    ema = f"({alpha}) * t.raw + (1 - ({alpha})) * s.value"
    if step is not None:
        ema = f"({ema} + s.value + least(greatest(t.raw - s.value, -{step}), {step})) / 2"
    return f"""
WITH RECURSIVE {RAW}, ta AS ({targets}), fo AS (
  SELECT stream_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, pos, ({first})::DOUBLE AS value FROM (SELECT DISTINCT stream_id, pos FROM ta)
  UNION ALL
  SELECT t.stream_id, t.n, t.event_id, t.pos, least(greatest({ema}, {low}), {high})
  FROM fo s JOIN ta t ON t.stream_id = s.stream_id AND t.pos = s.pos AND t.n = s.n + 1
)
SELECT stream_id, event_id, {"pos::INT AS pos, " if cells else ""}floor(value * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS value FROM fo WHERE n > 0"""


ALPHA = "CASE WHEN t.sc THEN greatest(0.2::DOUBLE, 0.5::DOUBLE) ELSE 0.2::DOUBLE END"
PASSED = ", ".join(f"(frame_id * 31 + {i})::DOUBLE AS {n}" for i, n in enumerate(["gamma", "noise", "sharp", *[f"ccm_{i}" for i in range(9)], *[f"lens_{i}" for i in range(4)], *[f"color_{i}" for i in range(3)]]))
LEAST_GAIN = "least(greatest(gain::DOUBLE, 1), 16)"
SHARPNESS = fold(f"SELECT *, 0 AS pos, value / 100 / {LEAST_GAIN} AS raw FROM raw", "1", ALPHA, 0.0, 1.0, 0.05, False)
MEAN_WB = "((1 + value / 1000) + 1 + (1 + value / 2000)) / 3"

ORACLES = {
    "frame_luma_stats": f"WITH {PIXELS}, {STATS.format(where='')} SELECT frame_id, n_pixels, round(m, 6) AS mean, round(va, 6) AS var FROM stats",
    "coeffs_from_bayer": f"WITH {PIXELS}, {STATS.format(where='')} {ADAPTIVE}",
    "coeffs_constant_model": f"WITH {PIXELS}, {STATS.format(where='')} SELECT frame_id, round(0.5 * (0.5 - m), 6) AS ae_gain, 1.0::DOUBLE AS awb_r, 1.0::DOUBLE AS awb_g, 1.0::DOUBLE AS awb_b, round(1 / 2.2::DOUBLE, 6) AS gamma, 1.0::DOUBLE AS noise, 1.0::DOUBLE AS sharp FROM stats",
    "coeffs_crop": f"WITH {PIXELS}, {STATS.format(where='WHERE y >= 1 AND y < 7 AND x >= 1 AND x < 7')} {ADAPTIVE}",
    "coeff_static_outputs": """
SELECT vec_id AS frame_id, name, pos::INT AS pos, value::DOUBLE AS value FROM embeddings CROSS JOIN (
  SELECT 'ccm' AS name, i AS pos, CASE WHEN i % 4 = 0 THEN 1 ELSE 0 END AS value FROM range(9) r(i)
  UNION ALL SELECT 'lens', i, 0 FROM range(4) r(i)
  UNION ALL SELECT 'color', i, CASE WHEN i < 2 THEN 1 ELSE 0 END FROM range(3) r(i))""",
    "coeff_routing": f"WITH {PIXELS}, {STATS.format(where='')} SELECT frame_id, sharp, noise, gamma FROM ({ADAPTIVE})",
    "controller_step": f"WITH {PIXELS}, {MEASURED} SELECT frame_id, round(1 + 0.5 * (0.5 - mean_y), 6) AS ae_gain, round((r + g + b) / 3 / r, 6) AS awb_r, round((r + g + b) / 3 / g, 6) AS awb_g, round((r + g + b) / 3 / b, 6) AS awb_b, round(af_score, 6) AS af_score, {PASSED} FROM me",
    "output_lookup": "SELECT event_id, wanted, greatest(coalesce(list_position(['ccm', 'lens', 'color', 'gamma'], wanted), 0) - 1, 0)::BIGINT AS place FROM (SELECT event_id, ['gamma', 'wb_gains', 'ccm', 'color', 'lens'][event_id % 5 + 1] AS wanted FROM events)",
    "controller_feedback": f"WITH {PIXELS}, {MEASURED} SELECT stream_id, frame_id, round(1 + sum(0.5 * (0.5 - mean_y)) OVER (PARTITION BY stream_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING), 6) AS ae_gain FROM me",
    "rule_wb_normalise": f"SELECT event_id, round((1 + value / 1000) / ({MEAN_WB}), 6) AS wb_r, round(1 / ({MEAN_WB}), 6) AS wb_g, round((1 + value / 2000) / ({MEAN_WB}), 6) AS wb_b FROM events",
    "rule_sharpness_fold": SHARPNESS,
    "rule_nr_fold": fold(f"SELECT *, 0 AS pos, value / 100 * {LEAST_GAIN} AS raw FROM raw", "0.5", ALPHA, 0.0, 5.0, None, False),
    "rule_wb_fold": fold(f"SELECT *, (CASE pos WHEN 0 THEN 1 + value / 1000 WHEN 1 THEN 1 ELSE 1 + value / 2000 END) / ({MEAN_WB}) AS raw FROM raw, range(3) r(pos)", "1", ALPHA, 0.5, 2.0, 0.05, True),
    "rule_ccm_fold": fold("SELECT *, CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END + value * (pos + 1) / 1777 AS raw FROM raw, range(9) r(pos)", "CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END", ALPHA, -2.0, 2.0, None, True),
    "rule_gamma_fold": f"""
WITH RECURSIVE {RAW}, fo AS (
  SELECT DISTINCT stream_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, list_transform(range(256), lambda i: 0::DOUBLE) AS s FROM raw
  UNION ALL
  SELECT t.stream_id, t.n, t.event_id, list_transform(range(256), lambda i: least(greatest(({ALPHA}) * (i / 255.0::DOUBLE * t.value / 100) + (1 - ({ALPHA})) * fo.s[i + 1], 0), 1))
  FROM fo JOIN raw t ON t.stream_id = fo.stream_id AND t.n = fo.n + 1
)
SELECT stream_id, event_id, array_to_string(list_transform(s, lambda x: floor(x * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT), ',') AS entries FROM fo WHERE n > 0""",
    "demosaic_replicate": f"WITH {PIXELS} SELECT frame_id, (3 * p + k)::INT AS idx, u8 AS value FROM px, range(3) r(k)",
    "denoise_box3": f"WITH {PIXELS} SELECT a.frame_id, a.y::INT AS y, a.x::INT AS x, (sum(b.u8) // count(*))::BIGINT AS value FROM px a JOIN px b ON a.frame_id = b.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.frame_id, a.y, a.x",
    "pixel_quantise": f"WITH {PIXELS} SELECT frame_id, p::INT AS p, round(u8 / 255.0::DOUBLE, 6) AS unit, least(greatest(round_even(v * 255, 0), 0), 255)::BIGINT AS back, round(u8 / 1023.0::DOUBLE, 6) AS raw_unit FROM px",
    "bayer_check": f"""
WITH {PIXELS} SELECT frame_id, min(u8)::BIGINT AS low, max(u8)::BIGINT AS high, round(avg(u8), 6) AS mean,
  max(u8) FILTER (y = 0 AND x = 0)::BIGINT AS b00, max(u8) FILTER (y = 0 AND x = 1)::BIGINT AS b01, max(u8) FILTER (y = 1 AND x = 0)::BIGINT AS b10, max(u8) FILTER (y = 1 AND x = 1)::BIGINT AS b11,
  CASE frame_id % 5 WHEN 0 THEN 'RED' WHEN 1 THEN 'BLUE' WHEN 2 THEN 'GREEN_RED_NEXT' WHEN 3 THEN 'GREEN_BLUE_NEXT' ELSE 'ERROR' END AS first_colour
FROM px GROUP BY frame_id""",
    "yuyv_to_rgb": f"""
WITH {PIXELS}, quads AS (SELECT frame_id, p // 4 AS quad, max(u8) FILTER (p % 4 = 0)::DOUBLE AS y0, max(u8) FILTER (p % 4 = 1)::DOUBLE AS u, max(u8) FILTER (p % 4 = 2)::DOUBLE AS y1, max(u8) FILTER (p % 4 = 3)::DOUBLE AS v FROM px GROUP BY 1, 2),
two AS (SELECT frame_id, quad, k, 1.164383::DOUBLE * ((CASE k WHEN 0 THEN y0 ELSE y1 END) - 16) AS c, u - 128 AS d, v - 128 AS e FROM quads, range(2) r(k))
SELECT frame_id, quad::BIGINT AS quad, k::INT AS k, least(greatest(round_even(c + 1.596027::DOUBLE * e, 0), 0), 255)::BIGINT AS r,
  least(greatest(round_even(c - 0.391762::DOUBLE * d - 0.812968::DOUBLE * e, 0), 0), 255)::BIGINT AS g, least(greatest(round_even(c + 2.017232::DOUBLE * d, 0), 0), 255)::BIGINT AS b FROM two""",
    "last_frame_sink": "SELECT frame_id, p::INT AS p, round(e::DOUBLE, 6) AS value FROM (SELECT vec_id AS frame_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS e FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings))",
    "handoff_route": f"WITH {ITEMS} SELECT worker, batch, count(*) AS n_items, (CASE WHEN bool_and(ff) THEN 3 ELSE 2 END)::INT AS reason FROM ro GROUP BY worker, batch",
    "monitor_route": f"WITH {ITEMS} SELECT packet_id, worker, batch, outcome, (CASE WHEN token IS NULL THEN NULL WHEN outcome = 'FF' THEN 2 WHEN bool_or(outcome IN ('RECLAIM', 'CTRL')) OVER (PARTITION BY worker, batch, token) THEN 1 ELSE owner END)::INT AS owner_after FROM ro",
    "handoff_control_items": f"WITH {ITEMS} SELECT (1 + k % 3)::INT AS control_type, worker AS origin_worker_id, packet_id, (1 + k % 4)::INT AS packet_epoch, k AS diagnostics_idx, worker AS frame_id, packet_id AS alloc_ticket, worker * 100 + k AS idempotency_key, batch, (CASE outcome WHEN 'FF' THEN 3 ELSE 2 END)::INT AS reason FROM ro WHERE outcome IN ('FF', 'CTRL')",
    "demo_items": "SELECT 1::INT AS control_type, 1::INT AS origin_worker_id, 1000 + i AS packet_id, 1::INT AS packet_epoch, 0::INT AS diagnostics_idx, CASE WHEN i % 2 = 0 THEN 200 + i END AS frame_id, i AS alloc_ticket, i AS idempotency_key, 1::INT AS batch, 3::INT AS reason FROM range(5) r(i)",
    "synthetic_frame_grid": "SELECT i AS frame_id, 20736::BIGINT AS n, 108::INT AS height, 192::INT AS width, TRUE AS in_range FROM range(5) r(i)",
    "fifo_preload": "SELECT i AS slot_index, 1::BIGINT AS epoch, i + 1 AS free_seq FROM range(64) r(i)",
    "slot_last_sequence": f"WITH {CONTROL} SELECT coalesce(max(free_seq), 0)::BIGINT AS last_seq FROM fifo",
    "slot_ledger": f"""
WITH {CONTROL}, {DONE}, every AS (
  SELECT ts, 0 AS source, event_id AS id, slot_index, epoch FROM co WHERE control_type <> 'OTHER'
  UNION ALL SELECT done.ts, 1, order_id, arg_max(slot_index, (co.ts, event_id)), arg_max(epoch, (co.ts, event_id)) FROM done JOIN co ON co.frame_id = done.frame_id AND co.ts <= done.ts AND control_type = 'RELEASE_FRAME' GROUP BY order_id, done.ts
  UNION ALL SELECT ts, 2, event_id, event_id, 1 FROM events WHERE event_type = 'view'
)
SELECT row_number() OVER (ORDER BY ts, source, id) AS free_seq, source, slot_index, epoch FROM every""",
    "event_counts": f"WITH {ITEMS} SELECT CASE outcome WHEN 'FF' THEN 'HANDOFF_FAST_FORWARDED' WHEN 'EPOCH' THEN 'PACKET_EPOCH_MISMATCH' WHEN 'FAIL' THEN 'TOKEN_TRANSFER_FAIL' WHEN 'FIFO' THEN 'PACKET_RETURNED_TO_FIFO' WHEN 'RECLAIM' THEN 'FRAME_RECLAIM_TRIGGERED' ELSE 'PROCESSITEM_CONVERTED_TO_CONTROL' END AS event, count(*) AS n FROM ro GROUP BY 1",
    "slot_fifo": f"WITH {CONTROL} SELECT free_seq, slot_index, epoch FROM fifo",
    "slot_pop_batch": f"WITH {CONTROL} SELECT free_seq, slot_index, epoch FROM fifo WHERE free_seq <= 32",
    "slot_allocate": f"WITH {CONTROL}, req AS (SELECT o_orderkey AS request_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS nth FROM orders) SELECT request_id, nth, slot_index FROM req LEFT JOIN fifo ON nth = free_seq",
    "frame_table_upsert": f"WITH {CONTROL} SELECT frame_id, event_id AS alloc_ticket, FALSE AS hw_in_use, slot_index, epoch, event_id AS updated_event FROM co WHERE control_type = 'RELEASE_FRAME' QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY ts DESC, event_id DESC) = 1",
    "hw_done_return": f"""
WITH {CONTROL}, {DONE}
SELECT order_id, done.frame_id, arg_max(slot_index, (co.ts, event_id)) AS slot_index, arg_max(epoch, (co.ts, event_id)) AS epoch, FALSE AS hw_in_use FROM done JOIN co ON co.frame_id = done.frame_id AND co.ts <= done.ts AND control_type = 'RELEASE_FRAME' GROUP BY order_id, done.frame_id""",
    "seq_match_timeout": "SELECT o_orderkey AS seq, strftime(min(l_shipdate), '%Y-%m-%d') AS first_match FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 90 DAY GROUP BY o_orderkey",
    "idempotent_control": f"WITH {CONTROL} SELECT idempotency_key, arg_min(event_id, (ts, event_id)) AS event_id FROM co GROUP BY idempotency_key",
    "queue_depth": "SELECT event_id, sum(CASE WHEN event_type IN ('purchase', 'click') THEN 1 WHEN event_type = 'view' THEN -1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM events",
    "inference_stub": f"WITH {ITEMS} SELECT packet_id, worker, ((row_number() OVER (PARTITION BY worker ORDER BY packet_id) - 1) // 8)::BIGINT AS batch_no, 0.0::DOUBLE AS output, TRUE AS success, ((1 + k % 16) * CASE WHEN k % 2 = 0 THEN 4 ELSE 1 END)::BIGINT AS bytes FROM it",
    "stream_rule_fold": SHARPNESS,
    "stream_dedupe": f"WITH {CONTROL} SELECT DISTINCT idempotency_key FROM co",
}
