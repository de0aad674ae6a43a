"""DuckDB SQL of the analytics queries."""

from __future__ import annotations

from tokenmill.functions.devices import DEVICES, FAMILIES, PRECISIONS
from tokenmill.plans.analytics_queries import FINAL, PEAK, STEPS, TARGET, TOTAL_BATCH, WARMUP

#: Lines as the queries make them, parsed; run is an expression over events.
LINES = """lines AS (SELECT {run} AS run, event_id AS line_no, CASE WHEN event_id % 3 != 0 THEN 'step ' || event_id || '/99999 | train loss ' || printf('%.2f', value) || ' | norm 1.0' ELSE 'val loss ' || printf('%.2f', value) END AS line FROM events),
parsed AS (SELECT run, line_no, nullif(regexp_extract(line, 'step\\s+(\\d+).*train loss\\s+([\\d.]+)', 1), '')::BIGINT AS step, nullif(regexp_extract(line, 'step\\s+(\\d+).*train loss\\s+([\\d.]+)', 2), '')::DOUBLE AS train_loss, nullif(regexp_extract(line, 'val loss\\s+([\\d.]+)', 1), '')::DOUBLE AS val_loss FROM lines)"""
BY_USER = "WITH " + LINES.format(run="user_id::VARCHAR")
ARMS = "WITH " + LINES.format(run="CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END")
CURVE = """, curve AS (SELECT run, line_no, "at" AS step, val_loss FROM (SELECT *, last_value(step IGNORE NULLS) OVER (PARTITION BY run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "at" FROM parsed) WHERE val_loss IS NOT NULL AND step IS NULL AND "at" IS NOT NULL)"""
RECORDS = """, o AS (SELECT *, count(step) OVER (PARTITION BY run ORDER BY line_no) AS ordinal FROM parsed),
r AS (SELECT run, ordinal, max(step) AS step, max(train_loss) AS train_loss, arg_min(val_loss, line_no) FILTER (WHERE step IS NULL) AS val_loss FROM o WHERE ordinal > 0 GROUP BY run, ordinal),
recs AS (SELECT * FROM r WHERE val_loss IS NOT NULL OR ordinal < (SELECT max(ordinal) FROM r q WHERE q.run = r.run))"""
REACHED = """, k AS (SELECT * FROM recs WHERE val_loss IS NOT NULL),
f AS (SELECT run, arg_min(step, ordinal) AS step, arg_min(val_loss, ordinal) AS val_loss FROM k WHERE val_loss <= {target} GROUP BY run),
b AS (SELECT run, step, val_loss FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC, ordinal) AS n FROM k) WHERE n = 1),
reached AS (SELECT b.run, coalesce(f.step, b.step) AS step, coalesce(f.val_loss, b.val_loss) AS val_loss, f.run IS NOT NULL AS hit FROM b LEFT JOIN f ON b.run = f.run)"""
DENSITY = "density(run, bpt) AS (VALUES ('even', 3.6::DOUBLE), ('odd', 2.5::DOUBLE))"
Z = """WITH w AS (SELECT event_id, event_type, value, row_number() OVER p AS n, avg(value) OVER f AS m, stddev_pop(value) OVER f AS s FROM events
WINDOW p AS (PARTITION BY event_type ORDER BY event_id), f AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)),
z AS (SELECT event_id, event_type, CASE WHEN n > 128 THEN CASE WHEN s = 0 THEN 0.0 ELSE (value - m) / s END END AS z FROM w)
"""
WORDS = "b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL)"
EXAMPLES = (
    WORDS
    + """,
ex AS (SELECT item_id AS example_id, (item_id % 4)::INT AS label, k AS choice, hex(encode(array_to_string(w[1:5], ' '))) AS ctx, hex(encode(' ' || array_to_string(w[6 + 3 * k : 8 + 3 * k + k % 2], ' '))) AS ending FROM (SELECT *, unnest(range(0, 4)) AS k FROM b)),
ln AS (SELECT *, len(ctx) // 2 AS cl, len(ending) // 2 AS el, max(len(ending) // 2) OVER (PARTITION BY example_id) AS most FROM ex)"""
)
PREDS = (
    "WITH "
    + EXAMPLES
    + """,
t AS (SELECT example_id, label, choice, cl, el, i, CASE WHEN i < cl + el THEN ('0x' || substr(ctx || ending, 2 * i + 1, 2))::INT ELSE 0 END AS x FROM (SELECT *, unnest(range(0, cl + most)) AS i FROM ln)),
l AS (SELECT example_id, label, choice, sum(((x * 31 + (i - 1) * 17 + choice * 7) % 97)::DOUBLE / 64) AS sum_loss, count(*) AS n FROM t WHERE i >= 1 AND i >= cl AND i < cl + el GROUP BY 1, 2, 3),
preds AS (SELECT example_id, label, arg_min(choice, (sum_loss, choice))::INT AS pred, arg_min(choice, (sum_loss / n, choice))::INT AS pred_norm FROM l GROUP BY 1, 2)
"""
)
V = "v AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT vec_id, label, (i - 1)::INT AS i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM v))"
PROBS = "WITH " + V + ", e AS (SELECT vec_id, i, exp(x * 8 - max(x * 8) OVER (PARTITION BY vec_id)) AS e FROM u), pr AS (SELECT vec_id, i, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS prob FROM e)"


def lr_sql() -> str:
    low, point = PEAK * FINAL, int(0.8 * STEPS)
    warm = f"WHEN step < {WARMUP} THEN {PEAK}::DOUBLE * (step + 1) / {WARMUP}"
    return f"""WITH s AS (SELECT DISTINCT event_id % {STEPS + 1} AS step FROM events)
SELECT 'cosine' AS name, step, round(CASE {warm} ELSE {low}::DOUBLE + 0.5 * (1 + cos((step - {WARMUP}) / {STEPS - WARMUP}.0::DOUBLE * pi())) * {PEAK - low}::DOUBLE END, 10) AS lr FROM s
UNION ALL SELECT 'linear', step, round(CASE {warm} ELSE {PEAK}::DOUBLE - (step - {WARMUP}) / {STEPS - WARMUP}.0::DOUBLE * {PEAK - low}::DOUBLE END, 10) FROM s
UNION ALL SELECT 'constant', step, round({PEAK}::DOUBLE, 10) FROM s
UNION ALL SELECT 'wsd', step, round(CASE {warm} WHEN step < {point} THEN {PEAK}::DOUBLE ELSE {low}::DOUBLE + (1 - sqrt((step - {point}) / {STEPS - point}.0::DOUBLE)) * {PEAK - low}::DOUBLE END, 10) FROM s"""


def device_sql() -> str:
    d = ", ".join(f"('{n}', '{f}', {c}::DOUBLE, {k}::DOUBLE)" for n, f, c, k in DEVICES)
    f = ", ".join(f"('{n}', '{p}', {v}::DOUBLE, {c}::DOUBLE, {k}::DOUBLE)" for n, *rates, c, k in FAMILIES for p, v in zip(PRECISIONS, rates, strict=True) if v > 0)
    return f"""WITH d(device, family, cores, clock) AS (VALUES {d}), f(family, precision, t, base_clock, base_cores) AS (VALUES {f}),
p AS (SELECT device, precision, t * (cores / base_cores) * (clock / base_clock) AS peak FROM d JOIN f USING (family))
SELECT device, precision, round(peak, 2) AS peak, round((6 * 124475904.0::DOUBLE + 6 * 12.0::DOUBLE * 768.0 * 1024.0) * 524288.0 / 3.0 / (peak * 1e12), 6) AS mfu FROM p"""


def oracle_sql() -> dict[str, str]:
    return {
        "log_val_curve": BY_USER + CURVE + " SELECT * FROM curve",
        "log_final_val": BY_USER + CURVE + " SELECT run, arg_max(val_loss, line_no) AS final_val, arg_max(step, line_no) AS final_step FROM curve GROUP BY run",
        "log_records": BY_USER + RECORDS + " SELECT run, ordinal, step, train_loss, val_loss FROM recs",
        "log_steps_once": BY_USER + RECORDS + " SELECT run, step, val_loss FROM recs WHERE val_loss IS NOT NULL",
        "log_target": BY_USER + RECORDS + REACHED.format(target=TARGET) + f" SELECT run, {TARGET}::DOUBLE AS target, step, val_loss, hit FROM reached",
        "convergence": ARMS + ", " + DENSITY + RECORDS + REACHED.format(target=1.0) + f""",
c AS (SELECT run, step * {TOTAL_BATCH} * bpt AS n_bytes, val_loss / ln(2.0) / bpt AS bpb FROM reached JOIN density USING (run))
SELECT round(x.n_bytes, 6) AS base_bytes, round(x.bpb, 6) AS base_bpb, round(y.n_bytes, 6) AS other_bytes, round(y.bpb, 6) AS other_bpb, round(x.n_bytes / y.n_bytes, 6) AS ratio, round(abs(x.n_bytes - y.n_bytes) / greatest(x.n_bytes, y.n_bytes) * 100, 6) AS saving_pct, CASE WHEN y.n_bytes < x.n_bytes THEN 'odd' ELSE 'even' END AS winner
FROM c x, c y WHERE x.run = 'even' AND y.run = 'odd'""",
        "equal_compute": ARMS + ", " + DENSITY + RECORDS + """, m AS (SELECT min(s) AS "at" FROM (SELECT max(step) AS s FROM recs GROUP BY run)),
n AS (SELECT run, "at", step, val_loss, row_number() OVER (PARTITION BY run ORDER BY abs(step - "at"), ordinal) AS k FROM recs, m WHERE val_loss IS NOT NULL)
SELECT run, "at", step, val_loss, round(val_loss / ln(2.0) / bpt, 6) AS bpb FROM n JOIN density USING (run) WHERE k = 1""",
        "metric_streams": """WITH l AS (SELECT user_id::VARCHAR AS run, event_id, event_id % 50 AS step, printf('%.3f', value)::DOUBLE AS trl, printf('%.3f', value / 7)::DOUBLE AS norm FROM events)
SELECT run, 'trl' AS stream, step, arg_max(trl, event_id) AS value FROM l GROUP BY 1, 3 UNION ALL SELECT run, 'norm', step, arg_max(norm, event_id) FROM l GROUP BY 1, 3""",
        "stream_ranges": """WITH l AS (SELECT user_id AS run, event_id, event_id % 50 AS step, printf('%.3f', value)::DOUBLE AS trl, printf('%.3f', value / 7)::DOUBLE AS norm FROM events),
s AS (SELECT 'trl' AS stream, arg_max(trl, event_id) AS value FROM l GROUP BY run, step UNION ALL SELECT 'norm', arg_max(norm, event_id) FROM l GROUP BY run, step)
SELECT stream, min(value) AS low, max(value) AS high, count(*) AS n FROM s GROUP BY stream""",
        "last_values": "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2",
        "zscore_outliers": Z + "SELECT event_id, event_type, round(z, 6) AS z FROM z",
        "skip_updates": Z + "SELECT event_type, sum(coalesce(z > 2.0, false)::INT)::BIGINT AS skipped, count(z) AS scored FROM z GROUP BY event_type",
        "moving_average": """WITH w AS (SELECT event_id, row_number() OVER o AS k, count(*) OVER p AS n, sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s, first_value(value) OVER o AS a, last_value(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z
FROM events WINDOW o AS (PARTITION BY event_type ORDER BY event_id), p AS (PARTITION BY event_type))
SELECT event_id, round((s + greatest(0, 6 - k) * a + greatest(0, k + 5 - n) * z) / 11, 6) AS smooth FROM w""",
        "ema_rate": """WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
e(event_id, user_id, k, s) AS (SELECT event_id, user_id, k, 0.05 * value FROM o WHERE k = 1 UNION ALL SELECT o.event_id, o.user_id, o.k, 0.95 * s + 0.05 * value FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1)
SELECT event_id, round(s / (1 - pow(0.95, k)), 4) AS ema FROM e""",
        "lr_schedules": lr_sql(),
        "bytes_per_token_source": "SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN value / 2 END, 3.6::DOUBLE) AS bytes_per_token FROM events",
        "percent_gate": "WITH g AS (SELECT event_id AS idx, value AS found, CASE WHEN event_id % 10 != 9 THEN round(value, 0) END AS golden FROM events) SELECT idx, found, golden, round(CASE WHEN golden != 0 THEN abs(found - golden) / abs(golden) * 100 END, 6) AS diff_pct, coalesce(CASE WHEN golden != 0 THEN abs(found - golden) / abs(golden) * 100 END <= 1.0, false) AS ok FROM g",
        "fixed_columns": """WITH f AS (SELECT user_id, min(event_id) AS m FROM events WHERE event_type LIKE '%click%' GROUP BY user_id)
SELECT events.user_id::VARCHAR AS run, event_id - m AS idx, printf('%.4f', value)::DOUBLE AS value FROM events JOIN f ON events.user_id = f.user_id WHERE event_id >= m AND event_id < m + 400""",
        "done_markers": "SELECT max(event_id) AS max_step FROM events WHERE event_id % 2 = 0",
        "checkpoint_retention": "SELECT event_id, event_id > (SELECT max(event_id) FROM events) - 150 OR event_id % 200 = 0 AS kept FROM events",
        "harness_rollup": "WITH t AS (SELECT event_type AS task, avg(value / 500) * 100 AS score FROM events GROUP BY 1) SELECT task, round(score, 6) AS score FROM t UNION ALL SELECT 'average', round(avg(score), 6) FROM t",
        "kernel_rollup": """WITH k AS (SELECT o_orderpriority AS phase, o_orderstatus AS kernel, o_totalprice / 1000 AS time_ms, (o_orderkey % 7)::DOUBLE AS read_gb, (o_custkey % 5)::DOUBLE AS write_gb, (o_orderkey % 100)::DOUBLE AS tensor_pct FROM orders)
SELECT phase, kernel, count(*) AS calls, round(sum(time_ms), 2) AS time_ms, round(sum(read_gb), 2) AS read_gb, round(sum(write_gb), 2) AS write_gb, round(sum(tensor_pct * time_ms) / sum(time_ms), 2) AS tensor_pct, round(max((read_gb + write_gb) / time_ms * 1000), 2) AS max_bandwidth, round(sum(time_ms) / (SELECT sum(time_ms) FROM k), 2) AS share
FROM k GROUP BY ROLLUP (phase, kernel)""",
        "recent_mean": "SELECT round(avg(value), 6) AS mean_last FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 20)",
        "val_batches": "SELECT round(avg(m), 6) AS mean_loss, count(*) AS ranks FROM (SELECT user_id, avg(value) AS m FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 10 GROUP BY user_id)",
        "auto_config": "SELECT event_id, CASE WHEN value >= 70 THEN 'large' WHEN value >= 35 THEN 'medium' WHEN value >= 14 THEN 'small' ELSE 'tiny' END AS config FROM events",
        "accumulation": "SELECT s_suppkey, ((s_suppkey % 8 + 1) * 524288 // 32768)::BIGINT AS micro_batches, (10000000000 // ((s_suppkey % 8 + 1) * 524288))::BIGINT AS epoch_steps FROM supplier",
        "utilisation": device_sql(),
        "choice_render": "WITH " + EXAMPLES + """,
t AS (SELECT example_id, label, choice, cl, el, i, CASE WHEN i < cl + el THEN ('0x' || substr(ctx || ending, 2 * i + 1, 2))::INT ELSE 0 END AS x FROM (SELECT *, unnest(range(0, cl + most)) AS i FROM ln))
SELECT example_id, label, choice::INT AS choice, cl::INT AS context_len, string_agg(x::VARCHAR, ' ' ORDER BY i) AS tokens, string_agg((i >= cl AND i < cl + el)::INT::VARCHAR, '' ORDER BY i) AS mask FROM t GROUP BY 1, 2, 3, 4""",
        "choice_predictions": PREDS + "SELECT * FROM preds",
        "choice_accuracy": PREDS + "SELECT count(*) AS n, round(avg((pred = label)::INT), 6) AS acc, round(avg((pred_norm = label)::INT), 6) AS acc_norm FROM preds",
        "running_accuracy": PREDS + "SELECT example_id, count(*) OVER w AS n_seen, round(avg((pred = label)::INT) OVER w, 6) AS acc FROM preds WINDOW w AS (ORDER BY example_id)",
        "label_accuracy": "SELECT quality, count(*) AS n, round(avg(((n_chars > 1000)::INT = quality)::INT), 6) AS acc FROM labels JOIN documents USING (doc_id) GROUP BY quality",
        "eval_stream": "WITH " + EXAMPLES + """,
s AS (SELECT example_id, any_value(label) AS label, any_value(cl) AS cl, sum(el)::BIGINT AS els, any_value(ctx) AS ctx, string_agg(ending, '') AS ends FROM ln GROUP BY example_id),
n AS (SELECT *, 2 + 4 + cl + 4 + els AS n_ints, (SELECT coalesce(sum(('0x' || substr(ctx || ends, 2 * i + 1, 2))::INT), 0) FROM (SELECT unnest(range(0, len(ctx || ends) // 2)) AS i)) AS body FROM s)
SELECT example_id, n_ints::BIGINT AS n_ints, (n_ints * 2)::INT AS n_bytes, (65535 + n_ints * 2 + example_id + label + 4 + cl + els + body)::BIGINT AS total FROM n""",
        "softmax_loss": "WITH " + V + " SELECT vec_id, round(ln(sum(exp(x - m))) + any_value(m) - max(CASE WHEN i = label THEN x END), 6) AS loss FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM u) GROUP BY vec_id",
        "softmax_rows": "WITH " + V + ", e AS (SELECT vec_id, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM u) SELECT vec_id, i, round(e / sum(e) OVER (PARTITION BY vec_id), 8) AS p FROM e",
        "gelu_values": "WITH " + V + ", g AS (SELECT vec_id, x * 8 AS x FROM u WHERE i = 0) SELECT vec_id, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 8) AS y FROM g",
        "standardised": "WITH " + V + ", s AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS v FROM u GROUP BY vec_id), z AS (SELECT vec_id, i, (x - m) / sqrt(v + 1e-5) AS z FROM u JOIN s USING (vec_id)) SELECT vec_id, round(max(CASE WHEN i = 0 THEN z END), 6) AS z0, round(max(z), 6) AS z_max FROM z GROUP BY vec_id",
        "global_norm": "WITH " + V + " SELECT round(sqrt(sum(x * x)), 5) AS norm, count(DISTINCT vec_id) AS n FROM u",
        "top_k_crop": "WITH " + V + " SELECT vec_id, i FROM (SELECT vec_id, i, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM u) WHERE r <= 5",
        "nucleus": PROBS + ", k AS (SELECT vec_id, prob, coalesce(sum(prob) OVER (PARTITION BY vec_id ORDER BY prob DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr) SELECT vec_id, count(*) AS n, round(max(prob) / sum(prob), 6) AS top FROM k WHERE before <= 0.5 GROUP BY vec_id",
        "cdf_sample": PROBS + ", k AS (SELECT vec_id, i, sum(prob) OVER (PARTITION BY vec_id ORDER BY i) AS cdf FROM pr) SELECT vec_id, coalesce(min(CASE WHEN (vec_id * 37 % 101) / 101.0::DOUBLE < cdf THEN i END), max(i)) AS chosen FROM k GROUP BY vec_id",
        "xorshift": """WITH a AS (SELECT vec_id, (vec_id + 1)::UBIGINT AS s FROM embeddings WHERE embedding IS NOT NULL),
b AS (SELECT vec_id, xor(s, s >> 12) AS s FROM a), c AS (SELECT vec_id, xor(s, ((s::HUGEINT * 33554432::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT) AS s FROM b), d AS (SELECT vec_id, xor(s, s >> 27) AS s FROM c),
e AS (SELECT vec_id, s, (s & 4294967295::UBIGINT)::HUGEINT AS lo, (s >> 32)::HUGEINT AS hi FROM d)
SELECT vec_id, (CASE WHEN s >= 9223372036854775808::UBIGINT THEN s::HUGEINT - 18446744073709551616::HUGEINT ELSE s::HUGEINT END)::BIGINT AS state,
  ((lo * 625341585::HUGEINT + ((hi * 1332534557::HUGEINT) % 4294967296::HUGEINT) + (lo * 1332534557::HUGEINT) // 4294967296::HUGEINT) % 4294967296::HUGEINT)::BIGINT AS value, ((value >> 8) / 16777216.0)::DOUBLE AS coin FROM e""",
        "prefix_bytes": "WITH o AS (SELECT lang, n, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS before FROM (SELECT doc_id, lang, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)) SELECT lang, count(*) AS n_docs, sum(least(n, 300000 - before))::BIGINT AS n_bytes FROM o WHERE before < 300000 GROUP BY lang",
    }
