"""DuckDB SQL of the text queries."""

from __future__ import annotations

from tokenmill.operators.minhash import parameters
from tokenmill.plans.text_queries import BATCH, CANDIDATES, EOT, LENGTH, RANKS, SHARD, VOCAB_SIZE

P = 2**31 - 1


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def hexed(table: str = "documents", key: str = "doc_id", name: str = "d") -> str:
    """Texts as hex, and the same in pieces for 256 starting bytes each, as substr is slow on long strings."""
    return f"""{name} AS (SELECT {key} AS id, hex(encode(text)) AS hx FROM {table} WHERE text IS NOT NULL),
{name}_piece AS (SELECT id, o, substr(hx, 2 * o + 1, 576) AS part, len(hx) // 2 AS size FROM (SELECT id, hx, unnest(range(0, len(hx) // 2, 256)) AS o FROM {name}))"""


def counts(sizes, source: str = "d", name: str = "c") -> str:
    return f"""{name} AS (
  SELECT n::INT AS n, gram, count(*) AS freq FROM (
    SELECT n, substr(part, 2 * j + 1, 2 * n) AS gram FROM (
      SELECT part, n, unnest(range(0, least(256, size - o - n + 1))) AS j FROM {source}_piece, (SELECT unnest({list(sizes)}) AS n)))
  GROUP BY n, gram)"""


def top(k: int, source: str = "c", name: str = "top") -> str:
    return f"""{name} AS (
  SELECT n, gram, freq, row_number() OVER (ORDER BY freq DESC, n, gram) - 1 AS cand_id FROM (
    SELECT *, row_number() OVER (PARTITION BY n ORDER BY freq DESC, gram) AS r FROM {source}) WHERE r <= {k}
  ORDER BY freq DESC, n, gram LIMIT {k})"""


def vocab(source: str = "top", order: str = "cand_id", size: int = VOCAB_SIZE, name: str = "v") -> str:
    return f"""{name} AS (
  SELECT i::INT AS token_id, printf('%02X', i) AS token, 'byte' AS kind FROM range(256) t(i)
  UNION ALL SELECT (255 + row_number() OVER (ORDER BY {order}))::INT, gram, 'token' FROM {source}
  UNION ALL SELECT i::INT, hex(encode('<|pad|>')), 'pad' FROM (SELECT unnest(range(256 + (SELECT count(*) FROM {source}), {size - 1})) AS i)
  UNION ALL SELECT {size - 1}, hex(encode('<|endoftext|>')), 'eot')"""


SIZES = range(2, 9)
DOC_TOP = (hexed(), counts(SIZES))
MODEL = (
    hexed(),
    counts((1, 2, 3)),
    "uni AS (SELECT gram AS x, freq FROM c WHERE n = 1)",
    "bi AS (SELECT substr(gram, 1, 2) AS c, substr(gram, 3, 2) AS x, freq FROM c WHERE n = 2)",
    "bi_rows AS (SELECT c, sum(freq)::BIGINT AS context FROM bi GROUP BY c)",
    "model AS (SELECT bi.c, bi.x, bi.freq, context, ln((bi.freq + 1) / (context + 256)) AS log_cond, ln((uni.freq + 1) / ((SELECT sum(freq) FROM uni) + 256)) AS log_uni FROM bi JOIN bi_rows ON bi.c = bi_rows.c JOIN uni ON bi.x = uni.x)",
)
SURPRISE = (
    *MODEL,
    "tri_rows AS (SELECT substr(gram, 1, 4) AS ctx, sum(freq)::BIGINT AS context FROM c WHERE n = 3 GROUP BY 1)",
    "h3 AS (SELECT gram, CAST(-ln((freq + 1) / (context + 256)) AS FLOAT) AS h FROM c JOIN tri_rows ON substr(gram, 1, 4) = ctx WHERE n = 3)",
    "h2 AS (SELECT c || x AS gram, CAST(-log_cond AS FLOAT) AS h FROM model)",
    "p AS (SELECT id, o + j + 3 AS i, substr(part, 2 * j + 1, 6) AS gram FROM (SELECT id, o, part, unnest(range(0, least(256, size - o - 2))) AS j FROM d_piece) UNION ALL SELECT id, 2, substr(hx, 1, 4) FROM d WHERE len(hx) >= 4)",
    "h AS (SELECT id, i, coalesce(h3.h, h2.h) AS h FROM p LEFT JOIN h3 ON p.gram = h3.gram LEFT JOIN h2 ON p.gram = h2.gram)",
    "tau AS (SELECT quantile_cont(h::DOUBLE, 0.8) AS tau FROM h)",
)
SEGMENTS = (
    *SURPRISE,
    "b AS (SELECT id, 1 AS i, 0 AS cut FROM d WHERE hx != '' UNION ALL SELECT id, i, (h > (SELECT tau::FLOAT FROM tau))::INT FROM h)",
    "s AS (SELECT id, i, sum(cut) OVER (PARTITION BY id ORDER BY i) AS seg FROM b)",
    "g AS (SELECT id, seg, min(i) AS start, count(*) AS n FROM s GROUP BY id, seg)",
)
CHOPPED = (
    *SEGMENTS,
    "chop AS (SELECT substr(part, 2 * ((start - 1 + 16 * k) % 256) + 1, 2 * least(16, n - 16 * k)) AS token FROM (SELECT id, start, n, unnest(range(0, (n + 15) // 16)) AS k FROM g) q JOIN d_piece p ON q.id = p.id AND p.o = (start - 1 + 16 * k) // 256 * 256)",
    "sc AS (SELECT token, count(*) AS freq FROM chop GROUP BY token)",
)
PMI = "pmi AS (SELECT token, sum(log_cond - log_uni) AS pmi FROM (SELECT token, substr(token, 2 * j - 1, 2) AS c, substr(token, 2 * j + 1, 2) AS x FROM (SELECT token, unnest(range(1, len(token) // 2)) AS j FROM (SELECT DISTINCT token FROM tok))) t JOIN model USING (c, x) GROUP BY token)"

CAND = (*DOC_TOP, top(CANDIDATES))
FEATURES = "f AS (SELECT cand_id, gram, j * 256 + ('0x' || substr(gram, 2 * j + 1, 2))::BIGINT AS x FROM (SELECT cand_id, gram, unnest(range(0, n)) AS j FROM top))"
HASHES = "ab(k, a, b) AS (VALUES " + ", ".join(f"({k}, {a}::BIGINT, {b}::BIGINT)" for k, (a, b) in enumerate(parameters())) + ")"
SIGS = (*CAND, FEATURES, HASHES, f"sig AS (SELECT cand_id, gram, k, min((a * x + b) % {P}) AS value FROM f, ab GROUP BY cand_id, gram, k)")
BANDS = (
    *SIGS,
    f"band AS (SELECT cand_id, (k // 8)::INT AS band, list_reduce(list(value ORDER BY k), lambda acc, x : (acc * 1000003 + x) % {P}) AS key FROM sig GROUP BY cand_id, k // 8)",
    "bucket AS (SELECT band, key, count(*) AS members, min(cand_id) AS first_id FROM band GROUP BY band, key HAVING count(*) >= 2)",
)
COMPONENTS = (
    *BANDS,
    "edge AS (SELECT DISTINCT first_id AS a, cand_id AS b FROM band JOIN bucket USING (band, key) WHERE cand_id != first_id)",
    "both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge)",
    "reach(node, root) AS (SELECT a, a FROM both_ways UNION SELECT both_ways.b, root FROM reach JOIN both_ways ON reach.node = both_ways.a)",
    "comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)",
)

BENCH = (hexed("benchmark", "item_id"), counts(SIZES), top(VOCAB_SIZE - 257), vocab())
ENCODED = (
    *BENCH,
    "w AS (SELECT id, i, s, substr(hx, 2 * i - 1, 2 * s) AS gram FROM (SELECT id, hx, s, unnest(range(1, len(hx) // 2 - s + 2)) AS i FROM d, (SELECT DISTINCT n AS s FROM top)))",
    "best AS (SELECT id, i, max(s) AS s, arg_max(token_id, s) AS token_id FROM w JOIN v ON v.kind = 'token' AND v.token = w.gram GROUP BY id, i)",
    "e(id, k, i) AS (SELECT id, 0, 1 FROM d WHERE hx != '' UNION ALL SELECT e.id, k + 1, e.i + coalesce(best.s, 1) FROM e JOIN d ON e.id = d.id LEFT JOIN best ON best.id = e.id AND best.i = e.i WHERE e.i + coalesce(best.s, 1) <= len(hx) // 2)",
    "t AS (SELECT e.id, k, e.i, coalesce(token_id, ('0x' || substr(hx, 2 * e.i - 1, 2))::INT)::INT AS token_id, coalesce(best.s, 1) AS s FROM e JOIN d ON e.id = d.id LEFT JOIN best ON best.id = e.id AND best.i = e.i)",
)
TEXT_SUMS = "x AS (SELECT sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS n_words FROM benchmark)"

STREAM = (
    f"d AS (SELECT item_id, hex(encode(text)) AS hx, octet_length(encode(text)) + 1 AS n FROM benchmark)",
    "o AS (SELECT *, (sum(n) OVER (ORDER BY item_id) - n)::BIGINT AS before FROM d)",
    f"tk AS (SELECT item_id, before + j AS g, CASE WHEN j = 0 THEN {EOT} ELSE ('0x' || substr(hx, 2 * j - 1, 2))::INT END AS token FROM (SELECT *, unnest(range(0, n)) AS j FROM o))",
    f"st AS (SELECT g // {SHARD} AS shard, g % {SHARD} AS place, token, coalesce(lead(token) OVER (ORDER BY g), {EOT}) AS target FROM tk)",
    f"mf AS (SELECT shard, count(*) AS n_tokens, ((count(*) - 1) // {RANKS * BATCH * LENGTH})::BIGINT AS samples FROM st GROUP BY shard)",
    f"bt AS (SELECT shard, place // {RANKS * BATCH * LENGTH} AS sample, (place % {RANKS * BATCH * LENGTH}) // {BATCH * LENGTH} AS rank, (place % {BATCH * LENGTH}) // {LENGTH} AS row, place % {LENGTH} AS col, token, target FROM st JOIN mf USING (shard) WHERE place // {RANKS * BATCH * LENGTH} < samples)",
)
PIECES = f"pc AS (SELECT item_id, shard, greatest(before - shard * {SHARD}, 0) AS first, least((shard + 1) * {SHARD}, before + n) - greatest(shard * {SHARD}, before) AS n_tokens FROM (SELECT *, unnest(range(before // {SHARD}, (before + n - 1) // {SHARD} + 1)) AS shard FROM o))"
SPLIT = "CASE WHEN shard = 0 THEN 'val' ELSE 'train' END AS split"


def oracle_sql() -> dict[str, str]:
    return {
        "ngram_counts_n2": with_(hexed(), counts((2,))) + "SELECT * FROM c",
        "ngram_counts_sql_n3": with_(hexed("benchmark", "item_id"), counts((3,))) + "SELECT * FROM c",
        "ngram_totals": with_(*DOC_TOP) + "SELECT n, sum(freq)::BIGINT AS windows, count(*) AS distinct_grams FROM c GROUP BY n",
        "ngram_topk_per_n": with_(*DOC_TOP) + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY freq DESC, gram) AS rank FROM c) WHERE rank <= 50",
        "freq_vocab": with_(*DOC_TOP, top(VOCAB_SIZE - 257), vocab()) + "SELECT * FROM v",
        "vocab_lengths": with_(*DOC_TOP, top(VOCAB_SIZE - 257), vocab()) + "SELECT round(avg(len(token) // 2), 6) AS mean_all, round(avg(len(token) // 2) FILTER (WHERE kind IN ('byte', 'token')), 6) AS mean_plain FROM v",
        "byte_lm_counts": with_(hexed(), counts((1, 2, 3))) + "SELECT * FROM c",
        "byte_lm_contexts": with_(hexed(), counts((2, 3))) + "SELECT n, substr(gram, 1, 2 * n - 2) AS context, sum(freq)::BIGINT AS freq, count(*) AS followers FROM c GROUP BY 1, 2",
        "bigram_model": with_(*MODEL) + "SELECT c, x, freq, context, round(log_cond, 6) AS log_cond, round(log_uni, 6) AS log_uni FROM model",
        "bigram_entropy_by_lang": """WITH d AS (SELECT lang, hex(encode(text)) AS hx FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, substr(hx, 2 * o + 1, 576) AS part, len(hx) // 2 - o AS size FROM (SELECT lang, hx, unnest(range(0, len(hx) // 2, 256)) AS o FROM d)),
bi AS (SELECT lang, substr(part, 2 * i + 1, 2) AS c, substr(part, 2 * i + 3, 2) AS x, count(*) AS freq FROM (SELECT lang, part, unnest(range(0, least(256, size - 1))) AS i FROM p) GROUP BY 1, 2, 3),
n AS (SELECT lang, c, freq, sum(freq) OVER (PARTITION BY lang, c) AS n FROM bi)
SELECT lang, sum(freq)::BIGINT AS pairs, round(sum(-freq * log2(freq / n)) / sum(freq), 6) AS bits FROM n GROUP BY lang""",
        "surprise_stats": with_(*SURPRISE, "q AS (SELECT h::DOUBLE AS h FROM h)")
        + "SELECT count(*) AS positions, round(avg(h), 5) AS mean, round(stddev_pop(h), 5) AS std, round(quantile_cont(h, 0.5), 5) AS p50, round(quantile_cont(h, 0.8), 5) AS p80, round(quantile_cont(h, 0.95), 5) AS p95, round((SELECT tau FROM tau), 5) AS tau, round(avg((h::FLOAT > (SELECT tau::FLOAT FROM tau))::INT), 5) AS boundary_share, round(1 / (avg((h::FLOAT > (SELECT tau::FLOAT FROM tau))::INT) + 1e-9), 5) AS mean_length FROM q",
        "segments_topk": with_(*CHOPPED) + "SELECT token, freq FROM sc ORDER BY freq DESC, token LIMIT 300",
        "segment_pairs_topk": with_(
            *SEGMENTS,
            "a AS (SELECT id, start, n, lag(start) OVER (PARTITION BY id ORDER BY seg) AS p, lag(n) OVER (PARTITION BY id ORDER BY seg) AS pn FROM g)",
            "y AS (SELECT 0 AS pair, id, start AS st, n FROM a WHERE n BETWEEN 2 AND 16 UNION ALL SELECT 1, id, p, pn + n FROM a WHERE pn + n BETWEEN 2 AND 16)",
            "u AS (SELECT pair, substr(part, 2 * ((st - 1) % 256) + 1, 2 * n) AS token FROM y JOIN d_piece z ON y.id = z.id AND z.o = (st - 1) // 256 * 256)",
            "m AS (SELECT token, max(freq) AS freq FROM (SELECT pair, token, count(*) AS freq FROM u GROUP BY 1, 2) GROUP BY token)",
        )
        + "SELECT token, freq FROM m WHERE freq >= 10 ORDER BY freq DESC, len(token), token LIMIT 300",
        "token_pmi": with_(*MODEL, counts((3, 5), "d", "c35"), "tok AS (SELECT gram AS token, freq FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY freq DESC, gram) AS r FROM c35) WHERE r <= 100)", PMI)
        + "SELECT token, freq, round(pmi, 5) AS pmi FROM tok JOIN pmi USING (token)",
        "entropy_vocab": with_(*CHOPPED, "tok AS (SELECT token, freq FROM sc WHERE len(token) > 2 AND freq >= 10)", PMI, f"best AS (SELECT token AS gram, freq, round(pmi, 9) AS pmi FROM tok JOIN pmi USING (token) WHERE round(pmi, 9) >= 0 ORDER BY freq DESC, 3 DESC, token LIMIT {VOCAB_SIZE - 257})", vocab("best", "freq DESC, pmi DESC, gram")) + "SELECT * FROM v",
        "cluster_vocab": with_(*(x if i != 2 else top((VOCAB_SIZE - 256) * 10) for i, x in enumerate(COMPONENTS)), f"best AS (SELECT cand_id, gram FROM top LEFT JOIN comp ON cand_id = node WHERE coalesce(root, cand_id) = cand_id ORDER BY cand_id LIMIT {VOCAB_SIZE - 257})", vocab("best")) + "SELECT * FROM v",
        "minhash_signatures": with_(*SIGS) + "SELECT cand_id, gram AS token, k::INT AS k, value FROM sig",
        "lsh_buckets": with_(*BANDS) + "SELECT * FROM bucket",
        "lsh_pairs": with_(*BANDS) + "SELECT DISTINCT x.cand_id AS a, y.cand_id AS b FROM band x JOIN band y ON x.band = y.band AND x.key = y.key AND x.cand_id < y.cand_id",
        "lsh_components": with_(*COMPONENTS) + "SELECT node, root FROM comp",
        "lsh_representatives": with_(*COMPONENTS) + "SELECT coalesce(root, cand_id) AS cluster, count(*) AS members, max(freq) AS freq, min(cand_id) AS best FROM top LEFT JOIN comp ON cand_id = node GROUP BY 1",
        "jaccard_pairs": with_(*CAND, FEATURES, "s AS (SELECT p.cand_id AS a, q.cand_id AS b, count(*) AS shared FROM f p JOIN f q ON p.x = q.x AND p.cand_id < q.cand_id GROUP BY 1, 2)")
        + "SELECT a, b, shared, round(shared / (p.n + q.n - shared), 6) AS jaccard FROM s JOIN top p ON a = p.cand_id JOIN top q ON b = q.cand_id WHERE shared / (p.n + q.n - shared) >= 0.8",
        "match_positions": with_(hexed("benchmark", "item_id"), counts(SIZES), top(300), "w AS (SELECT id, i, substr(hx, 2 * i - 1, 2 * n) AS gram FROM (SELECT id, hx, n, unnest(range(1, len(hx) // 2 - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM top)))") + "SELECT cand_id, id AS item_id, (i - 1)::INT AS pos FROM w JOIN top USING (gram)",
        "first_round_gain": with_(hexed("benchmark", "item_id"), counts(SIZES), top(300)) + "SELECT cand_id, gram AS token, (freq * (n - 1))::BIGINT AS gain FROM top",
        "encode_greedy": with_(*ENCODED) + "SELECT id AS item_id, k::INT AS pos, token_id FROM t",
        "encode_with_eot": with_(*ENCODED) + f"SELECT id AS item_id, count(*) + 1 AS n_tokens, {VOCAB_SIZE - 1} AS first FROM t GROUP BY id",
        "decode_roundtrip": "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS digest FROM documents",
        "decode_join": "SELECT item_id, md5(text) AS digest FROM benchmark WHERE text != ''",
        "encoded_shards": with_(*ENCODED, f"a AS (SELECT id, -1 AS k, {VOCAB_SIZE - 1} AS token_id FROM d UNION ALL SELECT id, k, token_id FROM t)", "o AS (SELECT token_id, row_number() OVER (ORDER BY id, k) - 1 AS g FROM a)", f"p AS (SELECT g // {SHARD} AS shard, g % {SHARD} AS place, token_id FROM o)")
        + f"SELECT shard, {SPLIT}, count(*) AS n_tokens, sum(token_id)::BIGINT AS tokens, sum(token_id * place)::BIGINT AS weighted FROM p GROUP BY shard",
        "epoch_order": with_(*STREAM[:5], "x AS (SELECT shard, unnest(range(0, samples)) AS sample FROM mf)") + "SELECT e.epoch, (e.epoch * (SELECT count(*) FROM x) + row_number() OVER (PARTITION BY e.epoch ORDER BY shard, sample) - 1)::BIGINT AS step, shard, sample FROM x, (SELECT unnest([0, 1]) AS epoch) e",
        "character_prefix": "WITH o AS (SELECT doc_id, text, (sum(length(text)) OVER (ORDER BY doc_id) - length(text))::BIGINT AS before FROM documents WHERE text IS NOT NULL) SELECT doc_id, before, least(length(text), 1000000 - before)::BIGINT AS n_chars, md5(substr(text, 1, (1000000 - before)::BIGINT)) AS digest FROM o WHERE before < 1000000",
        "loader_totals": with_(*STREAM[:5]) + f"SELECT {SPLIT}, count(*) AS shards, sum(n_tokens)::BIGINT AS n_tokens, sum(samples)::BIGINT AS samples FROM mf GROUP BY 1",
        "benchmark_metrics": with_(*ENCODED, TEXT_SUMS, "y AS (SELECT count(*) AS n_tokens, sum((token_id > 255)::INT) AS m FROM t)") + "SELECT n_bytes, n_words, n_tokens, round(n_bytes / n_tokens, 6) AS compression, round(m / n_tokens, 6) AS coverage, round(n_tokens / n_words, 6) AS tokens_per_word FROM x, y",
        "tokenizer_comparison": with_(*ENCODED, TEXT_SUMS, "y AS (SELECT count(*) AS n_tokens FROM t)")
        + "SELECT 'bytes' AS name, n_bytes AS n_tokens, 1.0::DOUBLE AS compression_ratio, 1.0::DOUBLE AS tokens_per_word_ratio FROM x UNION ALL SELECT 'grams', n_tokens, round(n_bytes / n_tokens, 6), round(n_tokens / n_bytes, 6) FROM x, y",
        "word_fertility": with_(
            *BENCH,
            "words AS (SELECT word, count(*) AS times, hex(encode(word)) AS whx FROM (SELECT unnest(regexp_extract_all(text, '\\S+')) AS word FROM benchmark) GROUP BY word)",
            "w AS (SELECT word, i, s, substr(whx, 2 * i - 1, 2 * s) AS gram FROM (SELECT word, whx, s, unnest(range(1, len(whx) // 2 - s + 2)) AS i FROM words, (SELECT DISTINCT n AS s FROM top)))",
            "best AS (SELECT word, i, max(s) AS s FROM w JOIN v ON v.kind = 'token' AND v.token = w.gram GROUP BY word, i)",
            "e(word, i) AS (SELECT word, 1 FROM words UNION ALL SELECT e.word, e.i + coalesce(best.s, 1) FROM e JOIN words ON e.word = words.word LEFT JOIN best ON best.word = e.word AND best.i = e.i WHERE e.i + coalesce(best.s, 1) <= len(whx) // 2)",
            "k AS (SELECT word, count(*) AS n FROM e GROUP BY word)",
        )
        + "SELECT sum(times)::BIGINT AS n_words, sum(times * n)::BIGINT AS n_tokens, round(sum(times * n) / sum(times), 6) AS fertility FROM words JOIN k USING (word)",
        "token_density": with_(*ENCODED, "o AS (SELECT s, row_number() OVER (ORDER BY id, k) AS r FROM t)") + "SELECT count(*) AS n_tokens, round(avg(s), 6) AS bytes_per_token FROM o WHERE r <= 10000",
        "bits_per_byte": with_(*MODEL) + "SELECT sum(freq)::BIGINT AS pairs, round(sum(-log_cond * freq) / ln(2.0) / sum(freq), 6) AS bpb FROM model",
        "packed_grams": with_(hexed("benchmark", "item_id"), counts((2, 5, 8)), "t AS (SELECT n, gram FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY freq DESC, gram) AS r FROM c) WHERE r <= 200)")
        + "SELECT n, gram, (SELECT CASE WHEN v >= 9223372036854775808::HUGEINT THEN v - 18446744073709551616::HUGEINT ELSE v END::BIGINT FROM (SELECT sum(('0x' || substr(gram, 2 * j + 1, 2))::HUGEINT * (256::HUGEINT ** j)::HUGEINT) AS v FROM (SELECT unnest(range(0, n)) AS j))) AS packed, gram AS back FROM t",
        "gram_features": with_(hexed("benchmark", "item_id"), counts((4,)), "t AS (SELECT n, gram FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY freq DESC, gram) AS r FROM c) WHERE r <= 200)") + "SELECT gram, (j * 256 + ('0x' || substr(gram, 2 * j + 1, 2))::INT)::INT AS feature FROM (SELECT gram, unnest(range(0, n)) AS j FROM t)",
        "printable_tokens": with_(*BENCH) + "SELECT kind, sum((len(token) > 2 OR ('0x' || token)::INT BETWEEN 32 AND 126 OR ('0x' || token)::INT BETWEEN 9 AND 13)::INT)::BIGINT AS printed, count(*) AS n FROM (SELECT kind, CASE WHEN len(token) > 2 THEN '0000' ELSE token END AS token FROM v WHERE kind IN ('byte', 'token')) GROUP BY kind",
        "corpus_prefix": "WITH d AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL), o AS (SELECT *, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS before FROM d) SELECT doc_id, before, least(n, 1000000 - before)::BIGINT AS n_bytes, md5(unhex(substr(hx, 1, 2 * least(n, 1000000 - before)::INT))) AS digest FROM o WHERE before < 1000000",
        "doc_split_marker": "WITH j AS (SELECT conv_id, string_agg(text, chr(10) || '<|endoftext|> ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, string_split(text, '<|endoftext|>') AS parts FROM j), u AS (SELECT conv_id, i - 1 AS part, regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g') AS document FROM (SELECT conv_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)) SELECT * FROM u WHERE document != ''",
        "section_split": "WITH p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS parts FROM documents), u AS (SELECT doc_id, CASE WHEN i < len(parts) THEN parts[i] || chr(10) || chr(10) ELSE parts[i] END AS s FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)) SELECT doc_id, count(*) AS sections, sum(length(s))::BIGINT AS chars, max(length(s)) AS longest FROM u GROUP BY doc_id",
        "run_slices": "WITH c AS (SELECT doc_id, length(text) AS chars, unnest(list_transform(range(0, length(text), 1000), lambda a : regexp_extract_all(text[a + 1 : a + 1000], '\\s+|\\S+'))) AS runs FROM documents) SELECT doc_id, sum(1 + list_sum(list_transform(runs, lambda r : (length(r) - 1) // 12)))::BIGINT AS slices, any_value(chars) AS chars FROM c GROUP BY doc_id",
        "text_shards": "SELECT shard, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS shard FROM documents) GROUP BY shard",
        "shard_pack": with_(*STREAM[:2], PIECES) + f"SELECT item_id, shard, {SPLIT}, first, n_tokens FROM pc",
        "document_shards": with_("o AS (SELECT doc_id, n, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS before FROM (SELECT doc_id, coalesce(length(text), 0) + 1 AS n FROM documents))", "pc AS (SELECT doc_id, shard, least((shard + 1) * 100000, before + n) - greatest(shard * 100000, before) AS n_tokens FROM (SELECT *, unnest(range(before // 100000, (before + n - 1) // 100000 + 1)) AS shard FROM o))") + f"SELECT shard, {SPLIT}, sum(n_tokens)::BIGINT AS n_tokens, count(*) AS n_docs FROM pc GROUP BY shard",
        "loader_manifest": with_(*STREAM[:2], PIECES) + f"SELECT shard, {SPLIT}, sum(n_tokens)::BIGINT AS n_tokens, count(*) AS n_docs, ((sum(n_tokens) - 1) // {RANKS * BATCH * LENGTH})::BIGINT AS samples, sum(n_tokens) >= {RANKS * BATCH * LENGTH + 1} AS valid FROM pc GROUP BY shard",
        "batch_layout": with_(*STREAM) + "SELECT * FROM bt",
        "batch_resume": with_(*STREAM) + "SELECT shard, sample, rank, count(*) AS n, sum(token)::BIGINT AS tokens, sum(target)::BIGINT AS targets FROM bt WHERE shard > 1 OR (shard = 1 AND sample >= 3) GROUP BY 1, 2, 3",
        "val_prefix_split": with_(*STREAM[:3]) + "SELECT CASE WHEN g < 5000 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(token)::BIGINT AS tokens FROM tk GROUP BY 1",
        "token_range_check": with_(*STREAM[:3]) + f"SELECT count(*) AS n, sum((token < 0 OR token > {EOT})::INT)::BIGINT AS out_of_range, max(token) AS largest FROM tk",
        "token_shard_files": with_(*STREAM[:4]) + "SELECT shard, count(*) AS n_tokens, sum(token)::BIGINT AS tokens, sum(token * place)::BIGINT AS weighted, (SELECT count(DISTINCT shard) FROM st) AS files FROM st GROUP BY shard",
        "eval_split": "SELECT ranks, ceil(n / ranks)::BIGINT AS per_rank, ceil(ceil(n / ranks) / 2)::BIGINT AS batches FROM (SELECT count(*) AS n FROM benchmark), (SELECT unnest([1, 2, 3, 7]) AS ranks)",
    }
