"""The SQL twin of each registered query, for DuckDB."""

from __future__ import annotations

from catalog.queries import LENGTH, SEED
from catalog.tables import BAD_LOG_LINES, DOC_ROWS, EVENT_ROWS, GAUGE_SAMPLES, RESOURCE_OF_EVENT, RESOURCE_SAMPLES, SFT_PAIRS, STEP_LOG

WORD = "[^ \\t\\r\\n]+"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def digest(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


def prompt_of(instruction: str, extra: str) -> str:
    return (
        f"'Instruction: ' || {instruction} || CASE WHEN {extra} <> '' THEN chr(10) || 'Input: ' || {extra} ELSE '' END"
        f" || chr(10) || chr(10) || 'Response:'"
    )


def texts(source: str, keys: str, instruction="instruction", extra="input", output="output") -> str:
    return (
        f"texts AS (SELECT {keys}, {prompt_of(instruction, extra)} AS prompt, {output} AS target,"
        f" {prompt_of(instruction, extra)} || ' ' || {output} AS full_text FROM {source})"
    )


DOC_TEXTS = DOC_ROWS + ",\n" + texts("doc_rows", "doc_id")
PAIR_TEXTS = SFT_PAIRS + ",\n" + texts("sft_pairs", "conv_id, turn")


def byte_ids(keys: str) -> str:
    return (
        f"ids AS (SELECT {keys}, strlen(prompt)::INTEGER AS prompt_len,"
        " list_transform(regexp_extract_all(hex(encode(full_text)), '..'), lambda x: ('0x' || x)::INTEGER) AS ids FROM texts)"
    )


def word_ids(keys: str) -> str:
    return (
        f"ids AS (SELECT {keys}, len(regexp_extract_all(prompt, '{WORD}'))::INTEGER AS prompt_len,"
        f" list_transform(regexp_extract_all(full_text, '{WORD}'),"
        " lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 32000)::INTEGER) AS ids FROM texts)"
    )


def examples(keys: str, pad: int) -> str:
    return (
        f"cut AS (SELECT {keys}, least(prompt_len, {LENGTH}) AS p, ids[1:{LENGTH}] AS ids FROM ids),\n"
        f"padded AS (SELECT {keys}, p, len(ids) AS n,"
        f" list_concat(ids, list_transform(range(0, {LENGTH} - len(ids)), lambda i: {pad})) AS input_ids FROM cut),\n"
        f"examples AS (SELECT {keys}, n AS n_tokens, {digest('input_ids')} AS ids_md5,"
        f" {digest('list_transform(input_ids, lambda x, i: CASE WHEN i <= p THEN -100 ELSE x END)')} AS labels_md5 FROM padded)"
    )


DOC_EXAMPLES = ",\n".join([DOC_TEXTS, byte_ids("doc_id"), examples("doc_id", 256)])
PAIR_EXAMPLES = ",\n".join([PAIR_TEXTS, byte_ids("conv_id, turn"), examples("conv_id, turn", 256)])


def shuffled(keys: str, source: str, into: str = "shuffled", seed: int = SEED) -> str:
    text = " || '|' || ".join(f"{k.strip()}::VARCHAR" for k in keys.split(","))
    return (
        f"{into} AS (SELECT {keys}, row_number() OVER (ORDER BY md5('{seed}|' || {text}), {keys}) - 1 AS pos,"
        f" count(*) OVER () AS n FROM {source})"
    )


def ratio_split(keys: str, source: str, ratio: float, train: int, val: int) -> str:
    return ",\n".join(
        [
            shuffled(keys, source),
            f"sized AS (SELECT *, ceil({ratio}::DOUBLE * n)::BIGINT AS n_val FROM shuffled)",
            f"split_rows AS (SELECT {keys}, CASE WHEN pos < n_val THEN 'val' ELSE 'train' END AS split,"
            " CASE WHEN pos < n_val THEN pos ELSE pos - n_val END AS position,"
            f" CASE WHEN pos < n_val THEN ceil(n_val / {max(val, 1)}::DOUBLE) ELSE ceil((n - n_val) / {max(train, 1)}::DOUBLE) END::BIGINT AS size"
            " FROM sized)",
            f"sharded AS (SELECT {keys}, split, position, (position // size)::INTEGER AS shard_id FROM split_rows)",
        ]
    )


def manifest(train: int, val: int) -> str:
    return (
        f"slots AS (SELECT 'train' AS split, i::INTEGER AS shard_id, 'shard_' || i AS shard_name FROM range({train}) r(i)"
        f" UNION ALL SELECT 'val', i::INTEGER, 'val_shard_' || i FROM range({val}) r(i)),\n"
        "manifest AS (SELECT s.split, s.shard_id, s.shard_name, count(d.position)::BIGINT AS num_rows"
        " FROM slots s LEFT JOIN sharded d ON s.split = d.split AND s.shard_id = d.shard_id GROUP BY ALL)"
    )


DOC_MANIFEST = ",\n".join([ratio_split("doc_id", "documents", 0.1, 3, 2), manifest(3, 2)])
ORDER_MANIFEST = ",\n".join([ratio_split("o_orderkey", "orders", 0.05, 7, 3), manifest(7, 3)])

ORDERED_ORDERS = (
    "ordered AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders)"
)


def ordered_docs(source: str, shards: int, into: str) -> str:
    return (
        f"{into} AS (SELECT doc_id, position, (position // ceil(n / {shards}::DOUBLE)::BIGINT)::INTEGER AS shard_id FROM"
        f" (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM {source}))"
    )


def epochs(keys: str, source: str, count: int) -> str:
    return (
        f"epochs AS (SELECT e::INTEGER AS epoch, shard_id, {keys}, row_number() OVER (PARTITION BY e, shard_id"
        f" ORDER BY md5('{SEED}|' || e || '|' || position), position) - 1 AS rn FROM {source}, range({count}) r(e))"
    )


ORDER_EPOCHS = ",\n".join(
    [
        ORDERED_ORDERS,
        "sharded AS (SELECT o_orderkey, position, (position // ceil(n / 4.0::DOUBLE)::BIGINT)::INTEGER AS shard_id FROM ordered)",
        epochs("o_orderkey", "sharded", 2),
    ]
)

PERPLEXITY = "CASE WHEN loss IS NULL OR isnan(loss) THEN loss WHEN loss > 20 THEN exp(20.0::DOUBLE) ELSE exp(loss) END"

WHOLE_AND_CUT = (
    f"SELECT doc_id, prompt_len, len(ids)::INTEGER AS n_ids, {digest('ids')} AS ids_md5,"
    f" {digest(f'ids[1:{LENGTH}]')} AS cut_md5 FROM ids"
)

_VISIBLE = """SELECT r::INTEGER AS rank, {name} AS shard_name, m.num_rows, '{label}' AS template
  FROM range(3) t(r) LEFT JOIN manifest m ON m.shard_name = {name}"""

ORACLE = {
    "q_read_examples": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE lang = 'fr'",
    "q_limit_first_n": "SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 150",
    "q_load_shard": with_(DOC_EXAMPLES, ordered_docs("documents", 4, "placed"))
    + " SELECT position, ids_md5, n_tokens, labels_md5 FROM examples JOIN placed USING (doc_id) WHERE shard_id = 1",
    "q_resolve_shards": with_(DOC_MANIFEST)
    + """ SELECT r::INTEGER AS rank, 'shard_' || r AS shard_name, m.split IS NOT NULL AS found, m.num_rows
  FROM range(5) t(r) LEFT JOIN manifest m ON m.shard_name = 'shard_' || r""",
    "q_val_visibility": with_(DOC_MANIFEST) + " " + " UNION ALL ".join(
        _VISIBLE.format(name=name, label=label)
        for label, name in {
            "none": "NULL::VARCHAR",
            "shared": "CASE WHEN r = 0 THEN 'val_shard_1' END",
            "by rank": "'val_shard_' || r",
            "padded": "'val_shard_' || lpad(r::VARCHAR, 5, '0')",
        }.items()
    ),
    "q_write_read_roundtrip": with_(DOC_EXAMPLES, ratio_split("doc_id", "documents", 0.1, 4, 2))
    + " SELECT split, shard_id, position, ids_md5, n_tokens, labels_md5 FROM examples JOIN sharded USING (doc_id)",
    "q_shard_manifest": with_(ORDER_MANIFEST) + " SELECT * FROM manifest",
    "q_run_summary": with_(STEP_LOG)
    + """ SELECT run_id AS model_name, 4::BIGINT AS batch_size, max(step) AS global_step,
  round(sum(duration), 4) AS total_time_seconds FROM step_log WHERE rank = 0 GROUP BY run_id""",
    "q_parse_logs": with_(STEP_LOG)
    + """ SELECT date_trunc('milliseconds', ts) AS ts, CASE WHEN loss > 5 THEN 'WARNING' ELSE 'INFO' END AS level,
  rank, 3::INTEGER AS world_size, run_id AS process,
  '[step ' || step || '] train_loss=' || printf('%.4f', loss)
    || CASE WHEN grad_norm IS NOT NULL THEN ' grad_norm=' || printf('%.4f', grad_norm) ELSE '' END AS message FROM step_log""",
    "q_parse_step_metrics": with_(STEP_LOG)
    + """ SELECT event_id, step, 'train_loss' AS metric, printf('%.4f', loss)::DOUBLE AS value FROM step_log
  UNION ALL SELECT event_id, step, 'grad_norm', printf('%.4f', grad_norm)::DOUBLE FROM step_log WHERE grad_norm IS NOT NULL""",
    "q_format_default": with_(PAIR_TEXTS) + " SELECT conv_id, turn, prompt, target FROM texts",
    "q_format_template": """WITH p AS (SELECT doc_id, '### Q: ' || text || ' {as is}' || chr(10) || '### Context: ' || source
    || chr(10) || '### A:' AS prompt FROM documents)
  SELECT doc_id, md5(prompt) AS prompt_md5, length(prompt)::INTEGER AS prompt_chars FROM p""",
    "q_full_text": with_(DOC_TEXTS)
    + " SELECT doc_id, md5(full_text) AS text_md5, length(full_text)::INTEGER AS text_chars FROM texts",
    "q_other_log_lines": with_(STEP_LOG) + " SELECT value, count(*) AS n FROM (SELECT '  step: more' AS value FROM step_log WHERE step % 5 = 0"
    + "".join(f" UNION ALL SELECT '{line}' FROM step_log WHERE step % 7 = 0" for line in BAD_LOG_LINES) + ") GROUP BY value",
    "q_limit_by_time": """SELECT event_id, 'plain' AS search FROM (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 150)
  UNION ALL SELECT event_id, 'narrowing' FROM (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 700)""",
    "q_split_by_time": f"""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY md5('{SEED}|' || epoch_us(ts) || '|' || event_id), ts, event_id) - 1 AS p,
    ceil(0.2::DOUBLE * count(*) OVER ())::BIGINT AS n_val FROM events)
  SELECT event_id, CASE WHEN p < n_val THEN 'val' ELSE 'train' END AS split, CASE WHEN p < n_val THEN p ELSE p - n_val END AS position FROM o""",
    "q_rewrite_keep_stale": """WITH n AS (SELECT count(*) AS total FROM documents),
  planned AS (SELECT s, CASE WHEN s < 4 THEN greatest(0, least(5, (s + 1) * 2) - s * 2)
    ELSE greatest(0, least(total, (s + 1) * ceil(total / 6.0::DOUBLE)::BIGINT) - s * ceil(total / 6.0::DOUBLE)::BIGINT) END::BIGINT AS num_rows
    FROM n, range(6) t(s))
  SELECT 'shard_' || s AS shard_name, num_rows, num_rows AS stored_rows FROM planned""",
    "q_format_on_null": """WITH d AS (SELECT doc_id, CASE WHEN lang <> 'fr' THEN lang END AS l, CASE WHEN doc_id % 3 <> 0 THEN source END AS s FROM documents),
  r AS (SELECT unnest(['text', 'empty', 'drop']) AS on_null)
  SELECT doc_id, on_null, 'Instruction: ' || coalesce(l, CASE WHEN on_null = 'text' THEN 'None' ELSE '' END)
    || CASE WHEN s <> '' THEN chr(10) || 'Input: ' || s ELSE '' END || chr(10) || chr(10) || 'Response:' AS prompt
  FROM d, r WHERE on_null <> 'drop' OR (l IS NOT NULL AND s IS NOT NULL)""",
    "q_read_formats": """SELECT doc_id, md5(text) AS text_md5, fmt FROM documents, (SELECT unnest(['json', 'csv']) AS fmt)
  WHERE lang = 'de' AND doc_id % 2 = 1""",
    "q_pairs_sliced": with_(SFT_PAIRS) + " SELECT conv_id, turn, instruction, input, output FROM sft_pairs",
    "q_custom_formatter": """SELECT doc_id, '[' || upper(lang) || '] ' || source || ':' AS prompt,
  md5(trim(text, ' ')) AS target_md5 FROM documents""",
    "q_encode_bytes": with_(DOC_TEXTS, byte_ids("doc_id")) + " " + WHOLE_AND_CUT,
    "q_encode_hash": with_(DOC_TEXTS, word_ids("doc_id")) + " " + WHOLE_AND_CUT,
    "q_encode_file": with_(
        DOC_TEXTS,
        byte_ids("doc_id").replace("ids AS (", "bare AS (", 1),
        "ids AS (SELECT doc_id, prompt_len, list_concat([257], ids) AS ids FROM bare)",
        examples("doc_id", 256),
    )
    + " SELECT doc_id, ids_md5, n_tokens, labels_md5 FROM examples",
    "q_pad_mask": with_(DOC_TEXTS, word_ids("doc_id"), examples("doc_id", 32000))
    + f""" SELECT doc_id, n::INTEGER AS n_ids, {digest('input_ids')} AS ids_md5,
  {digest(f'list_transform(range(0, {LENGTH}), lambda i: CASE WHEN i < n THEN 1 ELSE 0 END)')} AS mask_md5 FROM padded""",
    "q_labels": with_(PAIR_EXAMPLES) + " SELECT conv_id, turn, ids_md5, n_tokens, labels_md5 FROM examples",
    "q_labels_mask_padding": with_(PAIR_EXAMPLES.replace("i <= p THEN", "i <= p OR i > n THEN"))
    + " SELECT conv_id, turn, ids_md5, n_tokens, labels_md5 FROM examples",
    "q_val_batches": with_(ORDER_EPOCHS)
    + """, stored AS (SELECT o_orderkey, shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY position) - 1 AS rn FROM sharded)
  SELECT shard_id, rn // 12 AS batch_id, count(*)::INTEGER AS examples, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) AS order_keys
  FROM stored GROUP BY shard_id, rn // 12""",
    "q_final_schema": f"""SELECT c AS "column", {LENGTH}::INTEGER AS length, count(*) AS examples
  FROM documents, (VALUES ('input_ids'), ('attention_mask'), ('labels')) v(c) GROUP BY c""",
    "q_global_position": """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position,
  row_number() OVER (ORDER BY md5('42|' || event_id), event_id) - 1 AS shuffled_position FROM events""",
    "q_shard_assign": with_(ORDERED_ORDERS)
    + " SELECT o_orderkey, position, (position // ceil(n / 7.0::DOUBLE)::BIGINT)::INTEGER AS shard_id FROM ordered",
    "q_shard_one": with_(ORDERED_ORDERS)
    + " SELECT o_orderkey, position FROM ordered WHERE position // ceil(n / 7.0::DOUBLE)::BIGINT = 6",
    "q_split_ratio": with_(ratio_split("o_orderkey", "orders", 0.07, 1, 1)) + " SELECT o_orderkey, split, position FROM split_rows",
    "q_split_subset": with_(
        "train_rows AS (SELECT doc_id FROM documents WHERE lang = 'en')",
        "val_rows AS (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 100)",
        ordered_docs("train_rows", 3, "train_placed"),
        ordered_docs("val_rows", 2, "val_placed"),
    )
    + " SELECT doc_id, 'train' AS split, shard_id, position FROM train_placed"
    " UNION ALL SELECT doc_id, 'val', shard_id, position FROM val_placed",
    "q_split_val_unwritten": with_(ratio_split("doc_id", "documents", 0.1, 2, 1))
    + " SELECT split, shard_id, count(*) AS num_rows FROM sharded WHERE split = 'train' GROUP BY ALL",
    "q_epoch_shuffle": with_(ORDER_EPOCHS) + " SELECT epoch, shard_id, o_orderkey, rn FROM epochs",
    "q_batches": with_(ORDER_EPOCHS)
    + """ SELECT epoch, shard_id, rn // 12 AS batch_id, count(*)::INTEGER AS examples,
  string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) AS order_keys FROM epochs GROUP BY epoch, shard_id, rn // 12""",
    "q_batch_tokens": with_(
        DOC_TEXTS,
        word_ids("doc_id"),
        ordered_docs("documents", 4, "placed"),
        f"sized AS (SELECT shard_id, position, least(len(ids), {LENGTH}) AS n FROM placed JOIN ids USING (doc_id))",
        epochs("n", "sized", 2),
    )
    + """ SELECT epoch, shard_id, rn // 4 AS batch_id, sum(n)::BIGINT AS tokens, count(*) AS examples
  FROM epochs GROUP BY epoch, shard_id, rn // 4""",
    "q_step_plan": with_(
        ORDER_MANIFEST,
        "planned AS (SELECT shard_id, num_rows, ceil(num_rows / 4.0::DOUBLE)::BIGINT AS batches_per_epoch FROM manifest WHERE split = 'train')",
    )
    + """ SELECT shard_id, num_rows, batches_per_epoch, batches_per_epoch * 3 AS total_steps,
  floor(0.03::DOUBLE * (batches_per_epoch * 3))::BIGINT AS warmup_steps, batches_per_epoch * 3 > 0 AS has_schedule FROM planned""",
    "q_preprocess": with_(DOC_EXAMPLES, ratio_split("doc_id", "documents", 0.05, 4, 1))
    + " SELECT doc_id, split, shard_id, position, ids_md5, n_tokens, labels_md5 FROM examples JOIN sharded USING (doc_id)",
    "q_preprocess_pairs": with_(PAIR_EXAMPLES, ratio_split("conv_id, turn", "sft_pairs", 0.1, 3, 1))
    + " SELECT conv_id, turn, split, shard_id, position, ids_md5, n_tokens, labels_md5"
    " FROM examples JOIN sharded USING (conv_id, turn)",
    "q_log_cadence": with_(STEP_LOG) + " SELECT run_id, rank, step, event_id FROM step_log WHERE step % 50 = 0",
    "q_val_cadence": with_(STEP_LOG) + " SELECT run_id, rank, step, event_id FROM step_log WHERE step > 0 AND step % 20 = 0",
    "q_max_steps": with_(STEP_LOG)
    + " SELECT run_id, rank, max(step) AS last_step, sum(tokens)::BIGINT AS tokens FROM step_log WHERE step <= 100 GROUP BY ALL",
    "q_rank0_metrics": with_(STEP_LOG)
    + " SELECT run_id, rank, step, round(loss, 6) AS loss FROM step_log WHERE rank = 0 AND tokens % 7 <> 0",
    "q_step_metrics": with_(
        STEP_LOG.replace("step_log AS (", "full_log AS ("),
        """step_log AS (SELECT * REPLACE (CASE WHEN step % 5 <> 0 THEN loss END AS loss,
    CASE WHEN step % 11 = 0 THEN 'nan'::DOUBLE WHEN step % 7 <> 0 THEN duration END AS duration) FROM full_log)""",
    )
    + f""" SELECT run_id, rank, step, round({PERPLEXITY}, 4) AS perplexity, round(coalesce(duration, 0.0), 4) AS step_duration,
  round(CASE WHEN duration > 0 AND NOT isnan(duration) THEN 1.0 / duration ELSE 0.0 END, 4) AS steps_per_second,
  round(CASE WHEN duration > 0 AND NOT isnan(duration) THEN tokens / duration ELSE 0.0 END, 4) AS tokens_per_second,
  round(coalesce(grad_norm, 0.0), 6) AS grad_norm_payload FROM step_log""",
    "q_step_time_summary": with_(STEP_LOG)
    + """ SELECT run_id, rank, count(*) AS step_time_count, round(sum(coalesce(duration, 0.0)), 4) AS step_time_sum,
  round(avg(coalesce(duration, 0.0)), 6) AS step_time_mean FROM step_log GROUP BY run_id, rank""",
    "q_grad_norm": """WITH norms AS (SELECT label AS step,
    sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)
  SELECT step, round(sqrt(sum(norm * norm)), 6) AS grad_norm FROM norms GROUP BY step""",
    "q_val_mean": with_(
        EVENT_ROWS,
        "batches AS (SELECT rank AS run_id, event_id // 10 AS step, run_id AS metric, value FROM event_rows WHERE k % 10 <> 0)",
        "divisors AS (SELECT run_id, step, count(*) AS num_batches FROM batches GROUP BY ALL)",
    )
    + """ SELECT run_id, step, metric, round(sum(value) / any_value(num_batches), 6) AS mean, any_value(num_batches) AS num_batches
  FROM batches JOIN divisors USING (run_id, step) GROUP BY run_id, step, metric""",
    "q_cross_rank": with_(STEP_LOG)
    + """ SELECT run_id, step, sum(tokens)::BIGINT AS tokens, round(max(duration), 4) AS duration, round(avg(loss), 6) AS loss,
  count(*) AS ranks FROM step_log GROUP BY run_id, step""",
    "q_accum_loss": with_(EVENT_ROWS)
    + """ SELECT run_id, rank, event_id // 4 AS step, round(sum(value / 20.0 / 4), 6) AS loss
  FROM event_rows GROUP BY run_id, rank, event_id // 4""",
    "q_gauge_ffill": with_(STEP_LOG)
    + """ SELECT run_id, rank, step, round(coalesce(last_value(grad_norm IGNORE NULLS) OVER (PARTITION BY run_id, rank
  ORDER BY step ROWS UNBOUNDED PRECEDING), 0.0), 6) AS grad_norm_gauge FROM step_log""",
    "q_gauge_latest": with_(GAUGE_SAMPLES)
    + """ SELECT run_id, rank, metric, value FROM gauge_samples
  QUALIFY row_number() OVER (PARTITION BY run_id, rank, metric ORDER BY ts DESC, event_id DESC) = 1""",
    "q_scrape_5s": with_(GAUGE_SAMPLES)
    + """ SELECT run_id, rank, metric, time_bucket(INTERVAL 5 SECONDS, ts) AS window_start,
  arg_max(value, (ts, event_id)) AS value, count(*) AS samples FROM gauge_samples GROUP BY ALL""",
    "q_resource_ffill": with_(RESOURCE_SAMPLES)
    + " SELECT event_id, rank, "
    + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY rank ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0.0) AS {c}"
        for c in RESOURCE_OF_EVENT.values()
    )
    + " FROM resource_samples",
    "q_detect_rank": with_(EVENT_ROWS)
    + """ SELECT event_id, CASE WHEN k % 4 = 2 THEN rank WHEN k % 3 = 0 THEN user_id ELSE 0 END::BIGINT AS rank,
  CASE WHEN k % 2 = 0 THEN k ELSE 1 END::BIGINT AS world_size FROM event_rows""",
    "q_stream_preprocess": with_(DOC_EXAMPLES)
    + f""" SELECT doc_id, (('0x' || substr(md5('{SEED}|' || doc_id), 1, 8))::BIGINT % 8)::INTEGER AS shard_id,
  ids_md5, n_tokens, labels_md5 FROM examples""",
    "q_metrics_callback": with_(
        STEP_LOG,
        f"""sent AS (SELECT run_id, rank, step, loss, {PERPLEXITY} AS perplexity, coalesce(grad_norm, 0.0) AS grad_norm,
  coalesce(duration, 0.0) AS step_duration, CASE WHEN duration > 0 THEN 1.0 / duration ELSE 0.0 END AS steps_per_second,
  CASE WHEN duration > 0 THEN tokens / duration ELSE 0.0 END AS tokens_per_second FROM step_log WHERE rank = 0)""",
    )
    + " " + " UNION ALL ".join(
        f"SELECT run_id, rank, step, '{name}' AS metric, round({name}, 4) AS value FROM sent"
        for name in ("loss", "perplexity", "grad_norm", "step_duration", "steps_per_second", "tokens_per_second")
    ),
}
ORACLE["q_stream_scrape_late"] = with_(GAUGE_SAMPLES) + """,
span AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS middle, (max(epoch_us(ts)) // 1000 - 60000) * 1000 AS mark FROM gauge_samples),
held AS (SELECT g.*, time_bucket(INTERVAL 5 SECONDS, ts) AS window_start,
    epoch_us(ts) > middle OR epoch_us(time_bucket(INTERVAL 5 SECONDS, ts)) + 5000000 > mark AS seen FROM gauge_samples g, span)
SELECT run_id, rank, metric, window_start, arg_max(value, (ts, event_id)) FILTER (seen) AS value,
  count(*) FILTER (seen) AS samples, count(*) FILTER (NOT seen) AS lost FROM held GROUP BY run_id, rank, metric, window_start"""
ORACLE["q_snapshot_rewrite"] = (
    with_(DOC_EXAMPLES, ordered_docs("documents", 6, "six"), ordered_docs("documents", 4, "four"))
    + """, placed AS (SELECT 'pinned' AS reader, * FROM six UNION ALL SELECT 'newest', * FROM four
  UNION ALL SELECT 'newest', * FROM six WHERE shard_id >= 4)
  SELECT reader, shard_id, position, ids_md5, n_tokens, labels_md5 FROM examples JOIN placed USING (doc_id)"""
)
ORACLE["q_stream_slots"] = (
    with_(DOC_EXAMPLES)
    + f""", placed AS (SELECT doc_id, (('0x' || substr(md5('{SEED}|' || doc_id), 1, 8))::BIGINT % 8)::INTEGER AS shard_id,
    ('0x' || substr(md5('{SEED}|' || doc_id), 9, 8))::BIGINT % 4 AS file FROM documents)
  SELECT doc_id, shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY doc_id % 3, file, doc_id) - 1 AS slot,
    ids_md5, n_tokens, labels_md5 FROM examples JOIN placed USING (doc_id)"""
)
ORACLE["q_split_slices"] = """WITH d AS (SELECT doc_id, lang, md5(text) AS text_md5, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p,
    count(*) OVER (PARTITION BY lang) AS n FROM documents),
  k AS (SELECT *, CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS part FROM d
    WHERE (lang = 'fr' AND p < round_even(10 * n / 100.0::DOUBLE, 0)) OR (lang = 'de' AND p >= 5 AND p < 15) OR (lang = 'en' AND p >= n - 20))
  SELECT row_number() OVER (ORDER BY part, p) - 1 AS position, lang, doc_id, text_md5 FROM k"""
ORACLE["q_val_hook"] = with_(DOC_EXAMPLES, ratio_split("doc_id", "documents", 0.1, 3, 2)) + f""",
  val_rows AS (SELECT shard_id, (position - shard_id * ceil(total / 2.0::DOUBLE)::BIGINT) // 16 AS batch, n, p
    FROM padded JOIN sharded USING (doc_id), (SELECT count(*) AS total FROM sharded WHERE split = 'val') WHERE split = 'val'),
  batches AS (SELECT shard_id, batch, sum(n)::DOUBLE AS tokens, sum({LENGTH} - p)::DOUBLE AS unmasked FROM val_rows GROUP BY ALL HAVING count(*) = 16),
  means AS (SELECT shard_id, avg(tokens) AS tokens, avg(unmasked) AS unmasked, count(*) AS num_batches FROM batches GROUP BY ALL)
  SELECT shard_id, 'tokens' AS metric, tokens AS mean, num_batches FROM means UNION ALL SELECT shard_id, 'unmasked', unmasked, num_batches FROM means"""
ORACLE["q_scrape_standing"] = with_(GAUGE_SAMPLES) + """, w AS (
  SELECT run_id, rank, metric, time_bucket(INTERVAL 5 SECOND, ts) AS window_start, arg_max(value, (ts, event_id)) AS value, count(*) AS samples
  FROM gauge_samples GROUP BY ALL),
ends AS (SELECT run_id, rank, max(window_start) AS last FROM w GROUP BY ALL),
ticks AS (SELECT run_id, rank, metric, unnest(generate_series(first, last, INTERVAL 5 SECOND)) AS window_start
  FROM (SELECT run_id, rank, metric, min(window_start) AS first FROM w GROUP BY ALL) JOIN ends USING (run_id, rank)),
read AS (SELECT run_id, rank, metric, window_start,
  last_value(value IGNORE NULLS) OVER (PARTITION BY run_id, rank, metric ORDER BY window_start) AS value, coalesce(samples, 0) AS samples
FROM ticks LEFT JOIN w USING (run_id, rank, metric, window_start))
SELECT run_id, rank, metric, date_trunc('hour', window_start)::TIMESTAMP AS hour, count(*) AS scrapes, sum(samples)::BIGINT AS samples,
  min(value) AS least, max(value) AS most, arg_max(value, window_start) AS last FROM read GROUP BY ALL"""
ORACLE["q_log_records"] = with_(STEP_LOG) + """ SELECT date_trunc('milliseconds', ts) AS ts,
  CASE WHEN loss > 5 THEN 'WARNING' ELSE 'INFO' END AS level, rank, 3::INTEGER AS world_size, run_id AS process,
  '[step ' || step || '] train_loss=' || printf('%.4f', loss)
    || CASE WHEN grad_norm IS NOT NULL THEN ' grad_norm=' || printf('%.4f', grad_norm) ELSE '' END AS message,
  CASE WHEN step % 5 = 0 THEN '  step: more' END AS body FROM step_log"""


def _mixed(half: str, key: str, size: str) -> str:
    y = f"(({half} % 2147483647 * 1103515245 + {key}) % 2147483647)"
    return f"((({y} * {y} + {key}) % 2147483647) * 268435456 // 2147483647 % {size})"


# The network step by step; a row that leaves its shard's places starts over from where it stands.
EPOCH_PERMUTATION = f"""RECURSIVE n AS (SELECT count(*) AS total, ceil(count(*) / 4.0::DOUBLE)::BIGINT AS size FROM documents),
counts AS (SELECT s AS shard_id, greatest(0, least(total, (s + 1) * size) - s * size) AS m FROM n, range(4) t(s)),
roots AS (SELECT shard_id, m, floor(sqrt(m - 1))::BIGINT + 1 AS r FROM counts WHERE m > 0),
grids AS (SELECT shard_id, m, arg_min(w, ((m + w - 1) // w * w - m, w)) AS width
  FROM (SELECT shard_id, m, unnest(range(r, r + least(65536, r))) AS w FROM roots) GROUP BY ALL),
sides AS (SELECT shard_id, m, width, (m + width - 1) // width AS height FROM grids),
keys AS (SELECT epoch, turn, ('0x' || substr(md5('{SEED}|' || epoch || '|' || turn), 1, 7))::BIGINT AS key FROM range(3) e(epoch), range(6) t(turn)),
walk AS (
  SELECT epoch, (doc_id // size)::INTEGER AS shard_id, doc_id, 0::BIGINT AS turn,
    (doc_id % size) // width AS a, (doc_id % size) % width AS b
  FROM documents, n, range(3) e(epoch) JOIN sides ON sides.shard_id = doc_id // size
  UNION ALL
  SELECT w.epoch, w.shard_id, doc_id, w.turn % 6 + 1,
    CASE WHEN w.turn % 2 = 0 THEN (a + {_mixed("b", "key", "height")}) % height ELSE a END,
    CASE WHEN w.turn % 2 = 1 THEN (b + {_mixed("a", "key", "width")}) % width ELSE b END
  FROM walk w JOIN sides USING (shard_id) JOIN keys k ON k.epoch = w.epoch AND k.turn = w.turn % 6
  WHERE w.turn < 6 OR a * width + b >= m),
placed AS (SELECT epoch::INTEGER AS epoch, shard_id, doc_id, a * width + b AS rn
  FROM walk JOIN sides USING (shard_id) WHERE turn = 6 AND a * width + b < m)"""
ORACLE["q_epoch_permutation"] = f"WITH {EPOCH_PERMUTATION} SELECT epoch, shard_id, doc_id, rn, rn // 12 AS batch_id FROM placed"
ORACLE["q_epoch_batch"] = f"""WITH {EPOCH_PERMUTATION} SELECT epoch, (rn % 12)::INTEGER AS row_in_batch, doc_id FROM placed
  WHERE shard_id = 1 AND rn // 12 = 2"""
ORACLE["q_stream_scrape_triggers"] = f"SELECT *, 0::BIGINT AS lost FROM ({ORACLE['q_scrape_5s']})"
ORACLE["q_gauge_ffill_sliced"] = ORACLE["q_gauge_ffill"]
ORACLE["q_stream_scrape"] = ORACLE["q_scrape_5s"]
