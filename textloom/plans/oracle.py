"""SQL that states what the core queries compute."""

from __future__ import annotations

CLS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{CLS}', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{CLS}|{CLS}$', '', 'g')"


def _clean(x: str) -> str:
    return _ws(f"replace(translate({_ws(x)}, '_()', ''), 'viz.', 'namely')")


_TOKENS = f"""t AS (SELECT doc_id, CASE WHEN c = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(c, ' ') END AS toks
  FROM (SELECT doc_id, {_clean("text")} AS c FROM documents WHERE text IS NOT NULL))"""
_WINDOWS = f"""{_TOKENS},
 w AS (SELECT doc_id, k AS win, toks[k * 23 + 1 : k * 23 + 63] AS toks
  FROM (SELECT doc_id, toks, unnest(range(0, 1 + greatest(0, CAST(ceil((len(toks) - 63) / 23.0) AS BIGINT)))) AS k FROM t))"""
_LATEST = """m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step, split ORDER BY ingested_at DESC NULLS LAST, epoch DESC NULLS LAST, loss DESC NULLS LAST,
  ntp_loss DESC NULLS LAST, kd_loss DESC NULLS LAST, perplexity DESC NULLS LAST, learning_rate DESC NULLS LAST, logged_at DESC NULLS LAST) AS rn FROM metrics) WHERE rn = 1)"""
_CHECKPOINTS = "c AS (SELECT run_id, file_name, epoch, max(val_loss) AS val_loss FROM checkpoints GROUP BY ALL)"
_TRAIN = f"""{_LATEST}, f AS (SELECT run_id, epoch, step, {", ".join(f"CASE WHEN NOT isnan({c}) AND abs({c}) <= 1e6 THEN {c} END AS {c}" for c in ("loss", "ntp_loss", "kd_loss"))} FROM m WHERE split = 'train')"""


def _finite(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) AND abs({c}) <= 100 THEN {c} END AS {c}"


def _permutation(table: str, ids: str, seed: int) -> str:
    return f"SELECT {ids}, row_number() OVER (ORDER BY md5(concat_ws('-', '{seed}', {ids})), {ids}) - 1 AS pos FROM {table}"


def _lse(x: str) -> str:
    return f"(ln(list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))) + list_max({x}))"


_LOGITS = f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z, label FROM embeddings),
 p AS (SELECT a.vec_id, a.label, a.z AS s, b.z AS t, {_lse("a.z")} AS ls, {_lse("b.z")} AS lt FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
 x AS (SELECT vec_id, label, ls - s[label + 1] AS ntp, list_sum(list_transform(list_zip(s, t), lambda v: exp(v[2] - lt) * ((v[2] - lt) - (v[1] - ls)))) AS kd FROM p)"""
_JSON = "length(CAST(to_json({'text': coalesce(text, '')}) AS VARCHAR)) + 1"


def oracle_sql() -> dict[str, str]:
    return {
        "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
        "strip_boilerplate": """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
 e AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: contains(x, '*** END OF') AND NOT contains(x, '*** START OF')), true), 0) AS e FROM l),
 h AS (SELECT *, CASE WHEN e = 0 THEN l WHEN e = 1 THEN CAST([] AS VARCHAR[]) ELSE l[1 : e - 1] END AS h FROM e),
 p AS (SELECT *, coalesce(list_position(list_reverse(list_transform(h, lambda x: contains(x, '*** START OF'))), true), 0) AS p FROM h)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN p = 0 THEN coalesce(array_to_string(h, chr(10)), '') WHEN p = 1 THEN '' ELSE array_to_string(h[len(h) - p + 2 :], chr(10)) END AS body FROM p""",
        "length_filter": f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE text <> '' AND length({_strip('text')}) > 1000",
        "abbrev_cleanup": f"""WITH c AS (SELECT doc_id, {_clean("text")} AS c FROM documents WHERE contains(text, 'viz.') OR contains(text, '_'))
SELECT doc_id, length(c) AS n_chars, CAST((length(c) - length(replace(c, 'namely', ''))) // 6 AS BIGINT) AS n_namely FROM c""",
        "display_prefix": "SELECT doc_id, left(text, 100) AS shown FROM documents",
        "line_counts": """SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
 CAST(len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '*** START OF') OR contains(x, '*** END OF'))) AS BIGINT) AS n_marked FROM documents WHERE text IS NOT NULL""",
        "sliding_windows": f"WITH {_WINDOWS} SELECT doc_id, win, CAST(len(toks) AS BIGINT) AS n_tokens, md5(coalesce(array_to_string(toks, ' '), '')) AS digest FROM w",
        "window_padding": f"""WITH {_WINDOWS}, i AS (SELECT doc_id, win, len(toks) + 1 AS n, list_concat(list_concat(['<s>'], toks), list_transform(range(0, 63 - len(toks)), lambda x: '</s>')) AS ids FROM w)
SELECT doc_id, win, CAST(len(ids) AS BIGINT) AS width, CAST(n AS BIGINT) AS n_real, md5(array_to_string(ids, ' ')) AS ids_digest, true AS labels_equal FROM i""",
        "vocabulary": f"""WITH {_TOKENS}, v AS (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM t) WHERE token <> '' GROUP BY token)
SELECT token, CAST(row_number() OVER (ORDER BY token) + 1 AS BIGINT) AS token_id, n FROM v""",
        "token_totals": f"WITH {_WINDOWS} SELECT count(*) AS n_windows, CAST(coalesce(sum(len(toks)), 0) AS BIGINT) AS n_window_tokens, count(DISTINCT doc_id) AS n_docs FROM w",
        "split_windows_90_10": f"""WITH {_WINDOWS}, p AS ({_permutation("w", "doc_id, win", 42)})
SELECT doc_id, win, CASE WHEN pos < floor(0.9::DOUBLE * (SELECT count(*) FROM w)) THEN 'train' ELSE 'val' END AS split FROM p""",
        "split_fixed_test": f"WITH p AS ({_permutation('documents', 'doc_id', 42)}) SELECT doc_id, CASE WHEN pos < 2 THEN 'test' ELSE 'train' END AS split FROM p",
        "epoch_shuffle": _permutation("documents", "doc_id", 43),
        "shard_wraparound": f"""WITH p AS ({_permutation("documents", "doc_id", 42)}), n AS (SELECT count(*) AS n FROM documents),
 a AS (SELECT doc_id, pos FROM p UNION ALL SELECT doc_id, pos + n FROM p, n WHERE pos < (n + 2) // 3 * 3 - n)
SELECT doc_id, pos AS shard_pos, pos % 3 AS rank, pos // 3 // 4 AS batch FROM a""",
        "validation_shards": """WITH p AS (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS pos FROM examples), n AS (SELECT count(*) AS n FROM examples),
 a AS (SELECT example_id, pos FROM p UNION ALL SELECT example_id, pos + n FROM p, n WHERE pos < (n + 6) // 7 * 7 - n)
SELECT pos % 7 AS rank, count(*) AS n_rows, max(pos // 7 // 4) AS last_batch, CAST(sum(example_id) AS BIGINT) AS id_sum FROM a GROUP BY 1""",
        "batches": """WITH p AS (SELECT *, row_number() OVER (ORDER BY example_id) - 1 AS pos FROM examples), n AS (SELECT count(*) AS n FROM examples),
 a AS (SELECT example_id, input_ids, attention_mask, pos FROM p UNION ALL SELECT example_id, input_ids, attention_mask, pos + n FROM p, n WHERE pos < (n + 1) // 2 * 2 - n)
SELECT pos % 2 AS rank, pos // 2 // 4 AS batch, count(*) AS size, string_agg(CAST(example_id AS VARCHAR), ',' ORDER BY pos) AS example_ids,
 CAST(sum(list_sum(input_ids)) AS BIGINT) AS id_sum, CAST(sum(list_sum(attention_mask)) AS BIGINT) AS n_real FROM a GROUP BY 1, 2""",
        "example_tokens": """SELECT example_id, CAST(list_sum(attention_mask) AS BIGINT) AS n_real, CAST(len(list_filter(input_ids, lambda x: x <> 50256)) AS BIGINT) AS n_without_pad,
 CASE WHEN labels IS NOT NULL THEN md5(coalesce(array_to_string(labels[2:], ','), '')) END AS targets_digest FROM examples""",
        "prompt_split": """WITH b AS (SELECT example_id // 4 AS batch, example_id, input_ids, attention_mask, row_number() OVER (PARTITION BY example_id // 4 ORDER BY example_id) AS rn FROM examples),
 h AS (SELECT batch, CAST(list_sum(attention_mask) // 2 AS BIGINT) AS half FROM b WHERE rn = 1),
 s AS (SELECT batch, example_id, CASE WHEN half = 0 THEN CAST([] AS INTEGER[]) ELSE input_ids[1 : half] END AS p, list_filter(input_ids[half + 1 :], lambda x: x <> 50256) AS g FROM b JOIN h USING (batch) WHERE rn <= 2)
SELECT batch, example_id, CAST(len(p) AS BIGINT) AS n_prompt, CAST(len(g) AS BIGINT) AS n_truth, md5(coalesce(array_to_string(p, ','), '')) AS prompt_digest, md5(coalesce(array_to_string(g, ','), '')) AS truth_digest FROM s""",
        "html_titles_links": f"""SELECT bookshelf_id, page_index, id, {_strip("title")} AS title, coalesce({_strip("author")}, 'Unknown') AS author, 'https://books.shelf.example/ebooks/' || id AS url, count(*) AS n
FROM catalogue WHERE title IS NOT NULL AND id IS NOT NULL GROUP BY ALL""",
        "page_scan": """WITH l AS (SELECT bookshelf_id, page_index, count(*) AS n FROM catalogue GROUP BY ALL), t AS (SELECT bookshelf_id, max(page_index) AS top FROM l GROUP BY 1),
 p AS (SELECT bookshelf_id, unnest(range(0, top + 2)) AS page_index FROM t), c AS (SELECT p.bookshelf_id, p.page_index, coalesce(n, 0) AS n_items FROM p LEFT JOIN l USING (bookshelf_id, page_index)),
 s AS (SELECT bookshelf_id, min(page_index) AS stop FROM c WHERE n_items = 0 GROUP BY 1)
SELECT bookshelf_id, CAST(page_index AS BIGINT) AS page_index, n_items, 'https://books.shelf.example/ebooks/bookshelf/' || bookshelf_id || CASE WHEN page_index > 0 THEN '?start_index=' || (page_index * 25 + 1) ELSE '' END AS url
FROM c JOIN s USING (bookshelf_id) WHERE page_index < stop""",
        "book_links": "SELECT string_split(url, '/')[-1] AS linked_id, coalesce(author, 'Unknown') AS author, count(*) AS n FROM catalogue GROUP BY ALL",
        "catalog_text_join": """WITH c AS (SELECT DISTINCT bookshelf_id, id FROM catalogue WHERE title IS NOT NULL)
SELECT c.bookshelf_id, c.id, count(*) AS n_texts, CAST(sum(length(d.text)) AS BIGINT) AS n_chars FROM c JOIN documents d ON c.id = d.book_id WHERE d.text <> '' GROUP BY ALL""",
        "text_fallback": """WITH d AS (SELECT book_id, arg_min(text, doc_id) AS other FROM documents WHERE book_id IS NOT NULL AND text <> '' GROUP BY 1)
SELECT rec_id, length(coalesce(text, other)) AS n_chars FROM corpus_records LEFT JOIN d ON id = book_id""",
        "json_offsets": f"""WITH l AS (SELECT rec_id, file_path, text, {_JSON} AS n FROM corpus_records),
 s AS (SELECT *, CAST(coalesce(sum(n + 1) OVER (PARTITION BY file_path ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_position FROM l)
SELECT rec_id, file_path, start_position, CAST(start_position + n AS BIGINT) AS end_position, length(coalesce(text, '')) AS text_length FROM s""",
        "shelf_metadata": f"""WITH l AS (SELECT *, lower(trim(split)) AS sp, {_JSON} AS n FROM corpus_records),
 s AS (SELECT *, CAST(coalesce(sum(n + 1) OVER (PARTITION BY file_path ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM l)
SELECT bookshelf_id, sp AS split, file_path, count(*) AS num_books, CAST(sum(strlen(CAST(to_json({{'text': text}}) AS VARCHAR)) + 2) AS BIGINT) AS total_chars,
 md5(string_agg(concat_ws(',', id, st, CAST(st + n AS BIGINT), length(text)), ';' ORDER BY rec_id)) AS books_digest FROM s WHERE text <> '' GROUP BY 1, 2, 3""",
        "corpus_metadata": """SELECT bookshelf_id, lower(trim(split)) AS split, count(*) AS num_books, CAST(sum(strlen(CAST(to_json({'text': text}) AS VARCHAR)) + 2) AS BIGINT) AS total_chars, CAST(sum(length(text)) AS BIGINT) AS text_chars
FROM corpus_records WHERE text <> '' GROUP BY ALL""",
        "jsonl_round_trip": "SELECT md5(text) AS digest, count(*) AS n FROM corpus_records WHERE text <> '' GROUP BY 1",
        "json_lists": "SELECT id, title, author, url, count(*) AS n FROM catalogue GROUP BY ALL",
        "cached_examples": "SELECT example_id, CAST(len(input_ids) AS BIGINT) AS n_ids, CAST(list_sum(attention_mask) AS BIGINT) AS n_real FROM examples",
        "logged_metrics": "SELECT run_id, split, count(*) AS n, max(step) AS last_step FROM metrics WHERE split IN ('train', 'val') GROUP BY ALL",
        "sample_records": """WITH b AS (SELECT example_id, input_ids, CAST(list_sum(attention_mask) // 2 AS BIGINT) AS half, row_number() OVER (PARTITION BY example_id // 64 ORDER BY example_id) AS rn FROM examples)
SELECT example_id, CAST(1 AS BIGINT) AS epoch, CAST(500 AS BIGINT) AS step, md5(coalesce(array_to_string(CASE WHEN half = 0 THEN CAST([] AS INTEGER[]) ELSE input_ids[1 : half] END, ' '), '')) AS prompt,
 md5(coalesce(array_to_string(list_filter(input_ids[half + 1 :], lambda x: x <> 50256), ' '), '')) AS ground_truth FROM b WHERE rn = 1""",
        "fetch_attempts": """WITH a AS (SELECT user_id % 50 AS bookshelf_id, event_id, CASE WHEN event_type = 'error' OR value < 20 THEN 1 ELSE 0 END AS failed FROM events),
 b AS (SELECT *, coalesce(sum(failed) OVER (PARTITION BY bookshelf_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT bookshelf_id, count(*) AS n_attempts, count(CASE WHEN failed = 0 THEN 1 END) AS n_pages FROM b WHERE before < 5 GROUP BY 1""",
        "causal_positions": """WITH p AS (SELECT input_ids, labels, unnest(range(1, len(labels))) AS i FROM examples WHERE labels IS NOT NULL AND len(labels) = len(input_ids))
SELECT CAST(input_ids[i] AS BIGINT) AS token, CAST(labels[i + 1] AS BIGINT) AS label, count(*) AS n, min(i - 1) AS first_pos FROM p GROUP BY 1, 2""",
        "decoded_tokens": """SELECT example_id, md5(coalesce(array_to_string(list_transform(list_filter(list_transform(input_ids, lambda x: x % 5), lambda x: x > 1), lambda x: ['<s>', '</s>', 'one', 'two', 'three'][x + 1]), ' '), '')) AS digest FROM examples""",
        "checkpoint_names": """WITH n AS (SELECT run_id, CASE WHEN is_best THEN 'best_model.pt' ELSE 'checkpoint_epoch_' || (epoch + 1) || '.pt' END AS name, count(*) AS n FROM checkpoints GROUP BY 1, 2),
 r AS (SELECT run_id, CAST(max(epoch) + 1 AS BIGINT) AS epochs_run FROM checkpoints GROUP BY 1) SELECT * FROM n JOIN r USING (run_id)""",
        "rank_losses": """WITH p AS (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS pos FROM examples), n AS (SELECT count(*) AS n FROM examples),
 a AS (SELECT example_id, pos FROM p UNION ALL SELECT example_id, pos + n FROM p, n WHERE pos < (n + 2) // 3 * 3 - n)
SELECT 'global' AS scope, count(*) AS n, CAST(sum(example_id) AS BIGINT) AS id_sum, count(CASE WHEN pos % 3 = 0 THEN 1 END) AS n_leading FROM a
UNION ALL SELECT 'rank0', count(*), CAST(sum(example_id) AS BIGINT), count(*) FROM a WHERE pos % 3 = 0""",
        "file_parts": "SELECT regexp_replace(file_path, '/[^/]*$', '') AS folder, string_split(file_path, '/')[-1] AS file, count(*) AS n FROM corpus_records GROUP BY ALL",
        "kl_batchmean": f"WITH {_LOGITS} SELECT vec_id, round(kd, 6) AS kl FROM x",
        "cross_entropy": f"WITH {_LOGITS} SELECT label, count(*) AS positions, count(CASE WHEN label <> 0 THEN 1 END) AS targets, round(coalesce(avg(CASE WHEN label <> 0 THEN ntp END), -1.0), 6) AS ntp_loss FROM x GROUP BY 1",
        "combined_loss": f"""WITH {_LOGITS} SELECT count(*) AS positions, count(CASE WHEN label <> 0 THEN 1 END) AS targets, round(avg(CASE WHEN label <> 0 THEN ntp END), 6) AS ntp_loss, round(avg(kd), 6) AS kd_loss,
 round(0.5 * avg(kd) + 0.5 * avg(CASE WHEN label <> 0 THEN ntp END), 6) AS loss FROM x""",
        "softmax_mass": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings), l AS (SELECT vec_id, z, {_lse("z")} AS l FROM e),
 p AS (SELECT vec_id, list_transform(z, lambda v: exp(v - l)) AS p FROM l) SELECT vec_id, round(list_max(p), 6) AS most, round(list_sum(p), 6) AS mass FROM p""",
        "latest_metrics": f"WITH {_LATEST} SELECT run_id, split, count(*) AS n_steps, max(step) AS last_step, strftime(max(ingested_at AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S.%f') AS last_ingested FROM m GROUP BY ALL",
        "eval_metrics": f"""WITH {_LATEST}, f AS (SELECT run_id, step, {_finite("loss")}, {_finite("ntp_loss")}, {_finite("kd_loss")} FROM m WHERE split = 'val'),
 b AS (SELECT run_id, avg(loss) AS loss, avg(ntp_loss) AS ntp_loss, avg(kd_loss) AS kd_loss FROM f GROUP BY run_id, step // 500)
SELECT run_id, count(*) AS batches, round(avg(loss), 9) AS loss, round(avg(ntp_loss), 9) AS ntp_loss, round(avg(kd_loss), 9) AS kd_loss, round(exp(avg(loss)), 9) AS perplexity FROM b GROUP BY 1""",
        "capped_eval": f"""WITH {_LATEST}, f AS (SELECT run_id, {_finite("loss")} FROM m WHERE split = 'val' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step) <= 12)
SELECT run_id, count(*) AS batches, round(avg(loss), 9) AS loss, round(exp(avg(loss)), 9) AS perplexity FROM f GROUP BY 1""",
        "grad_accum": f"""WITH {_TRAIN}, i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS i FROM f)
SELECT run_id, i // 4 AS optimizer_step, round(loss / 4, 9) AS loss, round(ntp_loss / 4, 9) AS ntp_loss, round(kd_loss / 4, 9) AS kd_loss FROM i WHERE i % 4 = 3""",
        "epoch_means": f"""WITH {_TRAIN}, i AS (SELECT *, row_number() OVER (PARTITION BY run_id, epoch ORDER BY step) - 1 AS i FROM f)
SELECT run_id, epoch, count(*) AS n_steps, round(avg(loss / 4), 9) AS mean_loss, round(avg(ntp_loss / 4), 9) AS mean_ntp_loss, round(avg(kd_loss / 4), 9) AS mean_kd_loss FROM i WHERE i % 4 = 3 GROUP BY 1, 2""",
        "global_steps": f"WITH {_LATEST} SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step) // 4 AS global_step FROM m WHERE split = 'train'",
        "best_so_far": f"""WITH {_CHECKPOINTS}, b AS (SELECT *, min(CASE WHEN NOT isnan(val_loss) THEN val_loss END) OVER (PARTITION BY run_id ORDER BY epoch, file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM c)
SELECT run_id, epoch, file_name, best_before, coalesce(NOT isnan(val_loss) AND (best_before IS NULL OR val_loss < best_before), false) AS improved FROM b""",
        "best_value": f"""WITH {_CHECKPOINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, epoch) AS rn FROM c WHERE val_loss IS NOT NULL AND NOT isnan(val_loss))
SELECT run_id, val_loss AS best, epoch AS best_epoch FROM r WHERE rn = 1""",
        "checkpoint_retention": f"""WITH {_CHECKPOINTS}, k AS (SELECT run_id, file_name, starts_with(file_name, 'checkpoint') AS is_cp, TRY_CAST(nullif(regexp_extract(file_name, '(\\d+)', 1), '') AS BIGINT) AS num FROM c)
SELECT run_id, file_name, NOT is_cp OR dense_rank() OVER (PARTITION BY run_id, is_cp ORDER BY file_name DESC) <= 1 AS kept_by_name,
 NOT is_cp OR dense_rank() OVER (PARTITION BY run_id, is_cp ORDER BY num DESC NULLS LAST, file_name DESC) <= 1 AS kept_by_number FROM k""",
        "lr_schedule": "SELECT s AS step, round(0.001::DOUBLE * CASE WHEN s < 100 THEN s / 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, (1000.0::DOUBLE - s) / 900.0::DOUBLE) END, 9) AS lr FROM (SELECT unnest(range(0, 1001, 50)) AS s)",
        "step_triggers": f"""WITH {_LATEST} SELECT run_id, count(CASE WHEN step % 200 = 0 THEN 1 END) AS n_eval, count(CASE WHEN step % 500 = 0 THEN 1 END) AS n_samples, count(CASE WHEN step // 4 < 250 THEN 1 END) AS n_capped, count(*) AS n FROM m GROUP BY 1""",
        "run_name": "SELECT strftime(logged_at AT TIME ZONE 'UTC', '%Y%m%d_%H%M%S') AS stamp, count(*) AS n FROM metrics GROUP BY 1",
        "env_filter": "SELECT event_type, count(*) AS n FROM events WHERE contains(lower(event_type), 'click') OR contains(lower(event_type), 'pur') GROUP BY 1",
        "model_shrink": "SELECT size, factor, greatest(1, size // factor) AS shrunk FROM (SELECT unnest(range(0, 33)) AS size), (SELECT unnest(range(1, 9)) AS factor)",
    }
