"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..operators.stats import POISSON
from .queries import MARKS

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OPENS = " OR ".join(f"starts_with(first, '{p}')" for p in ("Sure", "Here", "Abstract", "Title", "I''m happy to help", "Certainly"))


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def _clean(table: str, key: str, more: str = "") -> str:
    """CTEs up to ``cleaned``: key, more, text, clean, words."""
    return f"""
    think AS (
      SELECT {key} {more}, text AS raw,
             CASE WHEN contains(text, '</think>') THEN {_strip("split_part(text, '</think>', 2)")} ELSE text END AS t FROM {table}),
    lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE[1:-1]}]')) AS l FROM think),
    head AS (SELECT *, regexp_replace(coalesce(l[1], ''), '^[^a-zA-Z0-9]*', '') AS first FROM lines),
    cut AS (SELECT *, CASE WHEN len(l) > 1 AND ({_OPENS}) THEN array_to_string(l[2:], chr(10)) ELSE t END AS body FROM head),
    spaced AS (SELECT *, {_squeeze("lower(body)")} AS clean FROM cut),
    cleaned AS (SELECT {key} {more}, raw, clean, CASE WHEN coalesce(clean, '') = '' THEN [] ELSE string_split(clean, ' ') END AS words FROM spaced)"""


def _windows(key: str, more: str = "") -> str:
    return f"""
    starts AS (SELECT *, unnest(range(0, len(words), 350)) AS s FROM cleaned),
    windows AS (
      SELECT {key} {more}, CAST(s // 350 AS INTEGER) AS idx, array_to_string(words[s + 1 : s + 350], ' ') AS wtext,
             CAST(least(350, len(words) - s) AS INTEGER) AS wn, CAST(s AS INTEGER) AS word_start,
             CAST(least(s + 350, len(words)) AS INTEGER) AS word_end
      FROM starts)"""


def _band(score: str) -> str:
    return f"""CASE WHEN {score} < 0.30 THEN 'human' WHEN {score} < 0.55 THEN 'lightly edited' WHEN {score} < 0.75 THEN 'moderately edited'
        WHEN {score} < 0.90 THEN 'heavily edited' ELSE 'fully AI' END"""


def _r4(x: str) -> str:
    """Four places of the exact binary value, halves to even."""
    return f"CAST(format('{{:.4f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def _chunks(key: str, scale: int, most: int = 2400) -> str:
    """CTE ``chunks``: of a window with share s of the scale; confidence and cut as the varied stub gives them."""
    return f"""
    raw_scores AS (SELECT *, least(1.0, CAST(length(wtext) AS DOUBLE) / {scale}.0) AS s FROM windows),
    chunks AS (SELECT *, {_r4("s")} AS score, {_band("s")} AS cband, {_r4("wn / 400.0::DOUBLE")} AS varied, length(wtext) > {most} AS cut FROM raw_scores)"""


def _results(key: str, more: str = "") -> str:
    """CTE ``results``: key, more, score (4 places), agg, band, bucket, n_words, n_chunks, reliable, confidence, top_index, top."""
    return f"""
    sums AS (SELECT {key}, sum(score * wn ORDER BY idx) / sum(wn) AS agg, count(*) AS n_chunks, max(score) AS top,
                    sum(varied * wn ORDER BY idx) / sum(wn) AS sure, bool_or(cut) AS cut,
                    min(struct_pack(a := -score, b := idx)).b AS top_index FROM chunks GROUP BY {key}),
    results AS (
      SELECT c.* EXCLUDE (words), {_r4("coalesce(agg, 0.0)")} AS score, coalesce(agg, 0.0) AS agg,
             CASE WHEN len(words) >= 50 THEN {_band("agg")} ELSE 'unreliable' END AS band,
             CAST(round_even(coalesce(agg, 0.0) * 3, 0) AS INTEGER) AS bucket, CAST(len(words) AS INTEGER) AS n_words,
             CAST(coalesce(n_chunks, 0) AS INTEGER) AS n_chunks, len(words) >= 50 AS reliable,
             CASE WHEN n_chunks IS NULL THEN 0.0 ELSE 0.9 END AS confidence, {_r4("coalesce(sure, 0.0)")} AS varied, coalesce(cut, false) AS cut,
             top_index, top
      FROM cleaned c LEFT JOIN sums USING ({key}))"""


def _detected(scale: int = 10_000, table: str = "documents", key: str = "doc_id", more: str = "", most: int = 2400) -> str:
    return ",".join([_clean(table, key, more), _windows(key, more), _chunks(key, scale, most), _results(key, more)])


def _scored() -> str:
    """CTE ``scored`` of labeled documents."""
    docs = "docs AS (SELECT doc_id, text, n_chars, quality * 2 + toxic AS gt FROM documents JOIN labels USING (doc_id))"
    return f"""{docs}, {_detected(2_500, "docs", "doc_id", ", n_chars, gt")},
    scored AS (SELECT doc_id AS sample_id, gt AS gt_bucket, score AS model_score, bucket AS model_bucket, n_chars % 97 / 97.0 AS cosine_score,
                      reliable, n_words, agg FROM results)"""


def _describe(x: str) -> str:
    q = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    quantiles = {k: f"round(quantile_cont({x}, {p}), 9) AS {k}" for k, p in q.items()}
    return (
        f"count({x}) AS n, round(min({x}), 9) AS min, {quantiles['q25']}, {quantiles['median']}, round(avg({x}), 9) AS mean, "
        f"{quantiles['q75']}, {quantiles['q90']}, round(max({x}), 9) AS max"
    )


_DOCS = f"WITH {_clean('documents', 'doc_id')}, {_windows('doc_id')}"
_LOGITS = """WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
    e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM l),
    p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"""
_SCORE = "list_sum(list_transform(p, lambda x, i: x * (i - 1))) / (len(p) - 1)"
_CONFIDENCE = "1 + list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-9)))) / ln(len(p)::DOUBLE)"
_TOP = "CAST(list_position(p, list_max(p)) - 1 AS INTEGER)"
_SIMPLE = "WITH s AS (SELECT doc_id, least(n_chars, 6000) / 6000.0 AS score FROM documents)"
_TURNS = f"WITH {_clean('conversations', 'conv_id, turn')}, {_windows('conv_id, turn')}, {_chunks('conv_id, turn', 1000)}, {_results('conv_id, turn')}"
_DELTA = """deltas AS (SELECT *, CASE WHEN turn <> min(turn) OVER g
    THEN (score - first_value(score) OVER (PARTITION BY conv_id ORDER BY turn)) * 100 END AS delta FROM results WINDOW g AS (PARTITION BY conv_id))"""
_SIGNED = """CASE WHEN delta IS NULL THEN '' ELSE (CASE WHEN delta >= 0 THEN '+' WHEN round_even(delta, 0) = 0 THEN '-' ELSE '' END)
    || CAST(CAST(round_even(delta, 0) AS INTEGER) AS VARCHAR) END"""
_REFS = """refs AS (SELECT doc_id, text, source AS src,
      CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source, CASE WHEN doc_id % 2 = 0 THEN 'doc ' || doc_id END AS label,
      CASE WHEN doc_id % 5 <> 4 THEN '---' || chr(10) || 'key: x' || chr(10) || '---' || chr(10) || '# Title' || chr(10) || text || chr(10)
        || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || '<IMAGE src=''a''/>' || chr(10) || '### kept' || chr(10) END AS content,
      CASE WHEN doc_id % 5 IN (0, 2) THEN text WHEN doc_id % 5 = 1 THEN '' END AS prose,
      CASE WHEN doc_id % 5 = 2 THEN 2 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS authors, doc_id % 7 = 0 AS failed FROM documents)"""
# no backreferences here: one pattern for each fence
_GENERIC = "coalesce(content, '')"
for _pattern, _flags in (
    (r"\A---\n.*?\n---\n", "s"), (r"(?m)^[ \t]*```(?s:.*?)^[ \t]*```[ \t]*$", "g"), (r"(?m)^[ \t]*~~~(?s:.*?)^[ \t]*~~~[ \t]*$", "g"),
    (r"(?m)^[ \t]*#{1,2}[ \t].*$", "g"), (r"<image\b[^>]*/?>", "gi"),
):
    _GENERIC = f"regexp_replace({_GENERIC}, '{_pattern}', '', '{_flags}')"
_GENERIC = _strip(_GENERIC)
_RESOLVED = f"""{_REFS}, resolved AS (SELECT *, CASE WHEN failed THEN 'transcription failed' WHEN prose = '' THEN 'no prose'
      WHEN prose IS NOT NULL AND authors > 1 THEN authors || ' authors (pass --split)' END AS skip_reason,
      coalesce(nullif(label, ''), nullif(source, ''), '<ref>') AS name FROM refs),
    texts AS (SELECT *, CASE WHEN skip_reason IS NULL THEN coalesce(prose, {_GENERIC}) END AS body FROM resolved)"""
_SWEEP = """grid AS (SELECT CAST(i AS DOUBLE) / 100 AS t FROM range(101) r(i)),
    {name}_b AS (SELECT t, (sum((gt_bucket >= {least} AND model_score >= t)::INT) / sum((gt_bucket >= {least})::INT)::DOUBLE
                   + sum((gt_bucket < {least} AND model_score < t)::INT) / sum((gt_bucket < {least})::INT)::DOUBLE) / 2 AS bal FROM grid, scored GROUP BY t),
    {name} AS (SELECT round(median(t), 4) AS cut, max(bal) AS bal, min(t) AS low, max(t) AS high FROM {name}_b
               WHERE bal = (SELECT max(bal) FROM {name}_b))"""


_POISSON = ", ".join(f"{p!r}::DOUBLE" for p in POISSON)


def _drawn(columns: str, draws: int) -> str:
    """CTE ``drawn``: rows of ``scored`` with draw and times, how often the draw has the row."""
    return f"""chances AS (SELECT {columns}, draw, CAST('0x' || substr(md5('0:' || draw || ':' || sample_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
          FROM scored, range({draws}) d(draw)),
        drawn AS (SELECT * EXCLUDE (u), len(list_filter([{_POISSON}], lambda p: p <= u)) AS times FROM chances WHERE u >= {POISSON[0]!r}::DOUBLE)"""


def _ranked(name: str, col: str) -> str:
    """CTE ``<name>_rank``: mean rank r of each value v in each draw."""
    return f"""{name}_n AS (SELECT draw, {col} AS v, sum(times) AS n FROM drawn GROUP BY draw, {col}),
        {name}_rank AS (SELECT draw, v, sum(n) OVER (PARTITION BY draw ORDER BY v) - n + (n + 1) / 2.0::DOUBLE AS r FROM {name}_n)"""


def _area(name: str, positive: str) -> str:
    """CTE ``name``: AUROC v of each draw."""
    return f"""{name}_n AS (SELECT draw, model_score AS s, sum(times * ({positive})::INT) AS p, sum(times * (NOT ({positive}))::INT) AS q FROM drawn GROUP BY draw, model_score),
        {name}_b AS (SELECT *, sum(q) OVER (PARTITION BY draw ORDER BY s) - q / 2.0::DOUBLE AS before FROM {name}_n),
        {name} AS (SELECT draw, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * before) / (sum(p) * sum(q)::DOUBLE) END AS v FROM {name}_b GROUP BY draw)"""


def _sweeps() -> str:
    first, *rest = (_SWEEP.format(name=n, least=k) for n, k in (("human", 1), ("light", 2), ("top_cut", 3)))
    return ",".join([first, *(r.split(",\n", 1)[1] for r in rest)])


ORACLE_SQL: dict[str, str] = {
    "clean_text": f"WITH {_clean('documents', 'doc_id')} SELECT doc_id, clean FROM cleaned",
    "word_windows": f"{_DOCS} SELECT doc_id, idx AS index, wn AS n_words, word_start, word_end, md5(wtext) AS text_md5 FROM windows",
    "window_regroup": f"""{_DOCS} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_windows, CAST(sum(wn) AS INTEGER) AS n_words,
        md5(string_agg(wtext, ' ' ORDER BY idx)) AS text_md5 FROM windows GROUP BY doc_id""",
    "reliability_filter": f"{_DOCS} SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words FROM cleaned WHERE len(words) >= 50",
    "word_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS n_words FROM documents",
    "chunk_scores": f"""{_DOCS}, {_chunks('doc_id', 2500)} SELECT doc_id, idx AS index, score, CAST(round_even(s * 3, 0) AS INTEGER) AS bucket,
        cband AS band, wn AS n_words, word_start, word_end, varied AS confidence, cut AS truncated, substr(wtext, 1, 60) AS preview FROM chunks""",
    "chunk_heatmap": f"""{_DOCS}, {_chunks('doc_id', 2500)}, strips AS (SELECT doc_id,
        string_agg(substr('▁▂▃▄▅▆▇█', CAST(least(7, floor(score * 8)) AS INTEGER) + 1, 1), '' ORDER BY idx) AS strip FROM chunks GROUP BY doc_id)
        SELECT doc_id, coalesce(strip, '') AS strip FROM cleaned LEFT JOIN strips USING (doc_id)""",
    "detect_documents": f"""WITH {_detected()} SELECT doc_id, score, band, bucket, n_words, n_chunks, reliable,
        varied AS confidence, cut AS truncated, top_index AS most_ai_chunk FROM results""",
    "most_ai_chunk": f"WITH {_detected(2500)} SELECT doc_id, top_index AS most_ai_chunk, top AS top_score FROM results",
    "decode_logits": f"{_LOGITS} SELECT vec_id, round({_SCORE}, 6) AS score, {_TOP} AS bucket FROM p",
    "decode_confidence": f"{_LOGITS} SELECT vec_id, round({_CONFIDENCE}, 6) AS confidence FROM p",
    "logits_scorer": f"""{_LOGITS} SELECT vec_id, round({_SCORE}, 6) AS score, {_TOP} AS bucket, round({_CONFIDENCE}, 6) AS confidence,
        vec_id > 100 AS truncated FROM p""",
    "document_probs": f"""{_DOCS}, {_chunks('doc_id', 2500)}, sums AS (SELECT doc_id, sum({_r4("(1 - s) * 0.5")} * wn) / sum(wn) AS p0,
        sum({_r4("s * 0.25")} * wn) / sum(wn) AS p2, sum({_r4("s * 0.75")} * wn) / sum(wn) AS p3 FROM chunks GROUP BY doc_id)
        SELECT doc_id, round(p0, 6) AS p0, round(p0, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM cleaned LEFT JOIN sums USING (doc_id)""",
    "band_lookup": f"{_SIMPLE} SELECT doc_id, {_band('score')} AS band FROM s",
    "band_range_join": f"""{_SIMPLE}, b(low, high, label) AS (VALUES (-1e308, 0.30, 'human'), (0.30, 0.55, 'lightly edited'),
        (0.55, 0.75, 'moderately edited'), (0.75, 0.90, 'heavily edited'), (0.90, 1e308, 'fully AI'))
        SELECT doc_id, label AS band FROM s JOIN b ON score >= low AND score < high""",
    "score_to_bucket": """WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 2 AS s FROM lineitem) SELECT l_orderkey, l_linenumber,
        CAST(CASE WHEN s <= 0.03::DOUBLE THEN 0 WHEN s >= 0.15::DOUBLE THEN 3
          ELSE 1 + floor((s - 0.03::DOUBLE) / (0.15::DOUBLE - 0.03::DOUBLE) * 2) END AS INTEGER) AS bucket FROM x""",
    "describe_overall": f"WITH {_detected()} SELECT {_describe('score')} FROM results",
    "describe_by_source": f"WITH {_detected(more=', source')} SELECT source, {_describe('score')} FROM results GROUP BY source",
    "fp_table": f"""WITH {_detected(2500)}, t(threshold) AS (VALUES (0.1::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE))
        SELECT threshold, count(*) FILTER (score >= threshold) AS count FROM t, results GROUP BY threshold""",
    "gate_over": f"""WITH {_detected(2500)}, c AS (SELECT count(*) FILTER (reliable AND score > 0.5) AS over, count(*) FILTER (reliable) AS scored
        FROM results) SELECT over, scored, CAST(CASE WHEN scored = 0 THEN 4 WHEN over > 0 THEN 3 ELSE 0 END AS INTEGER) AS exit_code FROM c""",
    "diff_vs_first": f"{_TURNS}, {_DELTA} SELECT conv_id, turn, round(delta, 4) AS delta FROM deltas",
    "prose_resolution": f"WITH {_RESOLVED} SELECT doc_id, name AS label, skip_reason, md5(body) AS text_md5 FROM texts",
    "generic_strip": f"WITH {_RESOLVED} SELECT doc_id, md5({_GENERIC}) AS text_md5 FROM texts",
    "scored_targets": f"""WITH {_RESOLVED}, pending AS (SELECT doc_id, body AS text FROM texts WHERE skip_reason IS NULL), {_detected(2500, "pending")}
        SELECT doc_id AS ordinal, name AS label, r.score AS score, r.band, r.n_words, skip_reason IS NOT NULL AS skipped, skip_reason AS reason
        FROM texts LEFT JOIN results r USING (doc_id)""",
    "rankdata": f"""WITH {_scored()} SELECT sample_id, rank() OVER (ORDER BY model_bucket) + (count(*) OVER (PARTITION BY model_bucket) - 1) / 2.0 AS rank
        FROM scored""",
    "spearman": f"""WITH {_scored()}, r AS (SELECT rank() OVER (ORDER BY model_score) + (count(*) OVER (PARTITION BY model_score) - 1) / 2.0 AS x,
        rank() OVER (ORDER BY cosine_score) + (count(*) OVER (PARTITION BY cosine_score) - 1) / 2.0 AS y FROM scored)
        SELECT count(*) AS n, round(corr(x, y), 6) AS spearman FROM r""",
    "auroc": f"""WITH {_scored()}, p AS (SELECT model_score AS s FROM scored WHERE gt_bucket >= 2), n AS (SELECT model_score AS s FROM scored WHERE gt_bucket < 2)
        SELECT round(avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END), 6) AS auroc,
               CAST((SELECT count(*) FROM p) AS BIGINT) AS n_pos, CAST((SELECT count(*) FROM n) AS BIGINT) AS n_neg FROM p, n""",
    "balacc_sweep": f"""WITH {_scored()}, {_sweeps()} SELECT cut AS threshold, round(bal, 6) AS bal_acc, low AS plateau_low, high AS plateau_high,
        (SELECT count(*) FROM scored WHERE gt_bucket >= 2 AND model_score >= cut) AS tp, (SELECT count(*) FROM scored WHERE gt_bucket >= 2) AS n_pos,
        (SELECT count(*) FROM scored WHERE gt_bucket < 2 AND model_score >= cut) AS fp, (SELECT count(*) FROM scored WHERE gt_bucket < 2) AS n_neg FROM light""",
    "proposed_bands": f"""WITH {_scored()}, {_sweeps()}, raw AS (SELECT (SELECT cut FROM human) AS h, (SELECT cut FROM light) AS l, (SELECT cut FROM top_cut) AS t),
        held AS (SELECT h, greatest(l, h) AS l2, greatest(t, l, h) AS t2, l, t FROM raw)
        SELECT position, round(cut, 3) AS cut, name AS band_below, pinned, (l2 <> l OR t2 <> t OR h = t2) AS degenerate FROM held,
        LATERAL (VALUES (0, h, 'human', true), (1, l2, 'lightly edited', true), (2, (l2 + t2) / 2, 'moderately edited', false), (3, t2, 'heavily edited', true))
        v(position, cut, name, pinned)""",
    "confusion": f"""WITH {_scored()}, spine AS (SELECT CAST(g AS INTEGER) AS gt, CAST(p AS INTEGER) AS pred FROM range(4) a(g), range(4) b(p))
        SELECT gt, pred, count(sample_id) AS n FROM spine LEFT JOIN scored ON gt = gt_bucket AND pred = model_bucket GROUP BY gt, pred""",
    "bucket_metrics": f"""WITH {_scored()}, x AS (SELECT *, CASE WHEN 1 - agg >= agg THEN 0 ELSE 3 END AS top FROM scored)
        SELECT count(*) AS n, round(avg((gt_bucket = model_bucket)::INT), 6) AS bucket_accuracy, round(avg((gt_bucket = top)::INT), 6) AS bucket_accuracy_argmax,
        round(avg((abs(gt_bucket - model_bucket) <= 1)::INT), 6) AS adjacent_accuracy, round(avg(abs(gt_bucket - model_bucket)), 6) AS bucket_mae FROM x""",
    "per_gt_describe": f"WITH {_scored()} SELECT gt_bucket, {_describe('model_score')} FROM scored GROUP BY gt_bucket",
    "calibration_bins": f"""WITH {_scored()}, e AS (SELECT quantile_cont(model_score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM scored),
        b AS (SELECT scored.*, CAST(bin AS INTEGER) AS bin FROM scored, e, range(5) r(bin)
              WHERE model_score >= e[bin + 1] AND model_score < e[bin + 2] + CASE WHEN bin = 4 THEN 1e-9 ELSE 0 END)
        SELECT bin, count(*) AS n, round(avg(model_score), 6) AS mean_score, round(avg(gt_bucket / 3.0), 6) AS mean_gt FROM b GROUP BY bin""",
    "ece": f"""WITH {_scored()}, pr AS (SELECT doc_id, sum({_r4("1 - s")} * wn) / sum(wn) AS p0, sum({_r4("s")} * wn) / sum(wn) AS p3 FROM chunks GROUP BY doc_id),
        x AS (SELECT greatest(p0, p3) AS top, ((CASE WHEN p0 >= p3 THEN 0 ELSE 3 END) = gt_bucket)::INT AS ok FROM scored JOIN pr ON doc_id = sample_id),
        b AS (SELECT least(9, floor(top * 10)) AS bin, count(*) AS n, avg(top) AS conf, avg(ok) AS acc FROM x GROUP BY bin)
        SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM b""",
    "worst_disagreements": f"""WITH {_scored()}, w AS (SELECT * FROM scored ORDER BY abs(gt_bucket - model_bucket) + abs(model_score - gt_bucket / 3.0) DESC, sample_id LIMIT 3)
        SELECT sample_id, gt_bucket, model_bucket, model_score FROM w WHERE gt_bucket <> model_bucket""",
    "compare_runs": f"""WITH {_detected(10_000)}, b AS (SELECT doc_id, idx, least(1.0, CAST(length(wtext) AS DOUBLE) / 2500.0) AS s, wn FROM windows),
        two AS (SELECT doc_id, sum({_r4("s")} * wn ORDER BY idx) / sum(wn) AS agg2 FROM b GROUP BY doc_id),
        x AS (SELECT score AS sa, {_r4("agg2")} AS sb, bucket AS ba, CAST(round_even(agg2 * 3, 0) AS INTEGER) AS bb FROM results JOIN two USING (doc_id) WHERE reliable)
        SELECT count(*) AS n, round(avg(abs(sa - sb)), 6) AS score_mae, round(max(abs(sa - sb)), 6) AS max_delta, round(avg((ba <> bb)::INT), 6) AS bucket_flip_rate FROM x""",
    "latency_summary": """SELECT round(quantile_cont(abs(value), 0.5), 4) AS p50_s, round(quantile_cont(abs(value), 0.95), 4) AS p95_s,
        round(count(*) * 100 / sum(abs(value)), 4) AS words_per_s FROM events""",
    "markdown": f"""{_TURNS}, {_DELTA} SELECT conv_id, turn, '| ' || conv_id || '/' || turn || ' | ' || CAST(round_even(score * 100, 0) AS INTEGER) || '% | ' || band
        || ' | ' || n_words || ' | ' || {_SIGNED} || ' | ' || CASE WHEN reliable THEN '' ELSE 'unreliable' END || ' |' AS line FROM deltas""",
    "seeded_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100",
    "bootstrap_cis": f"""WITH {_scored()}, {_drawn("sample_id, gt_bucket, model_bucket, model_score, cosine_score", 1000)},
        simple AS (SELECT draw, sum(times * (gt_bucket = model_bucket)::INT) / sum(times)::DOUBLE AS a,
            sum(times * (abs(gt_bucket - model_bucket) <= 1)::INT) / sum(times)::DOUBLE AS b FROM drawn GROUP BY draw),
        {_ranked("x", "model_score")}, {_ranked("y", "cosine_score")},
        ranks AS (SELECT d.draw, d.times AS w, rx.r AS rx, ry.r AS ry FROM drawn d JOIN x_rank rx ON rx.draw = d.draw AND rx.v = model_score
            JOIN y_rank ry ON ry.draw = d.draw AND ry.v = cosine_score),
        rho AS (SELECT draw, (sum(w * rx * ry) - sum(w) * (sum(w) + 1.0) * (sum(w) + 1.0) / 4) / sqrt((sum(w * rx * rx) - sum(w) * (sum(w) + 1.0) * (sum(w) + 1.0) / 4)
            * (sum(w * ry * ry) - sum(w) * (sum(w) + 1.0) * (sum(w) + 1.0) / 4)) AS v FROM ranks GROUP BY draw),
        {_area("one", "gt_bucket >= 1")}, {_area("three", "gt_bucket = 3")},
        v AS (SELECT 'bucket_accuracy' AS stat, a AS v FROM simple UNION ALL SELECT 'adjacent_accuracy', b FROM simple UNION ALL SELECT 'spearman_score', v FROM rho
            UNION ALL SELECT 'auroc_human', v FROM one UNION ALL SELECT 'auroc_top', v FROM three)
        SELECT stat, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY stat""",
    "bootstrap_cuts": f"""WITH {_scored()}, {_drawn("sample_id, gt_bucket, model_score", 200)}, grid AS (SELECT CAST(i AS DOUBLE) / 100 AS t FROM range(101) r(i)),
        k(stat, least) AS (VALUES ('human', 1), ('light', 2), ('top', 3)),
        n AS (SELECT stat, least, draw, sum(times * (gt_bucket >= least)::INT)::DOUBLE AS p, sum(times * (gt_bucket < least)::INT)::DOUBLE AS q FROM drawn, k GROUP BY ALL),
        w AS (SELECT stat, draw, t, p, q, sum(times * (gt_bucket >= least AND model_score >= t)::INT) AS tp, sum(times * (gt_bucket < least AND model_score < t)::INT) AS tn
              FROM n JOIN drawn USING (draw), grid WHERE p > 0 AND q > 0 GROUP BY ALL),
        b AS (SELECT stat, draw, t, (tp / p + tn / q) / 2 AS bal, max((tp / p + tn / q) / 2) OVER (PARTITION BY stat, draw) AS top FROM w),
        c AS (SELECT stat, draw, round(median(t), 4) AS cut FROM b WHERE bal = top GROUP BY stat, draw)
        SELECT stat, round(quantile_cont(cut, 0.025), 6) AS low, round(quantile_cont(cut, 0.975), 6) AS high FROM c GROUP BY stat""",
    "diff_view": f"""{_TURNS}, {_DELTA}, s AS (SELECT *, CAST(round_even(score * 12, 0) AS INTEGER) AS filled FROM deltas)
        SELECT conv_id, turn, conv_id || '/' || turn || ': ' || repeat('•', filled) || repeat('·', 12 - filled) || ' ' || CAST(round_even(score * 100, 0) AS INTEGER)
        || '%' || CASE WHEN delta IS NULL THEN '' ELSE ' (' || {_SIGNED} || ' points)' END || ' ' || band || CASE WHEN reliable THEN '' ELSE ', unreliable' END AS line FROM s""",
    "emoji_names": f"""SELECT conv_id, turn, md5('a' || ([{", ".join(f"'{n}'" for _, n in MARKS)}])[(conv_id * 7 + turn) % {len(MARKS)} + 1] || ' ' || text) AS text_md5
        FROM conversations""",
    "think_tag": f"""SELECT conv_id, turn, md5(CASE turn % 4 WHEN 0 THEN 'a ' || text WHEN 1 THEN {_strip("' ' || text")}
        ELSE {_strip("' ' || text")} END) AS text_md5 FROM conversations""",
}
