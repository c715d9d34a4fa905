"""SQL twins of the queries in report_queries, for DuckDB over the same tables."""

from __future__ import annotations

from .oracles import _DELTA, _REFS, _RESOLVED, _band, _clean, _describe, _detected, _r4, _squeeze, _sweeps, _windows  # noqa: F401
from .report_queries import CUTS, SHORT, STREAM

_NOTES = {
    "truncated": "some window was longer than the model reads", "unreliable": "fewer than 50 words say little",
    "uncalibrated": "bands were made for another model, take them roughly",
}


def _q(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return repr(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str, kinds: str = "") -> str:
    """SELECT of constant rows; ``kinds``: types to cast to, in order."""
    names = [f'"{n}"' for n in columns.split(", ")]
    casts = [f"CAST({n} AS {k}) AS {n}" if k != "-" else n for n, k in zip(names, kinds.split(", "))] if kinds else names
    return f"SELECT {', '.join(casts)} FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) v({', '.join(names)})"


def _percent(x: str) -> str:
    return f"CAST(CAST(round_even({x} * 100, 0) AS INTEGER) AS VARCHAR) || '%'"


def _bar(x: str, width: int) -> str:
    n = f"CAST(round_even({x} * {width}, 0) AS INTEGER)"
    return f"repeat('•', {n}) || repeat('·', {width} - {n})"


def _all(calibrated: bool = True) -> str:
    """CTE ``shown``: ordinal, result columns, notes, line of the list."""
    notes = ["CASE WHEN cut THEN 'truncated' END", "CASE WHEN NOT reliable THEN 'unreliable' END", *([] if calibrated else ["'uncalibrated'"])]
    return f"""bench AS (SELECT CAST(item_id AS BIGINT) AS doc_id, text FROM benchmark), {_detected(200, "bench", most=150)},
    every AS (SELECT doc_id AS ordinal, score, band, reliable, cut, false AS skipped, CAST(NULL AS VARCHAR) AS reason FROM results
        UNION ALL SELECT doc_id + 1000000, NULL, '—', NULL, NULL, true, 'no prose' FROM documents WHERE doc_id % 10 = 7),
    noted AS (SELECT *, 't' || ordinal AS label, CASE WHEN skipped THEN 'not scored: no prose' ELSE concat_ws(', ', {', '.join(notes)}) END AS notes,
        (SELECT max(length(band)) FROM every) AS width FROM every),
    shown AS (SELECT *, lpad(CASE WHEN skipped THEN '—' ELSE {_percent("score")} END, 4, ' ') || '  ' || rpad(band, width::INTEGER, ' ') || '  ' || label
        || CASE WHEN notes <> '' THEN '  (' || notes || ')' ELSE '' END AS line FROM noted)"""


_LABELED = """labeled AS (SELECT doc_id, text, n_chars, n_chars % 20 / 100.0::DOUBLE AS cosine_score,
    CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, n_chars // 2) END AS source_text FROM documents)"""
_GT = """CAST(CASE WHEN cosine_score <= 0.03::DOUBLE THEN 0 WHEN cosine_score >= 0.15::DOUBLE THEN 3
    ELSE 1 + floor((cosine_score - 0.03::DOUBLE) / (0.15::DOUBLE - 0.03::DOUBLE) * 2) END AS INTEGER)"""


def _unpivot(table: str, prefix: str, columns: tuple[str, ...]) -> str:
    """Rows (item, value, text) of the columns of a one-row table."""
    return " UNION ALL ".join(f"SELECT '{prefix}{c}', {c}::DOUBLE, NULL FROM {table}" for c in columns)


_EIGHT = ("n", "min", "q25", "median", "mean", "q75", "q90", "max")


def _facts(rows: list[tuple]) -> str:
    """Constant facts (item, value, text)."""
    return _values(rows, "item, value, text", "-, DOUBLE, VARCHAR")


def _dataset_report() -> str:
    own = f"""(WITH src AS (SELECT doc_id, source_text AS text FROM labeled WHERE source_text IS NOT NULL), {_detected(2500, "src")}
        SELECT doc_id, score, bucket FROM results)"""
    classes = (("human", 1, "human"), ("light", 2, "light"), ("top", 3, "top_cut"))
    sweeps = " UNION ALL ".join(
        f"""SELECT 'bands.sweeps.{name}.' || k, v, NULL FROM {cte}, LATERAL (VALUES ('threshold', cut), ('bal_acc', round(bal, 9)), ('plateau.0', low), ('plateau.1', high),
            ('tp', (SELECT count(*)::DOUBLE FROM scored WHERE gt_bucket >= {least} AND model_score >= cut)), ('n_pos', (SELECT count(*)::DOUBLE FROM scored WHERE gt_bucket >= {least})),
            ('fp', (SELECT count(*)::DOUBLE FROM scored WHERE gt_bucket < {least} AND model_score >= cut)), ('n_neg', (SELECT count(*)::DOUBLE FROM scored WHERE gt_bucket < {least}))) x(k, v)"""
        for name, least, cte in classes
    )
    auroc = lambda name, cond: f"""{name} AS (SELECT (sum(r) FILTER ({cond}) - count(*) FILTER ({cond}) * (count(*) FILTER ({cond}) + 1) / 2.0::DOUBLE)
        / (count(*) FILTER ({cond}) * (count(*) FILTER (NOT ({cond})))::DOUBLE) AS v FROM ranked)"""  # noqa: E731
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {n}"
        for c, n in (("model_score", "r"), ("cosine_score", "rc"), ("model_bucket", "rb"), ("gt_bucket", "rg"))
    )
    head = [
        ("mode", None, "dataset"), ("reliable_only", 0, None), ("split", None, "test"), ("seed", 0, None), ("model", None, "stub"), ("device", None, "cluster"),
        ("quantize", None, None), ("quantized", 0, None), ("compare", None, None),
    ]
    return f"""WITH {_LABELED}, {_detected(2500, "labeled", more=", cosine_score")},
    pr AS (SELECT doc_id, sum({_r4("(1 - s) * 0.5")} * wn ORDER BY idx) / sum(wn) AS p0, sum({_r4("s * 0.75")} * wn ORDER BY idx) / sum(wn) AS p3 FROM chunks GROUP BY doc_id),
    scored AS (SELECT doc_id AS sample_id, cosine_score, {_GT} AS gt_bucket, score AS model_score, bucket AS model_bucket,
        CASE WHEN p0 IS NULL THEN bucket WHEN p0 >= p3 THEN 0 ELSE 3 END AS top, p0, p3 FROM results LEFT JOIN pr USING (doc_id)),
    source AS {own}, {_sweeps()},
    summed AS (SELECT count(*) AS n, avg((gt_bucket = model_bucket)::INT) AS bucket_accuracy, avg((gt_bucket = top)::INT) AS bucket_accuracy_argmax,
        avg((abs(gt_bucket - model_bucket) <= 1)::INT) AS adjacent_accuracy, avg(abs(gt_bucket - model_bucket)) AS bucket_mae FROM scored),
    ranked AS (SELECT *, {ranks} FROM scored), {auroc("a1", "gt_bucket >= 1")}, {auroc("a3", "gt_bucket = 3")},
    eb AS (SELECT least(9, floor(greatest(p0, p3) * 10)) AS bin, count(*) AS n, avg(greatest(p0, p3)) AS conf, avg((top = gt_bucket)::INT) AS acc
        FROM scored WHERE p0 IS NOT NULL GROUP BY bin),
    e AS (SELECT quantile_cont(model_score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM scored),
    cal AS (SELECT bin, count(*) AS n, avg(model_score) AS mean_score, avg(gt_bucket / 3.0::DOUBLE) AS mean_gt, row_number() OVER (ORDER BY bin) - 1 AS place FROM scored, e, range(5) r(bin)
        WHERE model_score >= e[bin + 1] AND model_score < e[bin + 2] + CASE WHEN bin = 4 THEN 1e-9 ELSE 0 END GROUP BY bin),
    per AS (SELECT gt_bucket, {_describe("model_score")} FROM scored GROUP BY gt_bucket),
    src AS (SELECT {_describe("score")}, avg((bucket = 0)::INT) AS frac FROM source),
    raw AS (SELECT (SELECT cut FROM human) AS h, (SELECT cut FROM light) AS l, (SELECT cut FROM top_cut) AS t),
    held AS (SELECT h, greatest(l, h) AS l2, greatest(t, l, h) AS t2, l, t FROM raw),
    cuts AS (SELECT k, round(cut, 3) AS cut, name, pinned FROM held, LATERAL (VALUES (0, h, 'human', 1), (1, l2, 'lightly edited', 1),
        (2, (l2 + t2) / 2, 'moderately edited', 0), (3, t2, 'heavily edited', 1)) v(k, cut, name, pinned)),
    facts(item, value, text) AS (
      {_facts(head)} UNION ALL SELECT 'n_total', n::DOUBLE, NULL FROM summed UNION ALL SELECT 'n_used', n::DOUBLE, NULL FROM summed
      UNION ALL {_unpivot("summed", "metrics.", ("n", "bucket_accuracy", "bucket_accuracy_argmax", "adjacent_accuracy", "bucket_mae"))}
      UNION ALL SELECT 'metrics.spearman_score', corr(r, rc), NULL FROM ranked UNION ALL SELECT 'metrics.spearman_bucket', corr(rb, rg), NULL FROM ranked
      UNION ALL SELECT 'metrics.auroc_human', v, NULL FROM a1 UNION ALL SELECT 'metrics.auroc_top', v, NULL FROM a3
      UNION ALL SELECT 'metrics.ece_argmax', sum(n * abs(conf - acc)) / sum(n), NULL FROM eb
      UNION ALL SELECT 'metrics.confusion.' || g || '.' || p, (SELECT count(*)::DOUBLE FROM scored WHERE gt_bucket = g AND model_bucket = p), NULL FROM range(4) a(g), range(4) b(p)
      UNION ALL SELECT 'metrics.calibration.' || place || '.' || k, v, NULL FROM cal, LATERAL (VALUES ('n', n::DOUBLE), ('mean_score', mean_score), ('mean_gt', mean_gt)) x(k, v)
      UNION ALL SELECT 'metrics.per_gt_score.' || gt_bucket || '.' || k, v, NULL FROM per, LATERAL (VALUES {", ".join(f"('{k}', {k}::DOUBLE)" for k in _EIGHT)}) x(k, v)
      UNION ALL SELECT 'metrics.source_control.frac_bucket0', frac, NULL FROM src UNION ALL {_unpivot("src", "metrics.source_control.describe.", _EIGHT)}
      UNION ALL {sweeps}
      UNION ALL SELECT 'bands.boundaries.' || k || '.cut', cut, NULL FROM cuts UNION ALL SELECT 'bands.boundaries.' || k || '.band_below', NULL, name FROM cuts
      UNION ALL SELECT 'bands.boundaries.' || k || '.pinned', pinned::DOUBLE, NULL FROM cuts
      UNION ALL SELECT 'bands.degenerate', (l2 <> l OR t2 <> t OR h = t2)::INT::DOUBLE, NULL FROM held)
    SELECT item, round(value, 9) + 0.0 AS value, text FROM facts"""


def _paired() -> str:
    """CTE ``runs``: per reliable document score and bucket at three scales, and the truth."""
    at = ", ".join(f"sum({_r4(f'least(1.0, CAST(length(wtext) AS DOUBLE) / {k}.0)')} * wn ORDER BY idx) / sum(wn) AS a{k}" for k in (2500, 5000, 10000))
    pick = ", ".join(f"{_r4(f'a{k}')} AS s{k}, CAST(round_even(a{k} * 3, 0) AS INTEGER) AS b{k}" for k in (2500, 5000, 10000))
    return f"""{_LABELED}, {_clean("labeled", "doc_id", ", cosine_score")}, {_windows("doc_id", ", cosine_score")},
    sums AS (SELECT doc_id, cosine_score, sum(wn) AS n, {at} FROM windows GROUP BY doc_id, cosine_score),
    runs AS (SELECT {_GT} AS gt, {pick} FROM sums WHERE n >= 50)"""


def _pair(mode: str, names: tuple[str, str], one: int, two: int) -> str:
    return f"""SELECT '{mode}' AS mode, '{names[0]}' AS a, '{names[1]}' AS b, count(*) AS n, round(avg(abs(s{one} - s{two})), 6) AS score_mae,
        round(max(abs(s{one} - s{two})), 6) AS max_delta, round(avg((b{one} <> b{two})::INT), 6) AS bucket_flip_rate FROM runs"""


def _mixed() -> tuple[list[tuple], list[tuple]]:
    """Targets of the mixed list: (place, label, text) that are scored and (place, label, reason) that aren't."""
    scored, skipped, place = [], [], 0
    for n in (4, -1, -2, *range(1, 12)):
        if n < 0:
            scored.append((place, "(stdin)" if n == -1 else "file", STREAM if n == -1 else "line " * 70))
            place += 1
            continue
        for k in range(n % 3):
            reason = "transcription failed" if n % 5 == 0 else "no prose" if k else None
            (skipped if reason else scored).append((place, f"{n}-{k}", reason or "word " * (50 + n)))
            place += 1
    return scored, skipped


_SCORED, _SKIPPED = _mixed()
_BY_KEY = "coalesce(nullif(source, ''), nullif(name, ''), '<ref>')"
_WIRE_KEYS = "doc_id,score,band,bucket,n_words,n_chunks,reliable,confidence,truncated,model,calibrated,most_ai_chunk,chunks"
_CHUNK_KEYS = "index,score,band,n_words,word_start,word_end,confidence,truncated,preview"
_PROBE = [("cli", 0.1196, "human"), ("cli", 0.2396, "human"), ("cli", 0.3596, "lightly edited"), ("cli", 0.4796, "lightly edited")]
_FILES = ("human.txt", "edit_light.txt", "edit_vivid.txt", "edit_rewrite.txt")
_NO_VALUE = ("bucket_accuracy", "bucket_accuracy_argmax", "adjacent_accuracy", "bucket_mae", "spearman_score", "spearman_bucket", "auroc_human", "auroc_top", "ece_argmax", "source_control")
_HEADER = ("model", "n", "bucket_accuracy", "adjacent_accuracy", "spearman_score", "auroc_human", "p50_s")

ORACLE_SQL: dict[str, str] = {
    "wire_jsonl": f"""WITH {_detected(2500)}, firsts AS (SELECT doc_id, cband, least(120, length(wtext)) AS chars FROM chunks WHERE idx = 0)
        SELECT doc_id, score, band, n_words, top_index AS most_ai_chunk, n_chunks, cband AS first_band, CAST(chars AS INTEGER) AS preview_chars,
        '{_WIRE_KEYS}' AS keys, CASE WHEN n_chunks > 0 THEN '{_CHUNK_KEYS}' END AS chunk_keys FROM results LEFT JOIN firsts USING (doc_id)""",
    "wire_json_array": f"""WITH {_all()} SELECT CAST(row_number() OVER (ORDER BY ordinal) - 1 AS INTEGER) AS place, label, score, skipped, reason, false AS with_preview FROM shown""",
    "list_lines": f"WITH {_all()} SELECT ordinal, line FROM shown",
    "uncalibrated_views": f"WITH {_all(False)} SELECT ordinal, line FROM shown",
    "ordered_view": f"WITH {_all()} SELECT CAST(row_number() OVER (ORDER BY ordinal) - 1 AS INTEGER) AS place, line FROM shown",
    "output_formats": f"""WITH {_all()}, n AS (SELECT CAST(count(*) AS INTEGER) AS n, min_by(line, ordinal) AS first, min_by(label, ordinal) AS name FROM shown)
        SELECT form, n_lines, begins FROM n, LATERAL (VALUES ('human', n, substr(first, 1, 2)), ('json', 1, '[{{'), ('jsonl', n, '{{"'), ('md', n + 2, '| '),
        ('diff', n, substr(name, 1, 2))) v(form, n_lines, begins)""",
    "card_lines": f"""WITH {_detected(2500)}, strips AS (SELECT doc_id, string_agg(substr('▁▂▃▄▅▆▇█', CAST(least(7, floor(score * 8)) AS INTEGER) + 1, 1), '' ORDER BY idx) AS strip
        FROM chunks GROUP BY doc_id)
        SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'd' || doc_id || ': not scored: no prose' ELSE concat_ws('|', 'd' || doc_id || ': ' || band || ', ' || {_percent("score")},
        '  ' || {_bar("score", 16)}, '  ' || n_words || ' words, ' || n_chunks || ' windows, model stub', '  certainty ' || {_percent("varied")},
        CASE WHEN n_chunks > 1 THEN '  windows ' || strip || ', highest is number ' || top_index || ' at ' || {_percent("top")} END,
        CASE WHEN cut THEN '  truncated: {_NOTES["truncated"]}' END, CASE WHEN NOT reliable THEN '  unreliable: {_NOTES["unreliable"]}' END,
        '  uncalibrated: {_NOTES["uncalibrated"]}') END AS card FROM results LEFT JOIN strips USING (doc_id)""",
    "chunk_lines": f"""WITH {_detected(2500)} SELECT doc_id, idx AS place, '  ' || idx || ': ' || {_bar("score", 10)} || ' ' || {_percent("score")} || ' ' || cband || ' (words '
        || word_start || '-' || word_end || ', certainty ' || {_percent("varied")} || CASE WHEN cut THEN ', truncated' ELSE '' END || ') ' || substr(wtext, 1, 60) AS line
        FROM chunks WHERE doc_id % 10 <> 7""",
    "previews": f"SELECT doc_id, substr({_squeeze('text')}, 1, 60) AS short, substr({_squeeze('text')}, 1, 80) AS long FROM documents",
    "fixed_numbers": "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) OR value IS NULL THEN '—' ELSE format('{:.3f}', value) END AS shown FROM events",
    "empty_documents": f"""WITH f AS ({_values(list(enumerate(SHORT)), "doc_id, text", "INTEGER, -")}), {_detected(10_000, "f")}
        SELECT doc_id, score, band, bucket, n_words, n_chunks, reliable, varied AS confidence, cut AS truncated, top_index AS most_ai_chunk FROM results""",
    "text_and_stream": f"""WITH f AS ({_values([(0, "(text)", SHORT[2]), (1, "(stdin)", STREAM)], "doc_id, label, text", "BIGINT, -, -")}), {_detected(2500, "f", more=", label")}
        SELECT doc_id AS ordinal, label, score, band, n_words, substr({_squeeze("raw")}, 1, 60) AS preview FROM results""",
    "file_targets": f"""WITH f AS (SELECT conv_id AS doc_id, string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id),
        {_detected(2500, "f")} SELECT doc_id AS conv_id, score, n_words, CAST(row_number() OVER (ORDER BY doc_id || '/') AS INTEGER) AS place FROM results""",
    "mixed_targets": f"""WITH f AS ({_values(_SCORED, "doc_id, label, text")}), {_detected(2500, "f", more=", label")}
        SELECT CAST(doc_id AS INTEGER) AS place, label, score, n_words, false AS skipped, NULL AS reason FROM results UNION ALL
        SELECT CAST(p AS INTEGER), label, NULL, NULL, true, reason FROM (VALUES {", ".join("(" + ", ".join(map(_q, r)) + ")" for r in _SKIPPED)}) v(p, label, reason)""",
    "labeled_samples": f"""WITH {_LABELED}, picked AS (SELECT * FROM labeled ORDER BY md5('3:' || doc_id), doc_id LIMIT 100), {_clean("picked", "doc_id", ", cosine_score, source_text")}
        SELECT doc_id AS sample_id, cosine_score, {_GT} AS gt_bucket, CAST(len(words) AS INTEGER) AS n_words, substr({_squeeze("raw")}, 1, 80) AS preview,
        CAST(length(source_text) AS INTEGER) AS source_chars FROM cleaned""",
    "dataset_report": _dataset_report(),
    "compare_models": f"WITH {_paired()} {_pair('models', ('llama', 'roberta'), 2500, 10000)} UNION ALL {_pair('quant', ('4-bit', 'unquantized'), 2500, 5000)}",
    "source_control": f"""WITH {_LABELED}, own AS (WITH src AS (SELECT doc_id, source_text AS text FROM labeled WHERE source_text IS NOT NULL), {_detected(2500, "src")} SELECT * FROM results),
        {_detected(2500)} SELECT doc_id AS sample_id, r.score AS model_score, own.score AS source_score, own.bucket AS source_bucket FROM results r JOIN own USING (doc_id)""",
    "references_report": f"""WITH {_RESOLVED}, pending AS (SELECT doc_id, body AS text, {_BY_KEY} AS name FROM texts WHERE skip_reason IS NULL), {_detected(2500, "pending", more=", name")},
        used AS (SELECT * FROM results WHERE reliable), whole AS (SELECT {_describe("score")} FROM used), per_key AS (SELECT name, {_describe("score")} FROM used GROUP BY name),
        facts(item, value, text) AS ({_facts([("mode", None, "refs"), ("model", None, "stub")])}
        UNION ALL SELECT 'n_scored', count(*)::DOUBLE, NULL FROM results UNION ALL SELECT 'n_skipped', count(*)::DOUBLE, NULL FROM texts WHERE skip_reason IS NOT NULL
        UNION ALL {_unpivot("whole", "overall.", _EIGHT)}
        UNION ALL SELECT 'fp_table.' || k || '.' || part, CASE part WHEN 'threshold' THEN t ELSE (SELECT count(*)::DOUBLE FROM used WHERE score >= t) END, NULL
            FROM (VALUES (0, 0.1::DOUBLE), (1, 0.4::DOUBLE), (2, 0.5::DOUBLE), (3, 0.7::DOUBLE), (4, 0.9::DOUBLE)) v(k, t), (VALUES ('threshold'), ('count')) p(part)
        UNION ALL SELECT 'by_source.' || name || '.' || k, v, NULL FROM per_key, LATERAL (VALUES {", ".join(f"('{k}', {k}::DOUBLE)" for k in _EIGHT)}) x(k, v))
        SELECT item, round(value, 9) + 0.0 AS value, text FROM facts""",
    "probe_report": _facts(
        [("mode", None, "smoke"), ("human_is_min", 1, None), ("rewrite_is_max", 1, None), ("spearman_order", 1, None), ("passed", 1, None), ("model", None, "stub"), ("device", None, "cluster")]
        + [(f"labels.{k}", None, n) for k, n in enumerate(_FILES)] + [(f"scores.{k}", s, None) for k, (_, s, _) in enumerate(_PROBE)] + [(f"bands.{k}", None, b) for k, (_, _, b) in enumerate(_PROBE)]
    ),
    "empty_metrics": _facts([("n", 0, None), *[(k, None, None) for k in _NO_VALUE], *[(f"confusion.{i}.{j}", 0, None) for i in range(4) for j in range(4)]]),
    "headline_table": _values(
        [(0, f"| {' | '.join(_HEADER)} |"), (1, f"| {' | '.join(['---'] * 7)} |"), (2, "| m | 8 | 0.500 (0.250 to 0.750) | 1.000 | — | 0.875 | 0.250 |"), (3, ""), (4, "Made by: run")],
        "place, line",
    ),
    "report_lines": _values(
        list(enumerate(["dataset report", "model: m", "n_used: 8", "", "latency:", "  p50_s  0.250", "", "metrics:", "  bucket_accuracy    0.500  (0.250 to 0.750)",
                        "  adjacent_accuracy  1.000", "  spearman_score     —", "  auroc_human        0.875"])),
        "place, line",
    ),
    "bands_artifact": f"""WITH {_detected()} SELECT doc_id, CASE WHEN score < {CUTS[0]} THEN 'human' WHEN score < {CUTS[1]} THEN 'lightly edited' WHEN score < {CUTS[2]} THEN 'moderately edited'
        WHEN score < {CUTS[3]} THEN 'heavily edited' ELSE 'fully AI' END AS band FROM results""",
    "batch_scorer": f"""WITH {_detected()} SELECT doc_id, score, band, bucket, top_index AS most_ai_chunk, 'python' AS model, false AS calibrated, n_chunks > 0 AS timed FROM results""",
    "score_latency": f"""WITH {_clean("documents", "doc_id")} SELECT scorer, CASE WHEN scorer = 'model' THEN (SELECT count(*) FROM cleaned WHERE len(words) > 0) ELSE 0 END AS timed,
        scorer = 'model' AS has_p50, true AS has_speed FROM (VALUES ('model'), ('expression')) v(scorer)""",
    "runtime_plans": _values(
        [(0, "cpu", "roberta", False, 512, 8), (1, "mps", "llama", False, 1024, 8), (2, "cuda", "llama", True, 1024, 10), (3, "cuda:1", "llama", False, 1024, 10),
         (4, "cpu", "roberta", False, 512, 8), (5, "cuda", "roberta", True, 512, 1)],
        "k, device, model, quantized, max_tokens, width",
    ),
    "adapter_headers": _values([(False, True, "base2", 2), (False, True, "base4", 4)], "before, adapter, base, buckets"),
    "model_errors": _values(
        [("finite", "none"), ("nan", "RuntimeError"), ("infinite", "RuntimeError"), ("gated", "ScorerAccessError"), ("missing", "ScorerUnavailableError"),
         ("no folder", "FileNotFoundError"), ("loads", "1")],
        "case, error",
    ),
    "command_line": _values(
        [("score", 0, True, False), ("over", 3, True, True), ("below", 0, True, True), ("undecided", 4, True, False), ("no model", 1, False, True),
         ("no reference", 1, False, True), ("one target", 2, False, True), ("no table", 1, False, True), ("bad share", 2, False, True),
         ("version", 0, True, False), ("two formats", 2, False, False)],
        "command, code, printed, complained",
    ),
    "host_command": _values([(0, 700, 20, 40, 30)], "code, n_words, verbose, quiet, after"),
    "sql_functions": f"""WITH x AS (SELECT *, n_chars % 20 / 100.0::DOUBLE AS cosine_score FROM documents) SELECT doc_id, {_band("least(n_chars, 6000) / 6000.0::DOUBLE")} AS band, {_GT} AS bucket,
        CAST(round_even(n_chars % 1000 / 1000.0::DOUBLE * 100, 0) AS INTEGER) AS percent, md5({_squeeze("text")}) AS text_md5, 0.666667::DOUBLE AS expected, 0.25::DOUBLE AS confidence FROM x""",
    "lazy_exports": _values(
        [(n, True) for n in ("BatchScorer", "LengthStub", "LogitsScorer", "ScorerUnavailableError", "__version__", "chosen_scorer", "detect", "eval_dataset",
                             "eval_references", "register_functions", "register_resolver", "score_documents", "score_targets")],
        "name, found",
    ),
}
