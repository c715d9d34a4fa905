"""Evaluation: labeled samples, unlabeled references, and the gradient probe."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import KINDS, plan_runtime
from ..functions.numeric import argmax
from ..operators import stats
from ..operators.bands import DEFAULT, KIND, Band
from ..operators.detect import DETECTION_COLUMNS, detect, detect_both, weighted_probs
from ..operators.prose import NO_LABEL
from ..scorers import chosen_scorer, this_machine
from ..workspace import Workspace

N_BUCKETS = 4
METRIC_NAMES = (
    "bucket_accuracy", "bucket_accuracy_argmax", "adjacent_accuracy", "bucket_mae", "spearman_score", "spearman_bucket",
    "auroc_human", "auroc_top", "ece_argmax",
)
SWEEPS = ("human", "light", "top")


#: The columns of a scored sample.
SCORED = (
    "sample_id", "preview", "cosine_score", "gt_bucket", "n_words", "reliable", "model_score", "model_bucket", "model_bucket_argmax", "probs",
    "latency_s",
)


def _checked(*scorers: Any) -> None:
    for scorer in scorers:
        if scorer.n_buckets != N_BUCKETS:
            raise ValueError(f"evaluation needs {N_BUCKETS} buckets, the scorer has {scorer.n_buckets}")


def _as_scored(found: DataFrame, result: str) -> DataFrame:
    """Scored samples from rows with the struct of a detection."""
    r = F.col(result)
    out = found.withColumn("probs", weighted_probs(f"{result}.chunks"))
    top = F.when(F.size("probs") > 0, argmax("probs")).otherwise(r["bucket"])
    return out.select(
        "sample_id", F.col("__p").alias("preview"), "cosine_score", "gt_bucket", r["n_words"].alias("n_words"), r["reliable"].alias("reliable"),
        r["score"].alias("model_score"), r["bucket"].alias("model_bucket"), top.alias("model_bucket_argmax"), "probs", r["latency_s"].alias("latency_s"),
    )


def _with_sources(out: DataFrame, samples: DataFrame, scorer: Any) -> DataFrame:
    sources = samples.filter("source_text IS NOT NULL").select("sample_id", F.col("source_text").alias("text"))
    own = detect(sources, scorer).select("sample_id", F.col("score").alias("source_score"), F.col("bucket").alias("source_bucket"))
    return out.join(own, "sample_id", "left")


def score_samples(samples: DataFrame, scorer: Any, *, with_source: bool = False) -> DataFrame:
    """Samples with SCORED columns; ``with_source`` adds source_score and source_bucket of their source texts.

    latency_s is the model's time for the sample's windows, measured batch by batch (null for expressions).
    """
    _checked(scorer)
    found = detect(samples.select("sample_id", "text", F.col("preview").alias("__p"), "cosine_score", "gt_bucket"), scorer, with_latency=True)
    out = _as_scored(found.select("*", F.struct(*DETECTION_COLUMNS, "latency_s").alias("r")).select("sample_id", "__p", "cosine_score", "gt_bucket", "r"), "r")
    return _with_sources(out, samples, scorer) if with_source else out


def kept(scored: DataFrame) -> tuple[DataFrame, float]:
    """The scored samples in a saved table, so that the model runs once, and the seconds this took."""
    began = time.perf_counter()
    saved = Workspace(scored.sparkSession).save(scored, "scored")
    return saved, time.perf_counter() - began


def latency(scored: DataFrame, seconds: float | None = None) -> dict:
    """p50_s, p95_s, words_per_s of the model's own times; for scorers that are expressions only the run's words per second."""
    found = stats.latency_summary(scored, "latency_s", "n_words").first().asDict()
    if found["words_per_s"] is None and seconds:
        found["words_per_s"] = (scored.agg(F.sum("n_words")).first()[0] or 0) / seconds
    return found


def dataset_metrics(scored: DataFrame, *, n_buckets: int = N_BUCKETS, with_source: bool = False, n_boot: int = 1000, seed: int = 0) -> dict:
    """All agreement metrics of scored samples; undefined ones are None. ``scored`` is read often: save it first (:func:`kept`)."""
    head = stats.agreement(scored, "gt_bucket", "model_bucket", "model_bucket_argmax").first().asDict()
    cells = [[0] * n_buckets for _ in range(n_buckets)]
    out: dict[str, Any] = dict.fromkeys(METRIC_NAMES) | head | {
        "confusion": cells, "calibration": [], "cis": {}, "per_gt_score": {}, "worst_disagreements": [], "source_control": None,
    }
    if not head["n"]:
        return out
    for row in stats.confusion(scored, "gt_bucket", "model_bucket", n_buckets).collect():
        cells[row["gt"]][row["pred"]] = row["n"]
    out["spearman_score"] = stats.spearman(scored, "model_score", "cosine_score").first()["spearman"]
    out["spearman_bucket"] = stats.spearman(scored, "model_bucket", "gt_bucket").first()["spearman"]
    out["auroc_human"] = stats.auroc(scored, "model_score", F.col("gt_bucket") >= 1).first()["auroc"]
    out["auroc_top"] = stats.auroc(scored, "model_score", F.col("gt_bucket") == n_buckets - 1).first()["auroc"]
    out["ece_argmax"] = stats.ece(scored, "probs", "gt_bucket").first()["ece"]
    bins = stats.calibration_bins(scored, "model_score", "gt_bucket", n_buckets=n_buckets).orderBy("bin")
    out["calibration"] = [{k: r[k] for k in ("n", "mean_score", "mean_gt")} for r in bins.collect()]
    per = stats.describe(scored, "model_score", "gt_bucket").collect()
    out["per_gt_score"] = {str(r["gt_bucket"]): {k: v for k, v in r.asDict().items() if k != "gt_bucket"} for r in sorted(per, key=lambda r: r["gt_bucket"])}
    fields = ("preview", "gt_bucket", "model_bucket", "model_score", "cosine_score")
    far = stats.worst(scored, "gt_bucket", "model_bucket", "model_score", "sample_id", n_buckets=n_buckets)
    out["worst_disagreements"] = [{k: r[k] for k in fields} for r in far.collect()]
    if n_boot:
        cis = stats.bootstrap_cis(scored, n_boot=n_boot, seed=seed, n_buckets=n_buckets)
        out["cis"] = {r["stat"]: [r["low"], r["high"]] for r in cis.collect()}
    if with_source:
        own = scored.filter("source_score IS NOT NULL")
        control = stats.describe(own, "source_score").first().asDict()
        if control["n"]:
            share = own.agg(F.avg((F.col("source_bucket") == 0).cast("double"))).first()[0]
            out["source_control"] = {"frac_bucket0": share, "describe": control}
    return out


def _classes(n_buckets: int) -> dict[str, int]:
    """For each sweep the least bucket that is positive."""
    return {"human": 1, "light": 2, "top": n_buckets - 1}


def propose_bands(scored: DataFrame, *, n_buckets: int = N_BUCKETS, n_boot: int = 200, seed: int = 0) -> dict:
    """Band cuts from three sweeps between ground-truth buckets.

    Cuts never fall; the one without ground truth lies midway between its neighbours and isn't pinned. ``degenerate`` says
    that holding the order left a band without span. A sweep without two classes leaves the default cut.
    """
    sweeps = stats.balanced_accuracy_sweeps(scored, "model_score", "gt_bucket", _classes(n_buckets))
    default = dict(zip(SWEEPS, (DEFAULT[0].below, DEFAULT[1].below, DEFAULT[3].below)))
    raw = {name: sweeps[name]["threshold"] if sweeps[name] else default[name] for name in SWEEPS}
    human = raw["human"]
    light = max(human, raw["light"])
    top = max(light, raw["top"])
    cuts = [(human, sweeps["human"]), (light, sweeps["light"]), ((light + top) / 2, None), (top, sweeps["top"])]
    cis = {}
    if n_boot and any(sweeps.values()):
        found = stats.bootstrap_cuts(scored, _classes(n_buckets), n_boot=n_boot, seed=seed)
        cis = {r["stat"]: [r["low"], r["high"]] for r in found.collect() if sweeps[r["stat"]]}
    return {
        "boundaries": [{"cut": round(cut, 3), "band_below": band.label, "pinned": bool(sweep)} for (cut, sweep), band in zip(cuts, DEFAULT)],
        "sweeps": sweeps,
        "cut_cis": cis,
        "degenerate": light != raw["light"] or top != raw["top"] or human == top,
    }


def bands_artifact(report: dict, *, kind: str = KIND, dataset: str = "") -> dict:
    """The proposed cuts with their provenance, to be read by operators.bands.bands_from_artifact."""
    bands = report["bands"]
    return {
        "version": 1,
        "kind": kind,
        "model": report["model"],
        "cuts": [{"lt": b["cut"], "band": b["band_below"], "pinned": b["pinned"]} for b in bands["boundaries"]],
        "top_band": DEFAULT[-1].label,
        "cut_cis": bands["cut_cis"],
        "degenerate": bands["degenerate"],
        "provenance": {"dataset": dataset} | {k: report[k] for k in ("split", "seed", "n_used", "reliable_only", "quantized")},
    }


def compare_runs(samples: DataFrame, one: Any, two: Any, *, reliable_only: bool = True, with_source: bool = False, n_boot: int = 1000, with_metrics: bool = True) -> dict:
    """Two scorers over the same samples: paired differences, and (unless ``with_metrics`` is off) metrics and latency of each.

    Texts are cleaned and cut once and both results stay in one row, so runs are paired without a join.
    """
    _checked(one, two)
    both = detect_both(samples.select("sample_id", "text", F.col("preview").alias("__p"), "cosine_score", "gt_bucket"), one, two)
    both, seconds = kept(both)
    pairs = both.select(*[F.col(x)[c].alias(k + x) for x in "ab" for k, c in (("s", "score"), ("b", "bucket"), ("r", "reliable"))])
    out = stats.compare_columns(pairs, reliable_only=reliable_only).first().asDict()
    used = both.filter(F.col("a.reliable") & F.col("b.reliable")) if reliable_only else both
    runs = {x: _as_scored(used, x) for x in "ab"}
    for (x, run), scorer in zip(runs.items(), (one, two)) if with_metrics else ():
        run = _with_sources(run, samples, scorer) if with_source else run
        out[f"metrics_{x}"] = dataset_metrics(run, with_source=with_source, n_boot=n_boot)
        out[f"latency_{x}"] = latency(run, seconds)
    every = _as_scored(both, "a")
    return out | {"label_a": one.name, "label_b": two.name, "model": one.name, "device": "cluster", "seconds": seconds, "scored_a": _with_sources(every, samples, one) if with_source else every}


def compare_quant(samples: DataFrame, *, model: str = "llama", machine: Any = None, chosen: Any = chosen_scorer, **options: Any) -> dict:
    """The same model with and without 4-bit weights. Both need a CUDA device on which they work, and a model that has them."""
    runtime = plan_runtime(machine or this_machine(), model=model, quantize=True, device=options.pop("device", None))
    if runtime.model != "llama":
        raise ValueError(f"there are no 4-bit weights of a {runtime.model} model")
    pair = [chosen(runtime.model, device=runtime.device, quantize=q, machine=machine) for q in (True, False)]
    found = compare_runs(samples, *pair, **options)
    return found | {"label_a": "4-bit", "label_b": "unquantized"}


def compare_models(samples: DataFrame, *, kinds: Sequence[str] = KINDS, chosen: Any = chosen_scorer, device: str | None = None, machine: Any = None, **options: Any) -> dict:
    """The two kinds of model against each other."""
    return compare_runs(samples, *[chosen(k, device=device, machine=machine) for k in kinds], **options)


#: What the headline report can be compared with, beside another scorer.
COMPARISONS = {"quant": compare_quant, "models": compare_models}


def eval_dataset(
    samples: DataFrame, scorer: Any, *, against: Any = None, reliable_only: bool = True, with_source: bool = False,
    split: str = "test", seed: int = 0, n_boot: int = 1000,
) -> dict:
    """Report on labeled samples; the headline is the first scorer's.

    ``against``: a second scorer for a paired comparison, or a name of COMPARISONS.
    """
    if isinstance(against, str) and against not in COMPARISONS:
        raise ValueError(f"unknown comparison {against!r}; known: {', '.join(COMPARISONS)}")
    options = {"reliable_only": reliable_only, "with_source": with_source, "n_boot": n_boot}
    comparison = None
    if against is not None:
        comparison = COMPARISONS[against](samples, **options) if isinstance(against, str) else compare_runs(samples, scorer, against, **options)
    if comparison:
        scored, seconds = comparison.pop("scored_a"), comparison.pop("seconds")
    else:
        scored, seconds = kept(score_samples(samples, scorer, with_source=with_source))
    used = scored.filter("reliable") if reliable_only else scored
    metrics = dataset_metrics(used, with_source=with_source, n_boot=n_boot, seed=seed)
    return {
        "mode": "dataset", "n_total": samples.count(), "n_used": metrics["n"], "reliable_only": reliable_only, "split": split,
        "seed": seed, "model": scorer.name, "device": "cluster", "quantize": None, "quantized": False, "metrics": metrics,
        "bands": propose_bands(used, n_boot=min(n_boot, 200), seed=seed), "latency": latency(used, seconds), "compare": comparison,
    }


def eval_references(results: DataFrame, *, reliable_only: bool = False) -> dict:
    """Distribution of scores over scored targets (plans.score), overall and by source, and counts over thresholds.

    ``results`` is read often: save it first.
    """
    scored = results.filter(~F.col("skipped") & F.col("score").isNotNull())
    used = scored.filter("reliable") if reliable_only else scored
    empty = F.lit("")
    named = used.withColumn("__key", F.coalesce(F.nullif("source", empty), F.nullif("label", empty), F.lit(NO_LABEL)))
    first = {r["__key"]: r["first"] for r in named.groupBy("__key").agg(F.min("ordinal").alias("first")).collect()}
    by = sorted(stats.describe(named, "score", "__key").collect(), key=lambda r: first[r["__key"]])
    model = scored.filter(F.coalesce(F.col("model"), empty) != "").agg(F.min_by("model", "ordinal")).first()[0]
    counts = stats.threshold_counts(used, "score").collect()
    skipped = results.filter("skipped").orderBy("ordinal").select("label", "reason").collect()
    return {
        "mode": "refs", "n_scored": scored.count(), "n_skipped": len(skipped), "reliable_only": reliable_only, "model": model,
        "device": "cluster", "overall": stats.describe(used, "score").first().asDict(),
        "fp_table": [r.asDict() for r in counts],
        "by_source": {r["__key"]: {k: v for k, v in r.asDict().items() if k[:2] != "__"} for r in by},
        "results": used.drop("preview", "ordinal"), "skipped": [r.asDict() for r in skipped],
    }


def gradient_probe(samples: DataFrame, scorer: Any, *, bands: Sequence[Band] = DEFAULT) -> dict:
    """Whether the first text reads lowest and the last one highest."""
    rows = Workspace(samples.sparkSession).save(detect(samples, scorer, bands=bands).select("ordinal", "label", "score", "band"), "probe")
    ends = rows.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.min_by("score", "ordinal").alias("first"), F.max_by("score", "ordinal").alias("last")).first()
    order = stats.spearman(rows, "score", "ordinal").first()["spearman"]
    got = sorted(rows.collect(), key=lambda r: r["ordinal"])
    low, high = ends["first"] == ends["low"], ends["last"] == ends["high"]
    return {
        "mode": "smoke", "labels": [r["label"] for r in got], "scores": [r["score"] for r in got], "bands": [r["band"] for r in got],
        "human_is_min": low, "rewrite_is_max": high, "spearman_order": order, "passed": low and high, "model": scorer.name,
        "device": "cluster",
    }
