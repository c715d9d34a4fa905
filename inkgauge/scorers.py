"""Scorers: what turns a window's text into bucket probabilities.

A scorer either is an expression (the plan stays in the JVM) or runs a model over Arrow batches in Python workers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import CALIBRATED, KINDS, WIDTH, Machine, Runtime, adapter_base, adapter_buckets, batch_width, find_checkpoint, is_adapter, plan_runtime
from .functions.numeric import argmax, confidence, expected_score, softmax

SCORE_TYPE = "struct<score:double,bucket:int,probs:array<double>,confidence:double,truncated:boolean,latency_s:double>"


class ScorerUnavailableError(RuntimeError):
    """A model can't be loaded here: a package or its weights are missing."""


class ScorerAccessError(ScorerUnavailableError):
    """A checkpoint is there but may not be read: its terms aren't accepted or no key is given."""


class Scorer(Protocol):
    """Scores windows. ``name`` and ``calibrated`` go to the results; ``n_buckets`` to the decoding."""

    name: str
    calibrated: bool
    n_buckets: int


class ExpressionScorer:
    """A scorer whose result is a Column made from the window's struct."""

    name, calibrated, n_buckets = "expression", True, 4

    def expression(self, window: Column) -> Column:
        raise NotImplementedError


class LengthStub(ExpressionScorer):
    """Stand-in for a model: the score grows with the text's length up to 1.

    ``varied`` spreads probabilities over all buckets, lets the confidence follow the window's words and truncates windows of
    more than ``max_chars``, so that nothing in a result is constant.
    """

    def __init__(self, scale: int = 10_000, name: str = "stub", calibrated: bool = True, *, varied: bool = False, max_chars: int = 2_400):
        self.scale, self.name, self.calibrated, self.varied, self.max_chars = scale, name, calibrated, varied, max_chars

    def expression(self, window: Column) -> Column:
        chars = F.char_length(window["text"])
        s = F.least(F.lit(1.0), chars / float(self.scale))
        plain = F.array(1 - s, F.lit(0.0), F.lit(0.0), s)
        spread = F.array((1 - s) * 0.5, (1 - s) * 0.5, s * 0.25, s * 0.75)
        return F.struct(
            s.alias("score"),
            F.rint(s * 3).cast("int").alias("bucket"),
            (spread if self.varied else plain).alias("probs"),
            (window["n_words"] / 400.0 if self.varied else F.lit(0.9)).alias("confidence"),
            (chars > self.max_chars if self.varied else F.lit(False)).alias("truncated"),
            F.lit(None).cast("double").alias("latency_s"),
        )


class LogitsScorer(ExpressionScorer):
    """Decodes logits that an expression gives for each window."""

    def __init__(self, logits: Callable[[Column], Column], *, n_buckets: int = 4, name: str = "logits", max_length: int | None = None, raw_length: Callable[[Column], Column] | None = None):
        self.logits, self.n_buckets, self.name = logits, n_buckets, name
        self.max_length, self.raw_length = max_length, raw_length

    def expression(self, window: Column) -> Column:
        over = self.raw_length(window) > self.max_length if self.raw_length and self.max_length else F.lit(False)
        return decoded(self.logits(window), over)


def decoded(logits: Column, truncated: Column) -> Column:
    """Score, bucket (first largest), probabilities, confidence and the flag, from logits."""
    probs = softmax(logits)
    return F.struct(
        expected_score(probs).alias("score"),
        argmax(probs).alias("bucket"),
        probs.alias("probs"),
        confidence(probs).alias("confidence"),
        truncated.alias("truncated"),
        F.lit(None).cast("double").alias("latency_s"),
    )


#: Models of this Python worker by their key; loaded once, kept while the worker lives.
_models: dict[Any, Callable] = {}


def cached_model(key: Any, load: Callable[[], Callable]) -> Callable:
    if key not in _models:
        _models[key] = load()
    return _models[key]


def is_out_of_memory(error: BaseException) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def run_with_backoff(forward: Callable[[list[str]], list], texts: Sequence[str], width: int) -> list:
    """Run batches of ``width``; when memory runs out, halve the width and try again, at 1 give up. It never grows back.

    Results that are dicts get latency_s: the time of their batch, shared out evenly.
    """
    out: list = []
    while len(out) < len(texts):
        batch = list(texts[len(out) : len(out) + width])
        began = time.perf_counter()
        try:
            got = forward(batch)
        except (RuntimeError, MemoryError) as error:
            if width == 1 or not is_out_of_memory(error):
                raise
            width = max(1, width // 2)
            continue
        if len(got) != len(batch):
            raise ValueError(f"the model returned {len(got)} results for {len(batch)} texts")
        share = (time.perf_counter() - began) / len(batch)
        out += [x | {"latency_s": share} if isinstance(x, dict) else x for x in got]
    return out


def decode_numpy(logits: np.ndarray, raw_lengths: Sequence[int], max_length: int | None) -> list[dict]:
    """The decoding of logits in a Python worker; the same formulas as the expressions."""
    logits = np.asarray(logits, dtype=float)
    if not np.isfinite(logits).all():
        raise RuntimeError("non-finite logits")
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    probs = powers / powers.sum(axis=1, keepdims=True)
    n = probs.shape[1]
    scores = probs @ np.arange(n) / (n - 1)
    sure = 1 + (probs * np.log(np.maximum(probs, 1e-9))).sum(axis=1) / np.log(n)
    over = [max_length is not None and x > max_length for x in raw_lengths]
    return [
        {"score": float(s), "bucket": int(p.argmax()), "probs": p.tolist(), "confidence": float(c), "truncated": bool(o)}
        for s, p, c, o in zip(scores, probs, sure, over)
    ]


class BatchScorer:
    """A Python model over Arrow batches.

    ``load()`` runs once per worker and returns ``forward(texts) -> list of results`` (dicts as SCORE_TYPE, where latency_s is
    filled in here). Windows of all documents of an Arrow batch are scored together, ``width`` at a time (or ``forward.width``,
    if the model knows better once it is loaded), with backoff when memory runs out.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list[dict]]], *, key: Any, name: str, width: int = WIDTH, n_buckets: int = 4, calibrated: bool = True):
        self.load, self.key, self.name = load, key, name
        self.width, self.n_buckets, self.calibrated = width, n_buckets, calibrated

    def score_arrays(self, df: DataFrame, windows_col: str, out_col: str) -> DataFrame:
        """Add an array of results parallel to the array of windows."""
        load, key, width = self.load, self.key, self.width

        @F.pandas_udf(f"array<{SCORE_TYPE}>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            forward = cached_model(key, load)
            for texts in batches:
                flat = [t for some in texts for t in some]
                results = iter(run_with_backoff(forward, flat, getattr(forward, "width", width)))
                yield pd.Series([[next(results) for _ in some] for some in texts])

        texts = F.transform(F.coalesce(F.col(windows_col), F.array()), lambda w: w["text"])
        return df.withColumn(out_col, score(texts))


def add_scores(df: DataFrame, scorer: Any, windows_col: str, out_col: str) -> DataFrame:
    """Score every window of every row, in place: no explode and no shuffle, whichever kind of scorer it is."""
    if isinstance(scorer, ExpressionScorer):
        return df.withColumn(out_col, F.transform(windows_col, scorer.expression))
    return scorer.score_arrays(df, windows_col, out_col)


def this_machine() -> Machine:
    """What the process that asks can run on; nothing at all without torch."""
    try:
        import torch
    except ImportError:
        return Machine()
    cuda = torch.cuda.is_available()
    four_bit = False
    if cuda:
        try:
            import bitsandbytes  # noqa: F401

            four_bit = True
        except ImportError:
            pass
    mps = getattr(torch.backends, "mps", None) is not None and torch.backends.mps.is_available()
    return Machine(cuda=cuda, mps=mps, four_bit=four_bit, free_bytes=torch.cuda.mem_get_info()[0] if cuda else 0)


def _opened(what: str, open_it: Callable[[], Any]) -> Any:
    """Run ``open_it``; tell apart what may not be read from what isn't there."""
    try:
        return open_it()
    except OSError as error:
        said = str(error)
        if any(x in said.lower() for x in ("gated", "401", "403", "restricted", "permission denied", "awaiting")):
            raise ScorerAccessError(f"{what} may not be read: accept its terms where it is published and log in there. ({said})") from error
        raise ScorerUnavailableError(f"{what} can't be found or read; name its folder by --checkpoints or -m. ({said})") from error


def _adapted(folder: str, base: str, buckets: int, four_bit: bool) -> Any:
    """A base model with an adapter on it and the adapter's own scoring head (norm, then a linear layer)."""
    import torch
    from peft import PeftModel
    from transformers import AutoModelForSequenceClassification, BitsAndBytesConfig

    small = BitsAndBytesConfig(load_in_4bit=True, bnb_4bit_quant_type="nf4", bnb_4bit_compute_dtype=torch.bfloat16) if four_bit else None
    net = AutoModelForSequenceClassification.from_pretrained(base, num_labels=buckets, quantization_config=small)
    width = net.config.hidden_size
    net.score = torch.nn.ModuleDict({"norm": torch.nn.LayerNorm(width), "linear": torch.nn.Linear(width, buckets)})
    net.score.forward = lambda x: net.score["linear"](net.score["norm"](x))
    return PeftModel.from_pretrained(net, folder)


def transformer_scorer(
    model: str, *, base: str | None = None, runtime: Runtime | None = None, device: str | None = None, name: str | None = None,
    calibrated: bool = False, n_buckets: int = 4,
) -> BatchScorer:
    """A sequence-classification checkpoint, or an adapter on one; unverified where its packages or weights are missing.

    The number of buckets is the checkpoint's own. Only a checkpoint that the bands were tuned for is ``calibrated``.
    """
    place = runtime or Runtime(device or "cpu", name or model, False, 512)

    def load() -> Callable[[list[str]], list[dict]]:
        try:
            import torch
            from transformers import AutoConfig, AutoModelForSequenceClassification, AutoTokenizer
        except ImportError as error:
            raise ScorerUnavailableError("this scorer needs torch and transformers on the executors") from error
        adapter = is_adapter(model)
        under = base or (adapter_base(model) if adapter else model)
        tokenizer = _opened(under, lambda: AutoTokenizer.from_pretrained(under))
        if adapter:
            net = _opened(under, lambda: _adapted(model, under, adapter_buckets(model), place.quantized))
        else:
            net = _opened(model, lambda: AutoModelForSequenceClassification.from_pretrained(model, config=AutoConfig.from_pretrained(model)))
        if tokenizer.pad_token is None:  # decoders have none: pad with the end, behind the text
            tokenizer.pad_token, tokenizer.padding_side = tokenizer.eos_token, "right"
        net.config.pad_token_id = tokenizer.pad_token_id
        net = net.eval() if place.quantized else net.eval().to(place.device)

        def forward(texts: list[str]) -> list[dict]:
            lengths = [len(x) for x in tokenizer(texts)["input_ids"]]
            inputs = tokenizer(texts, truncation=True, max_length=place.max_tokens, padding=True, return_tensors="pt").to(net.device)
            with torch.inference_mode():
                return decode_numpy(net(**inputs).logits.float().cpu().numpy(), lengths, place.max_tokens)

        forward.width = batch_width(64, place, this_machine(), intermediate=getattr(net.config, "intermediate_size", 4096))
        return forward

    buckets = adapter_buckets(model) if is_adapter(model) else n_buckets
    return BatchScorer(load, key=(model, base, place), name=name or model, n_buckets=buckets, calibrated=calibrated)


def chosen_scorer(
    model: str = "auto", *, checkpoints: str | None = None, base: str | None = None, device: str | None = None,
    quantize: bool | None = None, machine: Machine | None = None,
) -> Any:
    """The scorer for a name: ``stub``; a known kind of model, or ``auto`` for the best this machine runs; or a checkpoint.

    Kinds are looked up as folders below ``checkpoints``. The bands are tuned for one kind only.
    """
    if model == "stub":
        return LengthStub()
    if model in ("auto", *KINDS):
        runtime = plan_runtime(machine or this_machine(), device=device, model=model, quantize=quantize)
        return transformer_scorer(find_checkpoint(runtime.model, checkpoints), base=base, runtime=runtime, name=runtime.model, calibrated=runtime.model in CALIBRATED)
    return transformer_scorer(model, base=base, device=device)
