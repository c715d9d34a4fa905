"""What a model's runtime is set to on an executor, and what kind of checkpoint lies in a folder.

Nothing here needs a model library: what the machine offers is passed in, and headers are read as plain files.
"""

from __future__ import annotations

import json
import os
import struct
from pathlib import Path
from typing import NamedTuple

#: Kinds of models and the tokens they read. Fixed values.
MAX_TOKENS = {"llama": 1024, "roberta": 512}
KINDS = tuple(MAX_TOKENS)
#: Kinds that the default bands are tuned for. Fixed value.
CALIBRATED = ("llama",)
#: Windows a batch: fixed off CUDA, at most so many on it; the share of free memory to plan for; activations per window.
WIDTH, MOST_WINDOWS, MEMORY_SHARE, ACTIVATIONS = 8, 64, 0.5, 24


class Machine(NamedTuple):
    """What an executor offers."""

    cuda: bool = False
    mps: bool = False
    four_bit: bool = False  # a 4-bit kernel that works with its CUDA device
    free_bytes: int = 0


class Runtime(NamedTuple):
    device: str
    model: str
    quantized: bool
    max_tokens: int


def plan_runtime(machine: Machine, *, device: str | None = None, model: str | None = None, quantize: bool | None = None) -> Runtime:
    """Fill in what isn't asked for: the best device there is, the larger model on an accelerator, 4 bits where they work.

    ``auto`` is no model of its own but asks for the default. Asking for 4 bits where they don't work is an error.
    """
    place = device or ("cuda" if machine.cuda else "mps" if machine.mps else "cpu")
    fast = place.split(":")[0] in ("cuda", "mps")
    name = model if model not in (None, "auto") else "llama" if fast else "roberta"
    if name not in MAX_TOKENS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(MAX_TOKENS))}")
    works = machine.four_bit and place.startswith("cuda")
    if quantize and not works:
        raise RuntimeError(f"4-bit weights were asked for, but don't work on {place}")
    return Runtime(place, name, works if quantize is None else quantize, MAX_TOKENS[name])


def batch_width(windows: int, runtime: Runtime, machine: Machine, *, intermediate: int) -> int:
    """Windows to score at a time: fixed without CUDA; on it, what the planned share of free memory holds (1 at least)."""
    if not runtime.device.startswith("cuda"):
        return min(windows, WIDTH)
    window = runtime.max_tokens * intermediate * 2 * ACTIVATIONS
    return max(1, min(windows, MOST_WINDOWS, int(machine.free_bytes * MEMORY_SHARE / window)))


def find_checkpoint(kind: str, folder: str | None = None) -> str:
    """The folder of a kind of model: below ``folder``, or below what INKGAUGE_CHECKPOINTS names."""
    root = folder or os.environ.get("INKGAUGE_CHECKPOINTS")
    where = Path(root) / kind if root else None
    if where is None or not where.is_dir():
        raise FileNotFoundError(
            f"no checkpoint of a {kind} model{f' in {root}' if root else ''}: give the folder that holds it with --checkpoints "
            "(or INKGAUGE_CHECKPOINTS), a checkpoint with -m, or score by length alone with -m stub"
        )
    return str(where)


def adapter_base(folder: str) -> str:
    """The base model that an adapter names."""
    return json.loads((Path(folder) / "adapter_config.json").read_text())["base_model_name_or_path"]


def is_adapter(folder: str) -> bool:
    """Whether a checkpoint is an adapter on a base model."""
    return (Path(folder) / "adapter_config.json").is_file()


def adapter_buckets(folder: str) -> int:
    """The number of buckets an adapter scores: the rows of its scoring layer, from the header of its weights alone."""
    with (Path(folder) / "adapter_model.safetensors").open("rb") as file:
        (length,) = struct.unpack("<Q", file.read(8))
        header = json.loads(file.read(length))
    rows = [v["shape"][0] for k, v in header.items() if "score" in k and "linear.weight" in k]
    if not rows:
        raise ValueError(f"the adapter in {folder} has no scoring layer")
    return rows[0]
