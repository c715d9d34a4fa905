import json
import struct

import pytest

from inkgauge.checkpoints import Machine, adapter_buckets, batch_width, is_adapter, plan_runtime

GPU = Machine(cuda=True, four_bit=True, free_bytes=8 << 30)


def test_defaults():
    assert plan_runtime(Machine()) == ("cpu", "roberta", False, 512)
    assert plan_runtime(Machine(mps=True)) == ("mps", "llama", False, 1024)
    assert plan_runtime(GPU, model="auto") == ("cuda", "llama", True, 1024)
    assert plan_runtime(GPU, device="cuda:1", quantize=False).quantized is False
    assert plan_runtime(GPU, device="cpu") == ("cpu", "roberta", False, 512)


def test_errors():
    with pytest.raises(RuntimeError, match="4-bit"):
        plan_runtime(Machine(cuda=True), quantize=True)
    with pytest.raises(RuntimeError, match="4-bit"):
        plan_runtime(GPU, device="cpu", quantize=True)
    with pytest.raises(ValueError, match="unknown"):
        plan_runtime(GPU, model="x")


def test_width():
    cpu, gpu = plan_runtime(Machine()), plan_runtime(GPU)
    assert batch_width(3, cpu, Machine(), intermediate=4096) == 3 and batch_width(99, cpu, Machine(), intermediate=4096) == 8
    assert batch_width(99, gpu, GPU, intermediate=8192) == int((8 << 30) * 0.5 / (1024 * 8192 * 2 * 24))
    assert batch_width(99, gpu, GPU._replace(free_bytes=1), intermediate=8192) == 1
    assert batch_width(99, gpu, GPU._replace(free_bytes=1 << 50), intermediate=8192) == 64


def test_adapter(tmp_path):
    assert not is_adapter(str(tmp_path))
    (tmp_path / "adapter_config.json").write_text("{}")
    assert is_adapter(str(tmp_path))
    for key, shape in (("base.score.linear.weight", [4, 8]), ("other", [2, 2])):
        header = json.dumps({key: {"dtype": "F32", "shape": shape, "data_offsets": [0, 0]}}).encode()
        (tmp_path / "adapter_model.safetensors").write_bytes(struct.pack("<Q", len(header)) + header)
        if "score" in key:
            assert adapter_buckets(str(tmp_path)) == 4
        else:
            with pytest.raises(ValueError):
                adapter_buckets(str(tmp_path))
