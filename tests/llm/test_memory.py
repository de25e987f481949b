"""What a Python worker holds once a vocabulary's encoder is there."""

from __future__ import annotations

import subprocess
import sys

import pytest

from tests.conftest import ROOT

HELD = """
import gc, re, sys
sys.path.insert(0, sys.argv[1])
from pathlib import Path
import numpy, pandas, pyarrow, tiktoken, tokenizers
from tessera.llm.queries import vocabulary
from tessera.llm.tokens import id_encoder

def held():
    gc.collect()
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

before = held()
ids = id_encoder(vocabulary())(["some words"])
print(held() - before, len(ids[0]))
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_an_encoder_keeps_little_more_than_its_tables():
    got = subprocess.run([sys.executable, "-c", HELD, ROOT], capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) < 115 and int(got[1]) == 8
