import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])

from llm_rows import SCHEMA, rows  # noqa: E402

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def ranks():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return SF


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
