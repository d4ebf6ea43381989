import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from moralens.session import local_session  # noqa: E402
from moralens.sources.panel import staged_panel  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def checkpoint_dir(tmp_path_factory):
    return str(tmp_path_factory.mktemp("checkpoints"))


@pytest.fixture(scope="session")
def spark(checkpoint_dir):
    session = local_session("tests", 4, {"spark.checkpoint.dir": checkpoint_dir})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    return staged_panel(spark, SMALL)


@pytest.fixture(scope="session")
def sample(spark):
    """The 20-row inline sample of the survey, with a row id."""
    ages = list(range(25, 75, 5)) * 2
    incomes = [*range(50000, 95000, 5000), 100000] * 2
    rows = [
        (i, ages[i], incomes[i], i % 2, "MF"[i % 2], "AB"[i % 2]) for i in range(20)
    ]
    return spark.createDataFrame(rows, "row_id bigint, edad int, ingresos int, pago int, genero string, categoria string")
