import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from holdfast.schema import BOUNDS, CATEGORIES, CUSTOMER_SCHEMA, ID, TARGET  # noqa: E402
from holdfast.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def customers(n=100, seed=42):
    """Valid customer rows, drawn from the limits and sets of the customer table."""
    rng = np.random.default_rng(seed)
    columns = {}
    for field in CUSTOMER_SCHEMA.fields:
        name = field.name
        if name == ID:
            columns[name] = [f"CUST_{i}" for i in range(n)]
        elif name in CATEGORIES:
            columns[name] = rng.choice(sorted(CATEGORIES[name]), n)
        elif name == TARGET:
            columns[name] = (rng.random(n) < 0.3).astype(int)
        else:
            low, high = BOUNDS[name]
            drawn = rng.uniform(low, low + 0.45 * (high - low), n)   # some rows meet no rule
            whole = field.dataType.typeName() in ("integer", "long")
            columns[name] = drawn.astype(int) if whole else drawn
    return pd.DataFrame(columns)


@pytest.fixture()
def valid():
    return customers()


@pytest.fixture(scope="session")
def three(spark):
    """Three rows whose numbers have plain means, with all three subscriptions and contracts."""
    pdf = customers(3, seed=1)
    for i, field in enumerate(f for f in CUSTOMER_SCHEMA.fields if f.name in BOUNDS):
        whole = field.dataType.typeName() in ("integer", "long")
        pdf[field.name] = [20 + i, 26 + 2 * i, 32 + 3 * i] if whole else [240.5, 360.5, 480.5]
    for name, values in CATEGORIES.items():
        order = sorted(values)
        pdf[name] = [order[i % len(order)] for i in range(3)]
    pdf[TARGET] = [1, 0, 0]
    return spark.createDataFrame(pdf)
