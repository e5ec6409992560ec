import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from crossrank.session import local_session

    session = local_session(4, "crossrank-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walk_panel(spark):
    """Random-walk prices of 30 symbols on business days, with the tables most tests need."""
    import numpy as np
    import pandas as pd

    from crossrank.operators import calendar as cal
    from crossrank.staging import stage

    rng = np.random.default_rng(7)
    days = pd.bdate_range("2019-01-01", "2021-12-31")
    frames = []
    for i in range(30):
        steps = rng.normal(0, 0.005 + 0.001 * i, len(days))
        frames.append(pd.DataFrame({"symbol": f"A{i:02d}", "date": days.date, "price": 100 * np.exp(np.cumsum(steps))}))
    frame = pd.concat(frames, ignore_index=True)
    prices = stage(spark.createDataFrame(frame, "symbol string, date date, price double"), "walk", "symbol", 4)
    table = stage(cal.trading_days(prices), "walk_days")
    grid = cal.resolve(cal.period_grid(spark, "2021-01-01", "2021-12-31"), table)
    return frame, prices, table, stage(grid, "walk_calendar")
