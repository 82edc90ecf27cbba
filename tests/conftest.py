from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from monthgrain.session import local_session  # noqa: E402

PANEL_SCHEMA = (
    "period_date date, series_id string, geography_level string, location_id int, location_name string, "
    "metric string, value double, source_snapshot_provisional boolean, source_snapshot_id bigint"
)
PREDICTION_SCHEMA = (
    "model string, series_id string, metric string, geography_level string, location_id int, location_name string, "
    "origin date, forecast_period date, horizon_step int, actual double, predicted double"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=2, app="monthgrain-tests")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def make_panel(spark):
    def make(*groups):
        return spark.createDataFrame([r for g in groups for r in g], PANEL_SCHEMA)

    return make


@pytest.fixture(scope="session")
def make_predictions(spark):
    def make(rows):
        return spark.createDataFrame(rows, PREDICTION_SCHEMA)

    return make
