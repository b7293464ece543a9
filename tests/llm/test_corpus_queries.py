"""Registered corpus queries against their check SQL at the smallest scale."""

import importlib

import pytest

from oracle import compare, connect
from trajlytics.llm import queries


@pytest.mark.parametrize("name", [*queries.callables()])
def test_query(spark, sf_dir, name):
    ok, message = compare(spark, connect(sf_dir), name, queries.callables()[name], queries.checks().get(name), sf_dir)
    assert ok, message


def test_pipeline_is_registered(spark, sf_dir):
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.callables()) | {"pipeline"} <= set(entry.queries())
    assert entry.queries()["pipeline"](spark, sf_dir).count() > 0
