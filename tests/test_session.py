from __future__ import annotations

import logging

import pairwright
from pairwright.plans.session import LOG, session


def test_identity():
    assert pairwright.NAME == "pairwright" and pairwright.__version__ == ".".join(map(str, pairwright.VERSION_INFO))


def test_session(spark):
    assert session(log_level="ERROR") is not None and LOG.level == logging.ERROR
    assert session(log_level="ERROR").sparkContext is spark.sparkContext
