"""Options that aren't valid fall back as stated."""

import pytest
from pyspark.sql import functions as F

from larder.sources import options as O


@pytest.mark.parametrize("rate, kept, warned", [(5, 5, 0), (0, None, 1), (-1, None, 1), (True, None, 1), (2.0, None, 1), ("3", None, 1), (None, None, 1)])
def test_rates(rate, kept, warned):
    s = O.service({"max_requests_per_minute": rate})
    assert (s.per_minute, len(s.warnings)) == (kept, warned)


def test_service():
    assert O.service(None) == O.Service()
    s = O.service({"on_failure": "explode", "request_timeout_seconds": "soon", "cache_enabled": 0})
    assert (s.on_failure, s.timeout, s.cache, len(s.warnings)) == ("skip", 30.0, False, 1)
    assert O.service({"request_timeout_seconds": 5}).timeout == 5.0 and O.service({"request_timeout_seconds": True}).timeout == 30.0


def test_detection():
    assert O.detection({}) == O.Detection()
    assert O.detection({"feature": "TEXT_DETECTION", "language_hints": ["en", "pt"], "max_image_dimension": "x"}) == O.Detection("TEXT_DETECTION", ("en", "pt"))
    assert O.detection({"feature": 7}).invalid == "7" and O.detection({"feature": 7}).feature == O.FEATURES[0] and O.detection({"max_image_dimension": -4}).side == 0


def test_outside_models_may_fail(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")

    def broken(texts):
        raise OSError

    assert [r[0] for r in O.external(df, "t", broken).collect()] == ["a", "b"] == [r[0] for r in O.external(df, "t").collect()]
    texts = [("", False), ("   ", False), ("açúcar, sal", False), ("Não há ingredientes, desculpe", True), ("x" * 61, True), ("x" * 30 + "," + "y" * 40, False)]
    got = spark.createDataFrame(texts, "t string, w boolean").select(O.is_refusal(F.col("t")), "w").collect()
    assert all(a == b for a, b in got)
