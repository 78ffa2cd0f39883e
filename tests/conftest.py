import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from webrel.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8, app="webrel-tests")
    yield s


def html_df(spark, html: str, url: str = "http://a.example.com/x/y", page_id: int = 1):
    return spark.createDataFrame([(page_id, url, html)], "page_id bigint, url string, html string")
