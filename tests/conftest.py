import json
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from lotline.session import apply_conf
    s = (SparkSession.builder.master("local[4]").appName("lotline-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "6g")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lotline-test-ckpt-"))
    apply_conf(s)
    yield s


def records_df(spark, records, source_url="https://express.dealer-t.example.com/inventory", dealer="Dealer T"):
    """Vehicle records (Python dicts / values) as extract() output rows."""
    from pyspark.sql import functions as F
    rows = [(dealer, 0, source_url, "x", i, json.dumps(r)) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "dealer string, page_no long, source_url string, path string, pos int, j string")
    return df.select("dealer", "page_no", "source_url", "path", "pos", F.parse_json("j").alias("rec"))


def normalize_one(spark, spec, record, **kw):
    from lotline.operators.normalize import normalize_records
    out = normalize_records(spec, records_df(spark, [record], **kw)).collect()
    assert len(out) == 1
    return out[0].asDict()
