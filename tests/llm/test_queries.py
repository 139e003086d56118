"""Every numbered query is registered once; those that SQL can express agree with it."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from tests.llm.conftest import SF


def test_one_query_for_each_operator():
    numbered = [m[1] for k in E.queries() if (m := re.match(r"op(\d+)_", k))]
    assert sorted(map(int, numbered)) == list(range(1, 14)) and "pipeline" in E.queries()


@pytest.mark.parametrize("key", ["op2_decontamination", "op6_line_dedup", "op7_warc", "op9_chat_format", "op13_filter_audit"])
def test_matches_sql(spark, key):
    con = duckdb.connect()
    for t in "documents benchmark pages conversations labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[key](spark, SF)
    rel = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(map(tuple, rel.fetchall()), key=repr)


def test_scratch_folder_can_be_dropped(spark):
    from lotline.llm import common
    from lotline.sources.store import list_dirs
    assert common.written(spark.range(3), "t").count() == 3
    assert list_dirs(spark, common._own(spark))
    common.drop_scratch(spark)
    assert list_dirs(spark, common._own(spark)) == []


def test_executors_find_the_code_wherever_the_driver_runs(tmp_path):
    """No PYTHONPATH and another working folder: the package goes along with the job."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    code = ("import sys; sys.path.insert(0, sys.argv[1])\nimport __spark_entry__ as E\n"
            "from lotline.session import get_spark\nspark = get_spark('local[2]', 4)\n"
            "print('rows', E.queries()['op2_decontamination'](spark, sys.argv[2]).count(), "
            "E.queries()['op7_warc'](spark, sys.argv[2]).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, root, SF], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=600)
    assert "rows " in out.stdout, out.stderr[-3000:]
