import os

import pytest

from codeloom.__main__ import main
from codeloom.workspace import Workspace
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_reports(spark, capsys):
    w = Workspace(spark, DATA)
    assert all(df.columns for df in w.status().values())
    key = w.table("calls").where("resolved_callee_key is not null").first()["resolved_callee_key"]
    got = w.impact(key, 2, 50)
    assert got["callers"].count() <= 50 and got["pages"].columns == ["wiki_path", "symbol_key"]
    for bad in ((0, 5), (21, 5), (5, 0), (5, 2001)):
        with pytest.raises(ValueError):
            w.impact(key, *bad)
    with pytest.raises(ValueError):
        w.search("x", 101)
    assert {r["state"] for r in w.baseline().select("state").distinct().collect()} <= {"inferred", "unbaselined"}
    assert w.search("kept AND next", 5).count() <= 5 and w.search("((", 5).count() == 0
    page = w.pages.first()["wiki_path"]
    assert w.read(page).count() == 1
    assert w.change_impact(w.table("files").limit(3).select("path")).columns == ["what", "name", "rn", "total"]
    assert main(["top_files", DATA, "--limit", "3"]) == 0 and capsys.readouterr().out.count("\n") == 4


@pytest.mark.parametrize("name", ["obligations", "module_edges", "top_files", "undocumented_symbols", "risk_ranked"])
def test_row_order_does_not_matter(spark, tmp_path, name):
    import __spark_entry__ as entry

    for t in ("files", "symbols", "calls", "extracted_anchors", "symbol_snapshots", "file_contents"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df.orderBy(F.rand(7)).write.parquet(str(tmp_path / f"{t}.parquet"))
    q = entry.queries()[name]
    assert sorted(map(str, q(spark, DATA).collect())) == sorted(map(str, q(spark, str(tmp_path)).collect()))
