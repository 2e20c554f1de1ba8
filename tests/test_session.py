import os
import subprocess
import sys


def test_clear_work_removes_only_this_applications_scratch(tmp_path):
    """A session of its own, because the folder is gone afterwards."""
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from txnwatch.session import build_session, clear_work, work_dir
spark = build_session("local[1]", 1, extra={{"spark.checkpoint.dir": {str(tmp_path / 'shared')!r}, "spark.driver.memory": "1g"}})
spark.range(3).write.parquet(work_dir(spark, "t"))
clear_work(spark)
"""
    other = tmp_path / "shared" / "other"
    other.mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    assert [p.name for p in (tmp_path / "shared").iterdir()] == ["other"]
