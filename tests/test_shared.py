"""Tables in the shared folder: where they lie, and that they go."""

import os
import subprocess
import sys
import time
from types import SimpleNamespace

import pytest

from veilframe.sources import shared


def test_a_cluster_without_a_shared_folder_is_refused():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(session)


def test_written_tables_go_with_their_session(tmp_path):
    code = f"""
import os, sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from veilframe.session import local_session
from veilframe.sources.shared import new_path, written
spark = local_session(1, "passing", **{{"spark.driver.memory": "1g", "spark.checkpoint.dir": "file://{tmp_path}"}})
df, path = written(spark.range(3), "some")
assert df.count() == 3 and os.path.isdir(path.removeprefix("file://"))
df.write.parquet(new_path(spark, "kept"))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    for _ in range(100):  # the JVM ends a little after its driver
        left = {p.name.split("-")[0] for p in tmp_path.iterdir()} & {"passing", "kept"}
        if left == {"kept"}:
            break
        time.sleep(0.1)
    assert left == {"kept"}
