"""Tables that cut lineage, in sessions with and without the setting."""

import os
import subprocess
import sys

from folioflow import store

PROGRAM = """
import os
from pyspark.sql import SparkSession
from folioflow import store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
where = store.shared_dir(spark)
assert store.shared_dir(spark) == where and spark.conf.get("spark.checkpoint.dir", None) is None
with store.Steps(spark) as steps:
    a = steps.cut(spark.range(5))
    b = store.cut(a.selectExpr("id * 2 AS twice"))
assert sorted(r[0] for r in b.collect()) == [0, 2, 4, 6, 8]
print("left", len(os.listdir(where)), where)
"""


def test_session_without_the_setting(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "SPARK_CONF_DIR"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    ran = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr[-2000:]
    _, left, where = ran.stdout.split()
    assert left == "1"
    assert not [x for x in os.listdir(where) if not x.startswith(".")]  # gone with the program


def test_scratch_is_registered(spark):
    path = store.scratch(spark, "x")
    assert path.startswith(store.shared_dir(spark)) and path in store._left and path != store.scratch(spark, "x")


def test_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Files of the shared file system go to their places in the tasks that write them, none by the driver, and over those that Hadoop wrote."""
    moved = []
    monkeypatch.setattr(store, "replace_all", lambda spark, moves, threads=32: moved.extend(moves))
    path = str(tmp_path / "files")
    rows = spark.range(300).selectExpr("concat('n ', CAST(id % 100 AS STRING), '.txt') AS name", "id AS line", "concat('línea ', CAST(id AS STRING)) AS value")
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / ".n 7.txt.crc").write_bytes(b"crc\0of another")
    store.put_files(rows, path)
    store.put_files(rows.where("id % 100 < 50"), path)
    assert not moved
    assert sorted(os.listdir(path)) == sorted(f"n {i}.txt" for i in range(100))
    assert {r[0] for r in spark.read.text(path, wholetext=True).collect()} == {"".join(f"línea {i + k}\n" for k in (0, 100, 200)) for i in range(100)}
    store.put_files(rows.where("id < 0"), path)
    assert len(os.listdir(path)) == 100
