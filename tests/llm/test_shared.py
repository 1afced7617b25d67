import os

from tessera.llm import shared


def test_written_tables_stand_in_the_shared_folder(spark):
    df = shared.written(spark.range(10).toDF("a b"))
    path = shared._WRITTEN[-1]
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert path.startswith(base.rstrip("/")) and df.columns == ["a b"] and df.count() == 10


def test_cleared_removes_them_all(spark, monkeypatch):
    monkeypatch.setattr(shared, "_WRITTEN", [])
    paths = [(shared.written(spark.range(3)), shared._WRITTEN[-1])[1].removeprefix("file:") for _ in range(2)]
    assert all(map(os.path.isdir, paths)) and shared.cleared(spark) == 2 and not any(map(os.path.isdir, paths))
    assert shared.cleared(spark) == 0


def test_one_object_is_resident(monkeypatch):
    monkeypatch.setattr(shared, "_RESIDENT", {})
    made = []
    for key in ("a", "a", "b", "a"):
        shared.resident(key, lambda: made.append(key) or len(made))
    assert made == ["a", "b", "a"]
