import json

import pytest

from parlance.sources import versions


def test_publish_points_to_whole_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, root)
    for k in range(5):
        manifest = versions.publish(spark.createDataFrame([(i, float(k), None) for i in range(k)], "id long, v double, n string"), root, keep=2)
        assert manifest["version"] == k + 1 and manifest["rows"] == k
        # another session sees it
        other = spark.newSession()
        assert sorted(r["v"] for r in versions.read_current(other, root).collect()) == [float(k)] * k and versions.verify(other, root)
    folders = sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v-") and p.is_dir())
    assert [f[:10] for f in folders] == ["v-00000004", "v-00000005"]
    assert json.loads((tmp_path / "t" / "CURRENT").read_text())["previous"] == folders[0]


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    versions.publish(spark.createDataFrame([(1,)], "id long"), root)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "write_text", killed)
        with pytest.raises(KeyboardInterrupt):
            versions.publish(spark.createDataFrame([(2,)], "id long"), root)
    assert [r["id"] for r in versions.read_current(spark, root).collect()] == [1] and versions.verify(spark, root)
    assert versions.publish(spark.createDataFrame([(3,)], "id long"), root)["version"] == 3
    assert [r["id"] for r in versions.read_current(spark, root).collect()] == [3]


def test_changed_files_do_not_verify(spark, tmp_path):
    root = str(tmp_path / "t")
    manifest = versions.publish(spark.createDataFrame([(1,), (2,)], "id long"), root)
    spark.createDataFrame([(9,)], "id long").write.mode("append").parquet(f"{root}/{manifest['path']}")
    assert not versions.verify(spark, root)


def test_export(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", 2, 0.123456), ("a", 1, float("nan")), ("007 +é%/c", 1, 2.0), (None, 1, 1.0), ("", 1, 1.0)], "k string, n int, x double")
    none = rows.where("n > 9")
    manifest = {r["kind"]: r for r in versions.export_all({"one": (rows, "k", ["n"]), "none": (none, "k", ["n"])}, root).collect()}
    assert (manifest["one"]["files"], manifest["one"]["rows"], manifest["one"]["skipped"]) == (2, 3, 2)
    assert (manifest["none"]["files"], manifest["none"]["rows"]) == (0, 0)
    lines = [tuple(r) for r in versions.read_snapshots(spark, root, "one").where("key = 'a'").collect()]
    assert lines == [("a", '{"k":"a","n":1}'), ("a", '{"k":"a","n":2,"x":0.1235}')]
    assert versions.read_snapshots(spark, root, "one").where("key = '007 +é%/c'").count() == 1
    assert {r["kind"] for r in json.loads((tmp_path / "s" / "manifest.json").read_text())} == {"one", "none"}
    assert versions.export_all({"one": (rows, "k", ["n"])}, root).first()["checksum"] == manifest["one"]["checksum"]
