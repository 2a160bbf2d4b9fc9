import time

from pyspark.sql import functions as F

from arbordex import project as module
from arbordex.background import start_scan
from arbordex.project import Project


def test_scans_that_run_at_once(spark, tmp_path, monkeypatch):
    """Two projects are scanned; the slow one is cancelled, the other ends."""
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.gd").write_text("class_name A\n")
    one, two = (Project(spark, str(tmp_path / n), str(tmp_path / f"{n}-store")) for n in ("one", "two"))
    plain = module.Scan.parse
    slow = F.udf(lambda x: (time.sleep(60), x)[1], "string")
    monkeypatch.setattr(module.Scan, "parse", lambda self, changed: (changed.withColumn("path", slow("path")).collect() if self.project.root.endswith("two") else None, plain(self, changed))[1])
    first, second = start_scan(one), start_scan(two)
    assert second.status()["state"] == "running"
    done = first.wait(180)
    assert (done["state"], done["generation"], done["error"]) == ("completed", 1, "") and one.class_count() == 1
    until = time.time() + 120
    while time.time() < until and not second.status()["tasks_known"]:
        time.sleep(0.5)
    now = second.status()
    assert now["state"] == "running" and now["generation"] == 0 and 0 <= now["share"] <= 1 and now["seconds"] > 0
    second.cancel()
    ended = second.wait(100)
    assert ended["state"] == "cancelled" and two.scan_status().first().status == "cancelled" and two.file_count() == 0
    assert [r.status for r in one.store.table("metrics").collect()] == ["completed"]


def test_a_scan_that_fails_says_so(spark, tmp_path, monkeypatch):
    (tmp_path / "t").mkdir()
    project = Project(spark, str(tmp_path / "t"), str(tmp_path / "store"))
    monkeypatch.setattr(module.Scan, "merge", lambda *a: 1 / 0)
    ended = start_scan(project).wait(120)
    assert (ended["state"], ended["error"]) == ("failed", "division by zero")
    assert project.scan_status().first().error == "division by zero"
