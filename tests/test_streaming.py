import json

from pyspark.sql import functions as F
from support import SF

from skyledger import fixtures as fx
from skyledger.schemas import GP
from skyledger.sources.bronze import scan_bronze
from skyledger.streaming import landings

ROW = "STARLINK-{n},2019-074A,2026-08-07T10:00:00.123456,15.05,0.0001,53.05,10,20,30,0,U,{n},999,100,1e-05,1e-05,0"


def csv(folder, name, numbers):
    folder.mkdir(exist_ok=True)
    lines = [",".join(c.upper() for c in GP.payload), *[ROW.format(n=n) for n in numbers], ""]
    (folder / name).write_text("\n".join(lines))


def sidecar(folder, name, text=None):
    folder.mkdir(exist_ok=True)
    record = {"ingested_at": "2026-08-07T20:17:37.187277+00:00", "ingestion_id": f"of {name}", "source": "feed",
              "source_file": name, "target": "active", "bytes": 1}
    (folder / f"{name}.meta.json").write_text(text or json.dumps(record, indent=2))


def test_files_wait_for_their_sidecars_and_sidecars_for_files(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")

    def run():
        landings.stream_land(spark, str(folder), table, GP, str(tmp_path / "state")).awaitTermination()
        return sorted((int(r.norad_cat_id), r.source_file, r.ingestion_id) for r in scan_bronze(spark, table, GP).collect())

    csv(folder, "a.csv", [1, 2])
    sidecar(folder, "a.csv")
    csv(folder, "b.csv", [3])
    sidecar(folder, "c.csv")
    sidecar(folder, "d.csv", "{ not a record")
    csv(folder, "d.csv", [9])
    first = [(1, "a.csv", "of a.csv"), (2, "a.csv", "of a.csv")]
    assert run() == first
    assert run() == first
    sidecar(folder, "b.csv")
    csv(folder, "c.csv", [4, 5])
    assert run() == first + [(3, "b.csv", "of b.csv"), (4, "c.csv", "of c.csv"), (5, "c.csv", "of c.csv")]
    assert len(run()) == 5


def test_parts_of_a_landing_share_its_sidecar(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")

    def run():
        landings.stream_land(spark, str(folder), table, GP, str(tmp_path / "state")).awaitTermination()
        return sorted((int(r.norad_cat_id), r.source_file) for r in scan_bronze(spark, table, GP).collect())

    folder.mkdir()
    csv(folder / "a.csv", "part-1.csv", [1])
    csv(folder / "a.csv", "part-2.csv", [2, 3])
    assert run() == []
    sidecar(folder, "a.csv")
    assert run() == [(1, "a.csv"), (2, "a.csv"), (3, "a.csv")]
    csv(folder / "a.csv", "part-3.csv", [4])
    assert run() == [(i, "a.csv") for i in (1, 2, 3, 4)]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    csv(folder, "a.csv", [1, 2])
    sidecar(folder, "a.csv")
    for state in ("one", "two"):  # a lost checkpoint replays everything
        landings.stream_land(spark, str(folder), table, GP, str(tmp_path / state)).awaitTermination()
    assert scan_bronze(spark, table, GP).count() == 2
