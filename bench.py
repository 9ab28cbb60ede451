"""Bench: headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from skyledger import fixtures as fx
from skyledger.operators import spatial, tracks, visibility
from skyledger.operators.propagate import propagate
from skyledger.plans import warehouse
from skyledger.queries import base, registry
from skyledger.schemas import GP
from skyledger.session import local_session, scratch_path
from skyledger.sources.bronze import load_insert_if_absent

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
BERLIN = [(-1, *fx.BERLIN)]


def drain(df) -> None:
    """Compute every row and column of a result without moving it to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "skyledger-bench", tempfile.mkdtemp(prefix="skyledger-bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name: str, work, warm: bool = True) -> None:
        for _ in range(2 if warm else 0):
            work()
        start = time.perf_counter()
        work()
        timings[name] = round(time.perf_counter() - start, 3)

    # The feeds as they lie in bronze.
    raw = scratch_path(spark, "bench-bronze")
    fx.raw_gp(spark, SF_DIR).repartition(CPUS).write.parquet(f"{raw}/gp")
    fx.raw_satcat(spark, SF_DIR).fillna("LU", subset=["orbit_center"]).repartition(CPUS).write.parquet(
        f"{raw}/satcat"
    )
    raw_gp, raw_satcat = spark.read.parquet(f"{raw}/gp"), spark.read.parquet(f"{raw}/satcat")
    landed = raw_gp.select(*GP.columns)
    timed("load", lambda: load_insert_if_absent(landed, scratch_path(spark, "bench-load"), GP))

    def load_again() -> None:
        table = scratch_path(spark, "bench-load")
        load_insert_if_absent(landed.where("norad_cat_id % 2 = 0"), table, GP)
        load_insert_if_absent(landed, table, GP)

    timed("load_half_then_all", load_again)

    # Catalogue work starts from written layers, as it does in production.
    built: dict = {}

    def build() -> None:
        built.update(
            warehouse.build(spark, raw_gp, raw_satcat, scratch_path(spark, "bench-warehouse"))
        )

    timed("build_with_checks", build)
    fact, dim = built["fact"], built["dim_object"]
    stored = scratch_path(spark, "bench-positions")
    propagate(fact, base.AT, kernel="j2").write.parquet(stored)
    positions = spark.read.parquet(stored)

    for kernel in ("j2", "sgp4"):
        timed(f"propagate_{kernel}", lambda k=kernel: drain(propagate(fact, base.AT, kernel=k)))
        timed(
            f"tracks_{kernel}",
            lambda k=kernel: drain(tracks.orbit_tracks(fact, base.AT, samples=90, kernel=k)),
        )
    sky = scratch_path(spark, "bench-sky")
    warehouse.stored_sky(fact, dim, base.AT, sky)
    timed("sky_stored", lambda: drain(warehouse.stored_sky(fact, dim, base.AT, sky)))
    timed("sky_now", lambda: drain(warehouse.sky_now(fact, dim, base.AT)))
    timed("look_angles", lambda: drain(visibility.look_angles(positions, BERLIN)))
    timed("visible_counts", lambda: drain(
        visibility.visible_counts(positions, fx.observers(spark, SF_DIR))
    ))
    timed("knn_observer", lambda: drain(spatial.nearest(positions, *fx.BERLIN[:2], 10)))
    timed("knn_observers_many", lambda: drain(
        spatial.nearest_to(positions, fx.observers(spark, SF_DIR), 10)
    ))
    one = fact.orderBy("norad_cat_id").limit(1)
    timed("passes_one_object_72h", lambda: drain(
        visibility.find_passes(one, BERLIN, base.AT)
    ))
    timed("passes_catalogue_72h", lambda: drain(visibility.find_passes(fact, BERLIN, base.AT)), warm=False)
    timed("asof", lambda: drain(registry()["asof_elset"].run(spark, SF_DIR)))
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
