"""Forecast files that arrive one after the other."""

from freshet.plans.fixtures import domain
from freshet.plans.queries import Plans
from freshet.streaming.forecasts import Area, flood_of, watch


def test_each_forecast_is_flooded_once(spark, tmp_path):
    d = domain(spark, "/root/testdata/sf0.001")
    area = Area(d.dem, d.curve, 10.0, 10.0, 3.0, 200.0)
    rows = d.flow.orderBy("line_no").collect()
    folder = tmp_path / "in"
    folder.mkdir()

    def forecast(name, events):
        lines = [",".join(["COMID", *[f"q{e}" for e in events]])] + [",".join([str(r.comid), *[repr(r[f"q{e}"]) for e in events]]) for r in rows]
        (folder / name).write_text("\n".join(lines) + "\n")

    forecast("all.csv", (0, 1, 2))
    query = watch(spark, str(folder), area, str(tmp_path / "out"), str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        forecast("last day.csv", (2,))
        (folder / "empty.csv").write_text("COMID\n")
        query.processAllAvailable()
    finally:
        query.stop()
    got = {}
    for x in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(x.forecast, {})[x.r, x.c] = x.pct
    assert set(got) == {"all.csv", "last_day.csv"}
    assert got["all.csv"] == {(x.r, x.c): x.pct for x in Plans(d).ensemble.collect()}
    assert got["last_day.csv"] == {(x.r, x.c): x.pct for x in flood_of(area, d.flow.select("line_no", "comid", "q2")).collect()}
