"""Queries whose relations go through files: written, read again, and run from a configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators import components, outlines
from freshet.plans import pipeline
from freshet.sources import raster, tables, vector
from freshet.sources.config import Config
from freshet.staging import new_folder, shuffled, written

#: Ten-metre cells whose top left corner is (1000, 5000), and the mark of an empty cell.
PLACE = (1000.0, 10.0, 0.0, 5000.0, 0.0, -10.0)
EMPTY = -9999.0
CURVE = {"comid": "COMID", "r": "Row", "c": "Col", "base_elev": "BaseElev", "depth_a": "depth_a", "depth_b": "depth_b", "tw_a": "tw_a", "tw_b": "tw_b"}


def folder(df: DataFrame) -> str:
    return new_folder(df.sparkSession, "files")


def grid_file(dem: DataFrame) -> str:
    """The ground as a GeoTIFF."""
    size = dem.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    path = f"{folder(dem)}/dem.tif"
    raster.write_raster(dem.select("r", "c", F.col("z").alias("v")), path, (size.r + 1, size.c + 1), "f8", PLACE, nodata=EMPTY)
    return path


def csv_file(rows: DataFrame, names: dict[str, str]) -> str:
    """A table of one file with a header, in the order of ``line_no``."""
    path = folder(rows)
    rows.orderBy("line_no").select(*[F.col(c).alias(n) for c, n in names.items()]).coalesce(1).write.option("header", True).csv(path)
    return path


def curve_file(curve: DataFrame) -> str:
    return csv_file(curve, CURVE)


def flow_file(flow: DataFrame) -> str:
    return csv_file(flow, {c: c for c in flow.columns if c != "line_no"})


def stage_file(vdt: DataFrame) -> str:
    """Lines of five cells and four more for each step."""
    path = folder(vdt)
    steps = F.transform("steps", lambda s: F.concat_ws(",", s["q"], s["v"], s["tw"], s["wse"]))
    rows = vdt.select("line_no", F.concat_ws(",", "comid", "r", "c", "elev", "qb", F.concat_ws(",", steps)).alias("line"))
    head = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("line_no"), F.lit("COMID,Row,Col,Elev,QBaseflow").alias("line"))
    head.unionByName(rows).orderBy("line_no").select("line").coalesce(1).write.text(path)
    return path


def grid_rows(p) -> DataFrame:
    return raster.read_cells(p.d.dem.sparkSession, grid_file(p.d.dem), nodata=True).select("r", "c", F.col("v").alias("z"))


def grid_details(p) -> DataFrame:
    """Size, place and extent of the ground's file, from its tags."""
    spark = p.d.dem.sparkSession
    (rows, cols), t, _ = raster.details(spark, grid_file(p.d.dem))
    extent = (t[0], t[3] + rows * t[5], t[0] + cols * t[1], t[3])
    return spark.createDataFrame([(rows, cols, t[1], t[5], *extent)], "n_rows int, n_cols int, dx double, dy double, minx double, miny double, maxx double, maxy double")


def curve_rows(p) -> DataFrame:
    return tables.read_curve(p.d.curve.sparkSession, curve_file(p.d.curve))


def flow_rows(p) -> DataFrame:
    return tables.read_flow(p.d.flow.sparkSession, flow_file(p.d.flow))


def stage_rows(p) -> DataFrame:
    rows = tables.read_vdt(p.d.vdt.sparkSession, stage_file(p.d.vdt))
    rows = rows.select("line_no", "comid", "r", "c", "elev", "qb", F.posexplode("steps").alias("step", "s"))
    return rows.select("line_no", "comid", "r", "c", "elev", "qb", "step", *[F.col(f"s.{n}").cast("double").alias(n) for n in ("q", "v", "tw", "wse")])


def polygon_rows(p) -> DataFrame:
    """Value, stream and cells of each record of the flood's shapefile: the area that its rings enclose."""
    spark = p.d.dem.sparkSession
    labelled = written(p.areas.where("value > 0"), "areas")
    pairs = written(components.areas_on_streams(labelled, p.d.segment), "pairs")
    kept = labelled.join(shuffled(pairs.select("label").distinct()), "label", "left_semi")
    path = f"{folder(p.d.dem)}/flood"
    vector.write_polygons(outlines.outlines(kept), path, PLACE, told=pairs)
    side = vector.read_segments(spark, f"{path}.shp")
    area = side.groupBy("stream_id").agg((F.sum(F.expr("x1 * y0 - x0 * y1")) / 2 / abs(PLACE[1] * PLACE[5])).alias("area"))
    table, names = vector.read_attributes(spark, f"{path}.shp")
    told = {name: column for column, name in names}
    return area.join(table, "stream_id").select(F.col(told["Value"]).cast("int").alias("value"), F.col(told["index_righ"]).alias("stream_id"), F.rint("area").cast("long").alias("cells"))


def whole_run(p) -> DataFrame:
    """The flood raster that a run over files writes, cells above zero."""
    spark = p.d.dem.sparkSession
    out = f"{folder(p.d.dem)}/flood.tif"
    cfg = Config(dem_file=grid_file(p.d.dem), print_curve_file=curve_file(p.d.curve), comid_flow_file=flow_file(p.d.flow), outfld=out, topwidthplausiblelimit=200.0, nodata=True, q_fraction=0.5)  # the fraction changes nothing
    pipeline.run(spark, cfg)
    return raster.read_cells(spark, out).where("v > 0").select("r", "c", F.col("v").cast("int").alias("pct"))


def cells_file(cells: DataFrame, like: DataFrame, kind: str = "f8") -> str:
    """``(r, c, v)`` as a GeoTIFF of the size of the ground."""
    size = like.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    path = f"{folder(like)}/cells.tif"
    raster.write_raster(cells, path, (size.r + 1, size.c + 1), kind, PLACE)
    return path


def topobathy_file(p) -> DataFrame:
    """The surface with bathymetry that a run writes, as 32-bit floats."""
    spark, dem = p.d.dem.sparkSession, p.d.dem
    out = f"{folder(dem)}/topo.tif"
    mask = p.d.watermask.select("r", "c", F.col("m").alias("v"))
    cfg = Config(dem_file=grid_file(dem), nodata=True, stream_file=cells_file(p.stream.select("r", "c", F.col("comid").alias("v")), dem, "i4"), set_depth=0.1, topwidthplausiblelimit=20.0, bathy_out_file=cells_file(p.d.bathy, dem), bathywatermask=cells_file(mask, dem, "u1"), fsoutbathy=out)
    pipeline.run(spark, cfg)
    return raster.read_cells(spark, out).select("r", "c", F.col("v").alias("z")).join(shuffled(dem.select("r", "c")), ["r", "c"], "left_semi")


def fixed_depth_run(p) -> DataFrame:
    """The flood of one depth everywhere, stream cells from a raster."""
    spark, dem = p.d.dem.sparkSession, p.d.dem
    out = f"{folder(dem)}/flood.tif"
    stream = cells_file(p.stream.select("r", "c", F.col("comid").alias("v")), dem, "i4")
    pipeline.run(spark, Config(dem_file=grid_file(dem), nodata=True, stream_file=stream, set_depth=0.1, topwidthplausiblelimit=200.0, outfld=out))
    return raster.read_cells(spark, out).where("v > 0").select("r", "c", F.col("v").cast("int").alias("pct"))


def listed(p) -> DataFrame:
    """Names of the rasters of a folder."""
    dem = p.d.dem
    home = grid_file(dem).rsplit("/", 1)[0]
    for name in ("b.img", "c.txt", "d.tif"):
        with raster.open_output(f"{home}/{name}") as out:
            out.write(b"x")
    return raster.list_rasters(dem.sparkSession, home).select(F.element_at(F.split("path", "/"), -1).alias("name"))


def counts(p) -> DataFrame:
    """Lines, reaches with the least and greatest id, events and seeds."""
    lines = p.d.curve.agg(F.count("*").alias("n_lines"))
    reach = p.stream.agg(F.count_distinct("comid").alias("n_reaches"), F.min("comid").alias("min_id"), F.max("comid").alias("max_id"))
    events = p.rf.agg(F.count_distinct("event").alias("n_events"))
    seeds = p.seeds.agg(F.count("*").alias("n_seeds"))
    one = F.lit(1).alias("one")
    out = lines.withColumn("one", one)
    for other in (reach, events, seeds):
        out = out.join(other.withColumn("one", one), "one")  # a row on either side
    return out.drop("one")


BUILD = {
    "q40_grid_file": grid_rows,
    "q41_curve_file": curve_rows,
    "q42_flow_file": flow_rows,
    "q43_stage_file": stage_rows,
    "q44_polygon_file": polygon_rows,
    "q45_whole_run": whole_run,
    "q46_grid_details": grid_details,
    "q47_counts": counts,
    "q48_topobathy_file": topobathy_file,
    "q49_raster_list": listed,
    "q50_fixed_depth_run": fixed_depth_run,
}
