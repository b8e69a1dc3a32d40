"""A whole run: from the files that a configuration names to its rasters and polygons."""

from __future__ import annotations

import logging
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.kernel import metric_cell_size
from freshet.operators import components, flood, hydraulics, localfill, outlines, topobathy
from freshet.sources import raster, tables, vector
from freshet.sources.config import Config
from freshet.sources.projection import code_of_raster, code_of_text, text_of
from freshet.staging import shuffled, written

log = logging.getLogger("freshet")


def cells_of(spark: SparkSession, path: str, name: str, nodata: bool = False) -> DataFrame:
    return raster.read_cells(spark, path, nodata).select("r", "c", F.col("v").alias(name))


def cells_or_none(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Cells of a raster that the run can do without; none if it can't be read."""
    if not path:
        return None
    try:
        return written(cells_of(spark, path, name), "optional")
    except (PySparkException, OSError) as problem:
        log.warning("%s can't be read: %s", path, str(problem).splitlines()[0])
        return None


def common_projection(spark: SparkSession, streams: str, projection: dict) -> str | None:
    """Text of the system that the grid and the stream lines share; raises where both name one and they differ."""
    stated = vector.read_projection(spark, streams)
    grid, lines = code_of_raster(projection), code_of_text(stated)
    if grid and lines and grid != lines:
        raise ValueError(f"the stream lines are in EPSG:{lines}, the grid in EPSG:{grid}")
    if not (grid and lines):
        log.warning("the reference systems of grid and stream lines can't be compared; they are taken to be the same")
    return text_of(grid) or text_of(lines) or stated


def metric_size(spark: SparkSession, shape: tuple[int, int], transform: tuple[float, ...]) -> tuple[float, float]:
    """Cell size in metres at the grid's middle latitude."""
    middle = transform[3] + shape[0] * transform[5] / 2
    x, y = metric_cell_size(F.lit(abs(transform[1])), F.lit(abs(middle)))
    size = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    if size.x is None or size.y is None or size.x <= 0 or size.y <= 0:
        raise ValueError(f"no cell size in metres at latitude {middle}")
    return size.x, size.y


def flood_events(spark: SparkSession, cfg: Config, dem: DataFrame, dx: float, dy: float) -> tuple[DataFrame, int]:
    """``(r, c, pct)`` over all events, and their number.

    A depth above zero takes the place of flows; a depth of zero keeps the first event only.
    A curve file goes before a stage table.
    """
    limit, factor = cfg.topwidthplausiblelimit, cfg.tw_multfact
    if cfg.set_depth > 0:
        events = 1
        stream = written(cells_of(spark, cfg.stream_file, "v").where("v > 0").select("r", "c", F.col("v").cast("long").alias("comid")), "stream")
        seed = flood.fixed_depth_seeds(stream, dem, cfg.set_depth, limit, dx, dy)
    else:
        if cfg.print_curve_file:
            table = tables.read_curve(spark, cfg.print_curve_file)
        else:
            table = written(tables.read_vdt(spark, cfg.print_vdt_database), "stages")
            if rising := tables.rising_stages(table).count():
                if not cfg.sort_stages:
                    log.warning("%d lines of the stage table don't run from high to low flow; the first stage that fits is taken", rising)
                else:
                    table = tables.falling(table)
        flow = tables.read_flow(spark, cfg.comid_flow_file)
        names = [c for c in flow.columns if c not in ("line_no", "comid")]
        if not names:
            raise ValueError("the flow file holds no event")
        events = 1 if cfg.set_depth == 0 else len(names)
        stream = written(hydraulics.stream_cells(table), "stream")
        rf = written(hydraulics.reach_flow(stream, flow.select("line_no", "comid", *names[:events]), events), "flows")
        if cfg.print_curve_file:
            h = written(hydraulics.cleaned_curve(table, rf), "hydraulics")
            cell, reach = hydraulics.curve_cells(h, factor), hydraulics.curve_reaches(h, rf)
        else:
            h = written(hydraulics.vdt_hydraulics(table, rf, factor), "hydraulics")
            cell, reach = hydraulics.vdt_cells(h), hydraulics.vdt_reaches(h, rf)
        reach = written(reach, "reaches")
        seed = flood.seeds(stream, dem, cell, reach, limit, dx, dy)
    seed = written(seed, "seeds")
    if cfg.localfloodoption:
        seed = written(localfill.local_fill(seed, dem), "local")
    wet = flood.flooded(flood.stamped(seed, dem, dx, dy), stream, events)
    return written(flood.ensemble(wet, events), "ensemble"), events


def flood_polygons(spark: SparkSession, ensemble: DataFrame, streams: str, transform: tuple[float, ...]) -> tuple[DataFrame, DataFrame, list[tuple[str, str]], DataFrame]:
    """``(label, rings)`` of the flood areas that meet a stream line, and ``(label, value, stream_id, attributes)``: a row for each pair.

    Also the attributes' columns and names, and the cells ``(r, c, label)`` of those areas.
    """
    labelled = written(components.areas(ensemble.where("pct > 0").select("r", "c", F.col("pct").alias("value"))), "areas")
    pairs = components.areas_on_streams(labelled, vector.in_cells(vector.read_segments(spark, streams), transform))
    pairs = written(pairs, "pairs")
    kept = labelled.join(shuffled(pairs.select("label").distinct()), "label", "left_semi")
    attributes, names = vector.read_attributes(spark, streams)
    told = pairs.join(attributes, "stream_id", "left").select("label", "value", "stream_id", *[c for c, _ in names])
    return outlines.outlines(kept).select("label", "rings"), told, names, kept.select("r", "c", "label")


def run(spark: SparkSession, cfg: Config) -> dict[str, DataFrame]:
    """Compute and write what the configuration asks for; returns the relations made."""
    began = time.monotonic()
    shape, transform, projection = raster.details(spark, cfg.dem_file)
    dx, dy = metric_size(spark, shape, transform)
    log.info("grid of %d x %d cells, %.3f by %.3f metres each", *shape, dx, dy)
    dem = written(cells_of(spark, cfg.dem_file, "z", cfg.nodata), "ground")
    ensemble, events = flood_events(spark, cfg, dem, dx, dy)
    made = {"dem": dem, "ensemble": ensemble}
    log.info("%d events flooded", events)
    shown = ensemble
    if cfg.strmshp_file:
        text = common_projection(spark, cfg.strmshp_file, projection)
        rings, told, names, kept = flood_polygons(spark, ensemble, cfg.strmshp_file, transform)
        rings, told = written(rings, "outlines"), written(told, "told")
        made["polygons"] = told.join(shuffled(rings), "label")  # an area's rings once for each of its stream lines, where they are asked for
        if cfg.outfld:
            vector.write_polygons(rings, cfg.outfld[:-4], transform, [("value", "Value"), ("stream_id", "index_right"), *names], text, told)
        if cfg.filter_raster:
            shown = ensemble.join(shuffled(kept), ["r", "c"], "left_semi")
    if cfg.outfld:
        raster.write_raster(shown.select("r", "c", F.col("pct").alias("v")), cfg.outfld, shape, "i4", transform, projection)
    if cfg.bathy_out_file and cfg.fsoutbathy:
        bathy, water = cells_or_none(spark, cfg.bathy_out_file, "v"), cells_or_none(spark, cfg.bathywatermask, "v")
        if water is not None:
            water = water.select("r", "c", (F.col("v") > 0).cast("int").alias("m"))
        else:  # the flood map stands in for a mask
            water = dem.join(shuffled(ensemble), ["r", "c"], "left").select("r", "c", (F.coalesce("pct", F.lit(0)) > 0).cast("int").alias("m"))
        if bathy is not None:
            bed = written(topobathy.masked(bathy, water), "bed")
            made["topobathy"] = written(topobathy.topobathy(dem, bed, topobathy.neighbour_mean(bed, dx, dy)), "topobathy")
            raster.write_raster(made["topobathy"].select("r", "c", F.col("z").alias("v")), cfg.fsoutbathy, shape, "f4", transform, projection)
    log.info("took %d seconds", time.monotonic() - began)
    return made
