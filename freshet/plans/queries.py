"""The queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.kernel import in_ellipse, inverse_square, metric_cell_size
from freshet.operators import components, flood, hydraulics, localfill, topobathy
from freshet.plans import files
from freshet.plans.fixtures import Domain, domain
from freshet.staging import shuffled, written

DX = DY = 10.0
FACTOR, LIMIT, EVENTS, DIGITS = 3.0, 200.0, 3, 4


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a few digits: engines differ in the last bits of powers and sums."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Plans:
    """The intermediate relations, built when needed; those that several others start from are written out once."""

    def __init__(self, d: Domain):
        self.d = d
        self.stream = hydraulics.stream_cells(d.curve)
        self.rf = hydraulics.reach_flow(self.stream, d.flow, EVENTS)

    @cached_property
    def h(self) -> DataFrame:
        return hydraulics.curve_hydraulics(self.d.curve, self.rf)

    @cached_property
    def f0(self) -> DataFrame:
        return hydraulics.positive(self.h)

    @cached_property
    def f0_kept(self) -> DataFrame:
        return written(self.f0, "positive")

    @cached_property
    def f1(self) -> DataFrame:
        return hydraulics.within_two_sigma(self.f0_kept, "tw")

    @cached_property
    def f2(self) -> DataFrame:
        return hydraulics.within_two_sigma(self.f1, "wse")

    @cached_property
    def f3(self) -> DataFrame:
        return hydraulics.outliers_to_median(self.f2)

    @cached_property
    def f3_kept(self) -> DataFrame:
        return written(self.f3, "hydraulics")

    @cached_property
    def reach_hyd(self) -> DataFrame:
        return hydraulics.curve_reaches(self.f3_kept, self.rf)

    @cached_property
    def vdt(self) -> DataFrame:
        return hydraulics.vdt_hydraulics(self.d.vdt, self.rf, FACTOR)

    @cached_property
    def seeds(self) -> DataFrame:
        return flood.seeds(self.stream, self.d.dem, hydraulics.curve_cells(self.f3_kept, FACTOR), written(self.reach_hyd, "reaches"), LIMIT, DX, DY)

    @cached_property
    def stamp(self) -> DataFrame:
        return flood.stamped(self.seeds, self.d.dem, DX, DY)

    @cached_property
    def flood(self) -> DataFrame:
        return flood.flooded(self.stamp, self.stream, EVENTS)

    @cached_property
    def ensemble(self) -> DataFrame:
        return flood.ensemble(self.flood, EVENTS)

    @cached_property
    def areas(self) -> DataFrame:
        return components.areas(self.ensemble.select("r", "c", F.col("pct").alias("value")))

    @cached_property
    def bed(self) -> DataFrame:
        return topobathy.masked(self.d.bathy, self.d.watermask)

    def topo(self, **how) -> DataFrame:
        return topobathy.topobathy(self.d.dem, self.bed, topobathy.neighbour_mean(self.bed, DX, DY, **how))

    @cached_property
    def local_flood(self) -> DataFrame:
        """The ensemble where water spreads over joined wet cells only."""
        filled = localfill.local_fill(written(self.seeds, "seeds"), self.d.dem)
        return flood.ensemble(flood.flooded(flood.stamped(filled, self.d.dem, DX, DY), self.stream, EVENTS), EVENTS)

    def local(self, mode: str) -> DataFrame:
        cells = localfill.filled_cells(localfill.local_fill(written(self.seeds, "seeds"), self.d.dem, mode))
        return cells.groupBy("event", "seed_r", "seed_c").agg(F.count("*").alias("n"), F.sum("dr").alias("sum_dr"), F.sum("dc").alias("sum_dc"))


def cap_of_mode(p: Plans) -> DataFrame:
    """Width cap of each event under each of the three hydraulics modes."""
    curve = hydraulics.width_cap(p.reach_hyd, LIMIT).select(F.lit("curve").alias("mode"), "event", "cap")
    vdt = hydraulics.width_cap(hydraulics.vdt_reaches(p.vdt, p.rf), LIMIT).select(F.lit("vdt").alias("mode"), "event", "cap")
    fixed = p.d.dem.limit(1).select(F.lit("fixed").alias("mode"), F.lit(0).alias("event"), F.lit(LIMIT).alias("cap"))
    return curve.unionByName(vdt).unionByName(fixed)


def band_rows(p: Plans) -> DataFrame:
    """Cell sizes over latitudes from 0 to 99 and two cell sizes, taken from the grid's columns."""
    lat = (F.col("c") + F.lit(0.5) * (F.col("r") % 2)).alias("lat")
    rows = p.d.dem.where("r < 4").select("r", "c", lat, F.when(F.col("r") < 2, F.lit(0.0003)).otherwise(F.lit(30.0)).alias("cell"))
    x, y = metric_cell_size(F.col("cell"), F.col("lat"))
    return rows.select("r", "c", "lat", x.alias("dx"), y.alias("dy"))


def kernel_rows(p: Plans) -> DataFrame:
    spans = p.d.dem.where("r = 0 AND c <= 40").select((F.col("c") - 20).alias("dr"))
    box = spans.select("dr", F.explode(F.sequence(F.lit(-20), F.lit(20))).alias("dc"))
    return box.select("dr", "dc", inverse_square(F.col("dr"), F.col("dc"), DX, DY).alias("w"))


def ellipse_rows(p: Plans) -> DataFrame:
    k = p.d.dem.where("r = 0 AND c BETWEEN 1 AND 20").select(F.col("c").alias("k"))
    return flood.offsets_of(k).where(in_ellipse(F.col("k"), F.col("dr"), F.col("dc"), 30.87, 23.65)).groupBy("k").agg(F.count("*").alias("n"))


def config_rows(p: Plans) -> DataFrame:
    from freshet.sources.config import EXAMPLE, first_match

    spark = p.d.dem.sparkSession
    return first_match(spark.createDataFrame(list(enumerate(EXAMPLE)), "line_no int, line string"))


def extent_rows(p: Plans) -> DataFrame:
    """Extent of the grid as a raster with 10 m cells whose top left corner is (1000, 5000)."""
    size = p.d.dem.agg((F.max("c") + 1).alias("ncols"), (F.max("r") + 1).alias("nrows"))
    return size.select("ncols", "nrows", F.lit(1000.0).alias("minx"), (F.lit(5000.0) - F.col("nrows") * 10.0).alias("miny"), (F.lit(1000.0) + F.col("ncols") * 10.0).alias("maxx"), F.lit(5000.0).alias("maxy"))


BUILD: dict[str, Callable[[Plans], DataFrame]] = {
    "q01_flow_long": lambda p: hydraulics.flow_long(p.d.flow),
    "q02_stream_cells": lambda p: p.stream,
    "q03_reach_distinct": lambda p: hydraulics.reaches(p.stream).orderBy("comid"),
    "q04_curve_join": lambda p: p.h.select("event", "line_no", "comid", "depth", "tw", "wse"),
    "q05_positive_filter": lambda p: p.f0.select("event", "line_no"),
    "q06_tw_2sigma": lambda p: p.f1.select("event", "line_no"),
    "q07_wse_2sigma": lambda p: p.f2.select("event", "line_no"),
    "q08_group_outlier_median": lambda p: p.f3.select("event", "line_no", "tw"),
    "q09_reach_median": lambda p: p.reach_hyd,
    "q10_cell_scatter": lambda p: hydraulics.curve_cells(p.f3, FACTOR),
    "q11_vdt_lookup": lambda p: p.vdt.select("event", "line_no", "branch", "tw", "depth", "wse"),
    "q12_vdt_reach_mean": lambda p: hydraulics.vdt_reaches(p.vdt, p.rf),
    "q13_fixed_depth_seed": lambda p: flood.fixed_depth_seeds(p.stream, p.d.dem, 0.1, LIMIT, DX, DY),
    "q14_cell_size_bands": band_rows,
    "q15_kernel_weights": kernel_rows,
    "q16_ellipse_counts": ellipse_rows,
    "q17_seed_select": lambda p: p.seeds,
    # sums near 1e8 to two digits: at four, the order of summing shows and the SQL itself differs from run to run
    "q18_stamp_sums": lambda p: p.stamp.select("event", "r", "c", F.round("swz", 2).alias("swz"), "sw"),
    "q19_flood_single": lambda p: p.flood.where("event = 0").select("r", "c"),
    "q20_flood_ensemble": lambda p: p.ensemble,
    "q21_local_fill_connected": lambda p: p.local("connected"),
    "q22_local_fill_passes": lambda p: p.local("passes"),
    "q23_components": lambda p: p.areas,
    "q24_stream_polygon_join": lambda p: components.areas_on_streams(p.areas, p.d.segment),
    "q25_stream_polygon_semi": lambda p: components.areas_on_streams(p.areas, p.d.segment).select("label", "value").distinct(),
    "q26_bathy_mask": lambda p: p.bed,
    "q27_bathy_targets": lambda p: topobathy.targets(p.bed).withColumn("kind", F.lit("target")).unionByName(topobathy.sources(p.bed).select("r", "c", F.lit("source").alias("kind"))),
    "q28_topobathy_target_weight": lambda p: p.topo(),
    "q29_topobathy_corner_weight": lambda p: p.topo(weight_origin="corner"),
    "q30_neighborhood_argmin": lambda p: flood.relocated(p.seeds, p.d.dem, 3).select("event", "r", "c", "to_r", "to_c"),
    "q31_implausible_report": lambda p: hydraulics.implausible(p.reach_hyd, 20.0),
    "q32_raster_algebra": lambda p: p.d.dem.join(shuffled(p.d.watermask), ["r", "c"]).join(shuffled(p.bed), ["r", "c"]).select("r", "c", (F.col("z") - F.col("v") * F.col("m")).alias("d")),
    "q33_config_first_match": config_rows,
    "q34_raster_extent": extent_rows,
    "q35_vdt_fixed_vs_curve_mode": cap_of_mode,
    "q36_vdt_cells": lambda p: hydraulics.vdt_cells(p.vdt),
    "q37_vdt_seeds": lambda p: flood.seeds(p.stream, p.d.dem, hydraulics.vdt_cells(p.vdt), hydraulics.vdt_reaches(p.vdt, p.rf), LIMIT, DX, DY),
    "q38_stamp_means": lambda p: p.stamp.select("event", "r", "c", (F.col("swz") / F.col("sw")).alias("wse"), "sw"),
    "q39_local_flood": lambda p: p.local_flood,
    **files.BUILD,
}


#: Queries whose values often end halfway between two roundings to DIGITS.
FINER = {"q14_cell_size_bands": 6}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name, build=build: rounded(build(Plans(domain(spark, sf_dir))), FINER.get(name, DIGITS))) for name, build in BUILD.items()}
