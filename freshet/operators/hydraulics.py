"""Flows of reaches, and depth and top width by rating curve, stage table or fixed depth.

All events go through at once: ``event`` is a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_cells(table: DataFrame) -> DataFrame:
    """``(r, c, comid)``: the last line of each cell wins; ids above zero."""
    return table.groupBy("r", "c").agg(F.max_by("comid", "line_no").alias("comid")).where("comid > 0")


def reaches(stream: DataFrame) -> DataFrame:
    return stream.select("comid").distinct()


def flow_long(flow: DataFrame) -> DataFrame:
    """``(event, comid, q)`` of a wide flow table; the last line of an id wins, null counts as zero."""
    names = [c for c in flow.columns if c not in ("line_no", "comid")]
    long = flow.select("line_no", "comid", F.posexplode(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])).alias("event", "q"))
    return long.groupBy("event", "comid").agg(F.max_by("q", "line_no").alias("q"))


def reach_flow(stream: DataFrame, flow: DataFrame, events: int) -> DataFrame:
    """``(event, comid, q)`` for every reach and event, zero where the forecast has none."""
    every = reaches(stream).select("comid", F.explode(F.sequence(F.lit(0), F.lit(events - 1))).alias("event"))
    return every.join(flow_long(flow), ["event", "comid"], "left").select("event", "comid", F.coalesce("q", F.lit(0.0)).alias("q"))


def finite(x):
    """Null in place of NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def curve_hydraulics(curve: DataFrame, rf: DataFrame) -> DataFrame:
    """Depth, top width and water surface of each line and event."""
    power = lambda a, b: finite(F.col(a) * F.pow("q", F.col(b)))
    joined = curve.join(rf, "comid")
    out = joined.select("event", "line_no", "comid", "r", "c", "base_elev", "q", power("depth_a", "depth_b").alias("depth"), power("tw_a", "tw_b").alias("tw"))
    return out.withColumn("wse", F.col("depth") + F.col("base_elev"))


def positive(h: DataFrame) -> DataFrame:
    return h.where("depth > 0 AND tw > 0")


def within_two_sigma(df: DataFrame, column: str) -> DataFrame:
    """Rows within two sample deviations of the event's mean.

    Aggregated to a row for each event and joined, so no window holds an event.  Events are
    columns of the flow table, so their rows are few and go to every task.
    """
    stats = df.groupBy("event").agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    return df.join(F.broadcast(stats), "event").where(F.col(column).between(F.col("m") - 2 * F.col("s"), F.col("m") + 2 * F.col("s"))).drop("m", "s")


def outliers_to_median(df: DataFrame) -> DataFrame:
    """Top widths beyond two deviations of their reach become the reach's median."""
    stats = df.groupBy("event", "comid").agg(F.avg("tw").alias("m"), F.stddev_samp("tw").alias("s"), F.median("tw").alias("med"))
    outside = (F.col("tw") < F.col("m") - 2 * F.col("s")) | (F.col("tw") > F.col("m") + 2 * F.col("s"))
    return df.join(stats, ["event", "comid"]).withColumn("tw", F.when(outside, F.col("med")).otherwise(F.col("tw"))).drop("m", "s", "med")


def cleaned_curve(curve: DataFrame, rf: DataFrame) -> DataFrame:
    f0 = positive(curve_hydraulics(curve, rf))
    return outliers_to_median(within_two_sigma(within_two_sigma(f0, "tw"), "wse"))


def curve_cells(f3: DataFrame, factor: float) -> DataFrame:
    """``(event, r, c, tw, wse)``; the last line of a cell wins."""
    pair = F.max_by(F.struct((F.col("tw") * factor).alias("tw"), (F.col("depth") + F.col("base_elev")).alias("wse")), "line_no")
    return f3.groupBy("event", "r", "c").agg(pair.alias("x")).select("event", "r", "c", "x.tw", "x.wse")


def curve_reaches(f3: DataFrame, rf: DataFrame) -> DataFrame:
    """``(event, comid, tw, depth)``: medians, zero for reaches without rows."""
    medians = f3.groupBy("event", "comid").agg(F.median("tw").alias("tw"), F.median("depth").alias("depth"))
    return _all_reaches(medians, rf)


def _all_reaches(found: DataFrame, rf: DataFrame) -> DataFrame:
    return rf.select("event", "comid").join(found, ["event", "comid"], "left").select("event", "comid", F.coalesce("tw", F.lit(0.0)).alias("tw"), F.coalesce("depth", F.lit(0.0)).alias("depth"))


def vdt_hydraulics(vdt: DataFrame, rf: DataFrame, factor: float, interpolate: bool = False) -> DataFrame:
    """Top width (times ``factor``), depth and water surface of each stage line and event.

    Between stages the lower stage holds, or a line between the two if ``interpolate``.
    Lines without a stage are dropped.
    """
    rows = vdt.where(F.size("steps") > 0).join(rf, "comid")
    q, elev = F.col("q"), F.col("elev")
    first, last = F.get("steps", F.lit(0)), F.element_at("steps", -1)
    at = F.expr("array_position(transform(steps, s -> q >= s.q), true) - 1").cast("int")
    below, above = F.get("steps", at), F.get("steps", at - 1)

    def between(name: str):
        low = below[name].cast("double")
        if not interpolate:
            return low
        rise = above["q"].cast("double") - below["q"]
        return F.when(F.abs(rise) > 1e-4, low + (q - below["q"]) / rise * (above[name].cast("double") - low)).otherwise(low)

    def pick(name: str, dry, middle):
        return F.when(q <= F.col("qb"), dry).when(q >= first["q"], first[name].cast("double")).when(q <= last["q"], last[name].cast("double")).otherwise(middle)

    branch = F.when(q <= F.col("qb"), 0).when(q >= first["q"], 1).when(q <= last["q"], 2).otherwise(3)
    out = rows.withColumns({"branch": branch, "width": pick("tw", F.lit(1.0), between("tw")), "wse": pick("wse", elev, F.greatest(between("wse"), elev))})
    depth = F.when(F.col("branch") == 0, F.lit(0.001)).otherwise(F.col("wse") - elev)
    return out.select("event", "line_no", "comid", "r", "c", "branch", (F.col("width") * factor).alias("tw"), depth.alias("depth"), "wse")


def vdt_cells(h: DataFrame) -> DataFrame:
    pair = F.max_by(F.struct("tw", "wse"), "line_no")
    return h.where("tw > 0.0001 AND wse > 0.0001").groupBy("event", "r", "c").agg(pair.alias("x")).select("event", "r", "c", "x.tw", "x.wse")


def vdt_reaches(h: DataFrame, rf: DataFrame) -> DataFrame:
    means = h.where("depth > 0.00001 AND tw > 0.0001").groupBy("event", "comid").agg(F.avg("tw").alias("tw"), F.avg("depth").alias("depth"))
    return _all_reaches(means, rf)


def width_cap(reach_hyd: DataFrame, limit: float) -> DataFrame:
    """``(event, cap)``: the greatest reach width, the plausible limit at most."""
    return reach_hyd.groupBy("event").agg(F.least(F.max("tw"), F.lit(float(limit))).alias("cap"))


def implausible(reach_hyd: DataFrame, limit: float) -> DataFrame:
    """Reaches wider than the limit; for a report only, nothing is dropped."""
    return reach_hyd.where(F.col("tw") > limit)
