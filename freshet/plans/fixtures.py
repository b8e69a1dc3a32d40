"""Domain relations derived from the driver's orders and customer tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Select lists that Spark and DuckDB read alike but for ``{div}``, the integer division.
DEM = ("CAST(o_orderkey {div} 100 AS INT) AS r", "CAST(o_orderkey % 100 AS INT) AS c", "100e0 + 0.25e0 * abs(o_orderkey % 100 - 50) + ((o_orderkey * 7919) % 97) / 200e0 AS z")
CURVE = (
    "{line_no} AS line_no", "CAST(1000 + r {div} 5 AS BIGINT) AS comid", "r", "c", "z AS base_elev",
    "{depth_0} + (r % 11) / 100e0 AS depth_a", "0.30e0 + (r % 7) / 100e0 AS depth_b",
    "4e0 + ((r {div} 5) % 13) / 2e0 + (r % 5) / 20e0 + CASE WHEN (3 * r + c) % 29 = 0 THEN 3e0 ELSE 0e0 END AS tw_a",
    "0.25e0 + (r % 5) / 1000e0 AS tw_b",
)
FLOW = ("CAST(c_custkey AS BIGINT) AS line_no", "CAST(1000 + c_custkey % 400 AS BIGINT) AS comid", "c_acctbal / 10e0 AS q0", "c_acctbal / 4e0 AS q1", "c_acctbal / 2e0 AS q2")
BATHY = "CASE WHEN abs(c - 50) > 4 THEN z WHEN (31 * r + 17 * c) % 5 >= 2 THEN 0e0 ELSE z - 1e0 END AS v"


def curve_columns(div: str, repeat: bool) -> list[str]:
    line, depth = ("CAST(1000000 + r AS BIGINT)", "0.06e0") if repeat else ("CAST(3 * r + c - 49 AS BIGINT)", "0.05e0")
    return [x.format(div=div, line_no=line, depth_0=depth) for x in CURVE]


@dataclass
class Domain:
    """The input relations of one study area."""

    dem: DataFrame
    curve: DataFrame
    flow: DataFrame
    vdt: DataFrame
    bathy: DataFrame
    watermask: DataFrame
    segment: DataFrame


def domain(spark: SparkSession, sf_dir: str) -> Domain:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    dem = orders.selectExpr(*[x.format(div="div") for x in DEM])
    near = dem.where("c BETWEEN 49 AND 51")
    curve = near.selectExpr(*curve_columns("div", False)).unionByName(dem.where("c = 50 AND r % 20 = 0").selectExpr(*curve_columns("div", True)))
    step = "named_struct('q', CAST(800 - 150 * j + 10 * (r % 13) AS FLOAT), 'v', CAST(1 AS FLOAT), 'tw', CAST(40 - 6 * j + r % 5 AS FLOAT), 'wse', CAST(z + 1.5e0 - 0.25e0 * j AS FLOAT))"
    vdt = near.selectExpr("CAST(3 * r + c - 49 AS BIGINT) AS line_no", "CAST(1000 + r div 5 AS BIGINT) AS comid", "r", "c", "z AS elev", "20e0 + 5e0 * (r % 7) AS qb", f"transform(sequence(0, 4), j -> {step}) AS steps")
    mask = dem.selectExpr("r", "c", "CASE WHEN abs(c - 50) <= 4 THEN 1 ELSE 0 END AS m")
    reach = near.selectExpr("CAST(r div 5 AS BIGINT) AS i").distinct()
    segment = reach.selectExpr("i AS stream_id", "50.2e0 AS x0", "5e0 * i + 0.1e0 AS y0", "50.8e0 AS x1", "5e0 * i + 4.9e0 AS y1").unionByName(
        reach.selectExpr("1000000 + i AS stream_id", "5.2e0 AS x0", "5e0 * i + 0.1e0 AS y0", "5.8e0 AS x1", "5e0 * i + 4.9e0 AS y1")
    )
    return Domain(dem, curve, customer.selectExpr(*FLOW), vdt, dem.selectExpr("r", "c", BATHY), mask, segment)
