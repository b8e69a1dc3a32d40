"""Run configuration: lines of a key and a value, the first match wins."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLE = ("DEM_File  dem.tif", "OutFLD out/flood map.tif", "Q_Fraction", "Q_Fraction 0.5", "DEM_File other.tif", "", "LocalFloodOption True")


def first_match(lines: DataFrame) -> DataFrame:
    """``(key, value)`` of ``(line_no, line)``; keys without a value don't count, values keep their spaces."""
    clean = F.trim("line")
    pairs = lines.select("line_no", F.regexp_extract(clean, r"^(\S+)", 1).alias("key"), F.regexp_extract(clean, r"^\S+\s+(.+)$", 1).alias("value")).where("value <> ''")
    return pairs.groupBy("key").agg(F.min_by("value", "line_no").alias("value"))


@dataclass
class Config:
    """Options of a run; an empty path means that an input or output isn't used."""

    dem_file: str = ""
    stream_file: str = ""
    strmshp_file: str = ""
    outfld: str = ""
    floodimpact_file: str = ""
    comid_flow_file: str = ""
    print_vdt_database: str = ""
    print_curve_file: str = ""
    q_fraction: float = 1.0
    topwidthplausiblelimit: float = 2500.0
    tw_multfact: float = 3.0
    set_depth: float = -1.1
    localfloodoption: bool = False
    bathywatermask: str = ""
    bathy_out_file: str = ""
    fsoutbathy: str = ""
    #: Not in older files: leave out cells that the ground marks as empty, show only areas on streams in the raster, put stages in order.
    nodata: bool = False
    filter_raster: bool = False
    sort_stages: bool = False

    @classmethod
    def parse(cls, lines: list[str]) -> "Config":
        """Keys are matched without regard to case; the first line with a value wins."""
        found: dict[str, str] = {}
        for line in lines:
            parts = line.strip().split(None, 1)
            if len(parts) == 2:
                found.setdefault(parts[0].lower(), parts[1])
        out = cls()
        for f in fields(cls):
            if (value := found.get(f.name)) is not None:
                kind = type(getattr(out, f.name))
                setattr(out, f.name, value.lower() in ("true", "yes", "1") if kind is bool else kind(value))
        return out
