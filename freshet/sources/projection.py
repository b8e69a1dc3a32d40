"""Reference systems of rasters and vector files, as far as their files name them."""

from __future__ import annotations

import re

#: Keys of a GeoTIFF's directory: kind of model, geographic and projected code (fixed values).
MODEL, GEOGRAPHIC, PROJECTED = 1024, 2048, 3072
DIRECTORY = 34735
#: Well-known text of the geographic systems (fixed values).
GEOGCS = {
    4326: 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]',
    4269: 'GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]',
}
#: First code of the transverse Mercator zones: name, hemisphere, geographic system (fixed values).
ZONES = {32600: ("WGS_1984", "N", 4326), 32700: ("WGS_1984", "S", 4326), 26900: ("NAD_1983", "N", 4269)}


def code_of_raster(tags: dict[int, tuple[int, tuple]]) -> int | None:
    """The EPSG code that a GeoTIFF's keys name; user-defined systems (32767) have none."""
    keys = tags.get(DIRECTORY, (3, ()))[1]
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = found.get(PROJECTED if found.get(MODEL) == 1 else GEOGRAPHIC)
    return code if code and code < 32767 else None


def code_of_text(text: str | None) -> int | None:
    """The EPSG code of well-known text: its own authority, else by the system's name."""
    if not text:
        return None
    if own := re.findall(r'(?:AUTHORITY\["EPSG",\s*"?|ID\["EPSG",\s*|EPSG:)(\d+)"?\]?\s*\]?\s*$', text.strip()):
        return int(own[-1])
    name = re.search(r'"([^"]*)"', text)
    name = re.sub(r"[^a-z0-9]+", "", name[1].lower()) if name else ""
    if zone := re.fullmatch(r"(wgs(?:19)?84|nad(?:19)?83)utmzone(\d+)([ns])", name):
        first = 26900 if zone[1].startswith("nad") else 32600 if zone[3] == "n" else 32700
        return first + int(zone[2])
    return {"gcswgs1984": 4326, "wgs84": 4326, "gcsnorthamerican1983": 4269, "nad83": 4269}.get(name)


def text_of(code: int | None) -> str | None:
    """Well-known text of a code, where it is one of the systems above."""
    if code in GEOGCS:
        return GEOGCS[code]
    for first, (name, side, base) in ZONES.items():
        if code and 1 <= code - first <= 60:
            zone = code - first
            values = {"False_Easting": 500000.0, "False_Northing": 0.0 if side == "N" else 10000000.0, "Central_Meridian": 6.0 * zone - 183, "Scale_Factor": 0.9996, "Latitude_Of_Origin": 0.0}
            parameters = ",".join(f'PARAMETER["{k}",{v}]' for k, v in values.items())
            return f'PROJCS["{name}_UTM_Zone_{zone}{side}",{GEOGCS[base]},PROJECTION["Transverse_Mercator"],{parameters},UNIT["Meter",1.0]]'
    return None
