"""The queries once more, as SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from freshet.functions.kernel import LATITUDE_BANDS
from freshet.plans.fixtures import BATHY, DEM, FLOW, curve_columns
from freshet.sources.config import EXAMPLE


def columns(names: tuple[str, ...] | list[str]) -> str:
    return ", ".join(x.format(div="//") for x in names)


def finite(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


POWER = "CASE WHEN q < 0 THEN NULL WHEN isfinite({a} * pow(q, {b})) THEN {a} * pow(q, {b}) END"
ELLIPSE = "((dc * {dx}) * (dc * {dx})) / ((k * {dx}) * (k * {dx})) + ((dr * {dy}) * (dr * {dy})) / ((k * {dy}) * (k * {dy})) <= 1"


def weight(dr: str = "dr", dc: str = "dc") -> str:
    z = f"sqrt(({dc} * 10e0) * ({dc} * 10e0) + ({dr} * 10e0) * ({dr} * 10e0))"
    return f"CASE WHEN {z} < 1e-4 THEN 1e6 ELSE 1e0 / ({z} * {z}) END"


def two_sigma(source: str, column: str) -> str:
    return f"SELECT x.* FROM {source} x JOIN (SELECT event, avg({column}) m, stddev_samp({column}) s FROM {source} GROUP BY event) USING (event) WHERE {column} BETWEEN m - 2 * s AND m + 2 * s"


def topo_rows(w: str) -> str:
    return f"""SELECT r, c, CASE WHEN v > 0 THEN v WHEN v = 0 AND f > 0 THEN f ELSE z END AS raw
FROM dem LEFT JOIN bed USING (r, c) LEFT JOIN (
  SELECT t.r, t.c, sum(s.v * {w}) / sum({w}) AS f
  FROM (SELECT r, c FROM bed WHERE v = 0) t JOIN (SELECT r AS sr, c AS sc, v FROM bed WHERE v > 0) s
    ON s.sr BETWEEN t.r - 19 AND t.r + 19 AND s.sc BETWEEN t.c - 19 AND t.c + 19
  WHERE (sr - t.r) * (sr - t.r) + (sc - t.c) * (sc - t.c) <= 361 GROUP BY t.r, t.c
) USING (r, c)"""


def topo(w: str) -> str:
    return f"SELECT r, c, round(raw, 4) AS z FROM ({topo_rows(w)})"


def sweeps() -> dict[str, str]:
    """The three sweeps of the local fill: a marked cell that a sweep comes to marks its wet neighbours.

    ``went`` holds the cells that act in a sweep (marked before it, or by one that came earlier in it), ``mark`` all cells marked after it.
    """
    same = "w.event = f.event AND w.seed_r = f.seed_r AND w.seed_c = f.seed_c AND w.dr BETWEEN f.dr - 1 AND f.dr + 1 AND w.dc BETWEEN f.dc - 1 AND f.dc + 1"
    steps = [("w.dr >= 0 AND w.dc >= 0", ">"), ("w.dr <= 0 AND w.dc <= 0", "<"), ("true", ">")]
    out = {"mark0": "SELECT event, r AS seed_r, c AS seed_c, 0::BIGINT AS dr, 0::BIGINT AS dc FROM seed"}
    for n, (region, later) in enumerate(steps, 1):
        out[f"went{n}"] = f"SELECT w.* FROM mark{n - 1} w WHERE {region} UNION SELECT w.event, w.seed_r, w.seed_c, w.dr, w.dc FROM went{n} f JOIN wetbox w ON {same} WHERE {region} AND (w.dr {later} f.dr OR (w.dr = f.dr AND w.dc {later} f.dc))"
        out[f"mark{n}"] = f"SELECT * FROM mark{n - 1} UNION SELECT w.event, w.seed_r, w.seed_c, w.dr, w.dc FROM went{n} f JOIN wetbox w ON {same}"
    return out


CTES: dict[str, str] = {
    "dem": f"SELECT {columns(DEM)} FROM orders",
    "curve": f"SELECT {columns(curve_columns('//', False))} FROM dem WHERE c BETWEEN 49 AND 51 UNION ALL SELECT {columns(curve_columns('//', True))} FROM dem WHERE c = 50 AND r % 20 = 0",
    "flow": f"SELECT {columns(FLOW)} FROM customer",
    "events": "SELECT unnest([0, 1, 2])::INT AS event",
    "stream": "SELECT r, c, arg_max(comid, line_no) AS comid FROM curve GROUP BY r, c HAVING arg_max(comid, line_no) > 0",
    "flow_all": "SELECT line_no, comid, 0 AS event, coalesce(q0, 0e0) AS q FROM flow UNION ALL SELECT line_no, comid, 1, coalesce(q1, 0e0) FROM flow UNION ALL SELECT line_no, comid, 2, coalesce(q2, 0e0) FROM flow",
    "flow1": "SELECT event, comid, arg_max(q, line_no) AS q FROM flow_all GROUP BY event, comid",
    "rf": "SELECT event, comid, coalesce(q, 0e0) AS q FROM (SELECT DISTINCT comid FROM stream) CROSS JOIN events LEFT JOIN flow1 USING (event, comid)",
    "h": f"SELECT *, depth + base_elev AS wse FROM (SELECT event, line_no, comid, r, c, base_elev, q, {POWER.format(a='depth_a', b='depth_b')} AS depth, {POWER.format(a='tw_a', b='tw_b')} AS tw FROM curve JOIN rf USING (comid))",
    "f0": "SELECT * FROM h WHERE depth > 0 AND tw > 0",
    "f1": two_sigma("f0", "tw"),
    "f2": two_sigma("f1", "wse"),
    "f3": "SELECT x.* REPLACE (CASE WHEN tw < m - 2 * s OR tw > m + 2 * s THEN med ELSE tw END AS tw) FROM f2 x JOIN (SELECT event, comid, avg(tw) m, stddev_samp(tw) s, median(tw) med FROM f2 GROUP BY event, comid) USING (event, comid)",
    "cell_hyd": "SELECT event, r, c, arg_max(tw * 3e0, line_no) AS tw, arg_max(depth + base_elev, line_no) AS wse FROM f3 GROUP BY event, r, c",
    "reach_hyd": "SELECT event, comid, coalesce(t, 0e0) AS tw, coalesce(d, 0e0) AS depth FROM rf LEFT JOIN (SELECT event, comid, median(tw) t, median(depth) d FROM f3 GROUP BY event, comid) USING (event, comid)",
    "vdt": "SELECT 3 * r + c - 49 AS line_no, 1000 + r // 5 AS comid, r, c, z AS elev, 20e0 + 5e0 * (r % 7) AS qb, list_transform([0, 1, 2, 3, 4], lambda j: {'q': (800 - 150 * j + 10 * (r % 13))::DOUBLE, 'tw': (40 - 6 * j + r % 5)::DOUBLE, 'wse': (z + 1.5e0 - 0.25e0 * j)::FLOAT::DOUBLE}) AS steps FROM dem WHERE c BETWEEN 49 AND 51",
    "vh": """SELECT event, line_no, comid, r, c, branch, 3e0 * w AS tw, CASE WHEN branch = 0 THEN 0.001e0 ELSE s - elev END AS depth, s AS wse FROM (
      SELECT *, CASE branch WHEN 0 THEN 1e0 WHEN 1 THEN steps[1].tw WHEN 2 THEN steps[5].tw ELSE low.tw END AS w,
        CASE branch WHEN 0 THEN elev WHEN 1 THEN steps[1].wse WHEN 2 THEN steps[5].wse ELSE greatest(low.wse, elev) END AS s FROM (
        SELECT *, CASE WHEN q <= qb THEN 0 WHEN q >= steps[1].q THEN 1 WHEN q <= steps[5].q THEN 2 ELSE 3 END AS branch, list_filter(steps, lambda x: q >= x.q)[1] AS low FROM vdt JOIN rf USING (comid)))""",
    "vdt_reach": "SELECT event, comid, coalesce(t, 0e0) AS tw, coalesce(d, 0e0) AS depth FROM rf LEFT JOIN (SELECT event, comid, avg(tw) t, avg(depth) d FROM vh WHERE depth > 0.00001 AND tw > 0.0001 GROUP BY event, comid) USING (event, comid)",
    "cap": "SELECT event, least(max(tw), 200e0) AS cap FROM reach_hyd GROUP BY event",
    "seed": """SELECT event, r, c, wse, tw, CASE WHEN n <= 1 THEN 2 ELSE n END AS k FROM (
      SELECT event, r, c, wse, tw, round_even(least(tw, cap) / 10e0, 0)::INT AS n FROM (
        SELECT s.r, s.c, rh.event, CASE WHEN ch.wse >= 0.001 AND ch.tw >= 1e-5 THEN ch.wse ELSE z + rh.depth END AS wse,
          CASE WHEN ch.wse >= 0.001 AND ch.tw >= 1e-5 THEN ch.tw ELSE rh.tw END AS tw
        FROM stream s JOIN dem USING (r, c) JOIN reach_hyd rh ON rh.comid = s.comid LEFT JOIN cell_hyd ch ON ch.event = rh.event AND ch.r = s.r AND ch.c = s.c
      ) JOIN cap USING (event) WHERE wse >= 0.001 AND tw >= 1e-5)""",
    "box": "SELECT event, r, c, wse, k, dr, unnest(range(-k, k + 1)) AS dc FROM (SELECT event, r, c, wse, k, unnest(range(-k, k + 1)) AS dr FROM seed)",
    "stamp": f"SELECT event, t.r, t.c, sum(wse * w) AS swz, sum(w) AS sw FROM (SELECT event, r + dr AS r, c + dc AS c, wse, {weight()} AS w FROM box WHERE {ELLIPSE.format(dx='10e0', dy='10e0')}) t JOIN dem ON dem.r = t.r AND dem.c = t.c GROUP BY event, t.r, t.c",
    "flood": "SELECT event, r, c FROM stamp JOIN dem USING (r, c) WHERE swz / sw > z UNION SELECT event, r, c FROM stream CROSS JOIN events",
    "ens": "SELECT r, c, (100 * count(*) // 3)::INT AS pct FROM flood GROUP BY r, c",
    "cell": "SELECT r::BIGINT * 2147483648 + c AS id, r, c, pct FROM ens",
    "link": "SELECT a.id AS u, b.id AS v FROM cell a JOIN cell b ON b.pct = a.pct AND ((b.r = a.r AND abs(b.c - a.c) = 1) OR (b.c = a.c AND abs(b.r - a.r) = 1))",
    "walk": "SELECT id, id AS seen FROM cell UNION SELECT walk.id, link.v FROM walk JOIN link ON link.u = walk.seen",
    "area": "SELECT r, c, pct AS value, label FROM cell JOIN (SELECT id, min(seen) AS label FROM walk GROUP BY id) USING (id)",
    "segment": "SELECT i AS stream_id, 50.2e0 AS x0, 5e0 * i + 0.1e0 AS y0, 50.8e0 AS x1, 5e0 * i + 4.9e0 AS y1 FROM reach_no UNION ALL SELECT 1000000 + i, 5.2e0, 5e0 * i + 0.1e0, 5.8e0, 5e0 * i + 4.9e0 FROM reach_no",
    "crossed": """SELECT DISTINCT stream_id, r, c FROM (
      SELECT *, (c - x0) / (x1 - x0) AS xa, (c + 1 - x0) / (x1 - x0) AS xb, (r - y0) / (y1 - y0) AS ya, (r + 1 - y0) / (y1 - y0) AS yb FROM (
        SELECT *, unnest(range((ceil(least(y0, y1)) - 1)::INT, floor(greatest(y0, y1))::INT + 1)) AS r FROM (
          SELECT *, unnest(range((ceil(least(x0, x1)) - 1)::INT, floor(greatest(x0, x1))::INT + 1)) AS c FROM segment)))
      WHERE greatest(least(xa, xb), least(ya, yb), 0e0) <= least(greatest(xa, xb), greatest(ya, yb), 1e0)""",
    "bathy": f"SELECT r, c, {BATHY} FROM dem",
    "watermask": "SELECT r, c, CASE WHEN abs(c - 50) <= 4 THEN 1 ELSE 0 END AS m FROM dem",
    "bed": "SELECT r, c, CASE WHEN m > 0 THEN v ELSE -99e0 END AS v FROM bathy JOIN watermask USING (r, c)",
    "wetbox": "SELECT b.event, b.r AS seed_r, b.c AS seed_c, dr, dc FROM box b JOIN dem d ON d.r = b.r + dr AND d.c = b.c + dc WHERE z <= wse",
    "fill": "SELECT event, r AS seed_r, c AS seed_c, 0::BIGINT AS dr, 0::BIGINT AS dc FROM seed UNION SELECT w.event, w.seed_r, w.seed_c, w.dr, w.dc FROM fill f JOIN wetbox w ON w.event = f.event AND w.seed_r = f.seed_r AND w.seed_c = f.seed_c AND w.dr BETWEEN f.dr - 1 AND f.dr + 1 AND w.dc BETWEEN f.dc - 1 AND f.dc + 1",
    **sweeps(),
    "reach_no": "SELECT DISTINCT (r // 5)::BIGINT AS i FROM dem WHERE c BETWEEN 49 AND 51",
}
ORDER = ["dem", "curve", "flow", "events", "stream", "flow_all", "flow1", "rf", "h", "f0", "f1", "f2", "f3", "cell_hyd", "reach_hyd", "vdt", "vh", "vdt_reach", "cap", "seed", "box", "stamp", "flood", "ens", "cell", "link", "walk", "area", "reach_no", "segment", "crossed", "bathy", "watermask", "bed", "wetbox", "fill", "mark0", "went1", "mark1", "went2", "mark2", "went3", "mark3"]


def with_ctes(last: str, select: str) -> str:
    """``select`` after the relations up to ``last``."""
    names = ORDER[: ORDER.index(last) + 1]
    body = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ('f0', 'f1', 'f2', 'f3', 'seed', 'ens', 'link', 'wetbox', 'mark0', 'mark1', 'mark2') else ''}({CTES[n]})" for n in names)
    return f"WITH RECURSIVE {body}{', ' if ' AS (' in select[:12] else chr(10)}{select}"


def band_case(axis: int) -> str:
    parts = []
    for base, *ends in LATITUDE_BANDS:
        low, high = ends[2 * axis : 2 * axis + 2]
        parts.append(f"WHEN lat {'>=' if base == 0 else '>'} {base} AND lat <= {base + 10} THEN cell * ({low}e0 + {high - low!r}::DOUBLE * ((lat - {base}) / 10e0)) * 1000e0")
    return f"CASE WHEN cell > 0.5 THEN cell {' '.join(parts)} END"


_R = lambda *names: ", ".join(f"round({n}, 4) AS {n}" for n in names)
_CONFIG = ", ".join(f"({i}, '{x}')" for i, x in enumerate(EXAMPLE))
_CORNER = weight(*[f"(CASE WHEN {s} - greatest({t} - 19, 0) <= 20 THEN {s} - greatest({t} - 19, 0) ELSE 41 - ({s} - greatest({t} - 19, 0)) END)" for s, t in (("sr", "t.r"), ("sc", "t.c"))])

ORACLE_SQL: dict[str, str] = {
    "q01_flow_long": with_ctes("flow1", "SELECT event, comid, round(q, 4) AS q FROM flow1"),
    "q02_stream_cells": with_ctes("stream", "SELECT * FROM stream"),
    "q03_reach_distinct": with_ctes("stream", "SELECT DISTINCT comid FROM stream"),
    "q04_curve_join": with_ctes("h", f"SELECT event, line_no, comid, {_R('depth', 'tw', 'wse')} FROM h"),
    "q05_positive_filter": with_ctes("f0", "SELECT event, line_no FROM f0"),
    "q06_tw_2sigma": with_ctes("f1", "SELECT event, line_no FROM f1"),
    "q07_wse_2sigma": with_ctes("f2", "SELECT event, line_no FROM f2"),
    "q08_group_outlier_median": with_ctes("f3", f"SELECT event, line_no, {_R('tw')} FROM f3"),
    "q09_reach_median": with_ctes("reach_hyd", f"SELECT event, comid, {_R('tw', 'depth')} FROM reach_hyd"),
    "q10_cell_scatter": with_ctes("cell_hyd", f"SELECT event, r, c, {_R('tw', 'wse')} FROM cell_hyd"),
    "q11_vdt_lookup": with_ctes("vh", f"SELECT event, line_no, branch, {_R('tw', 'depth', 'wse')} FROM vh"),
    "q12_vdt_reach_mean": with_ctes("vdt_reach", f"SELECT event, comid, {_R('tw', 'depth')} FROM vdt_reach"),
    "q13_fixed_depth_seed": with_ctes("stream", "SELECT 0 AS event, r, c, round(z + 0.1e0, 4) AS wse, 200e0 AS tw, 20 AS k FROM stream JOIN dem USING (r, c)"),
    "q14_cell_size_bands": with_ctes("dem", f"SELECT r, c, lat, round({band_case(1)}, 6) AS dx, round({band_case(0)}, 6) AS dy FROM (SELECT r, c, c + 0.5e0 * (r % 2) AS lat, CASE WHEN r < 2 THEN 0.0003e0 ELSE 30e0 END AS cell FROM dem WHERE r < 4)"),
    "q15_kernel_weights": f"SELECT dr, dc, round({weight()}, 4) AS w FROM (SELECT unnest(range(-20, 21))::INT AS dr), (SELECT unnest(range(-20, 21))::INT AS dc)",
    "q16_ellipse_counts": f"SELECT k, count(*) AS n FROM (SELECT k, dr, unnest(range(-k, k + 1)) AS dc FROM (SELECT k, unnest(range(-k, k + 1)) AS dr FROM (SELECT unnest(range(1, 21))::INT AS k))) WHERE {ELLIPSE.format(dx='30.87e0', dy='23.65e0')} GROUP BY k",
    "q17_seed_select": with_ctes("seed", f"SELECT event, r, c, {_R('wse', 'tw')}, k FROM seed"),
    "q18_stamp_sums": with_ctes("stamp", f"SELECT event, r, c, round(swz, 2) AS swz, {_R('sw')} FROM stamp"),
    "q19_flood_single": with_ctes("flood", "SELECT r, c FROM flood WHERE event = 0"),
    "q20_flood_ensemble": with_ctes("ens", "SELECT * FROM ens"),
    "q21_local_fill_connected": with_ctes("fill", "SELECT event, seed_r, seed_c, count(*) AS n, sum(dr)::BIGINT AS sum_dr, sum(dc)::BIGINT AS sum_dc FROM fill GROUP BY event, seed_r, seed_c"),
    "q22_local_fill_passes": with_ctes("mark3", "SELECT event, seed_r, seed_c, count(*) AS n, sum(dr)::BIGINT AS sum_dr, sum(dc)::BIGINT AS sum_dc FROM mark3 GROUP BY event, seed_r, seed_c"),
    "q23_components": with_ctes("area", "SELECT r, c, value, label FROM area"),
    "q24_stream_polygon_join": with_ctes("crossed", "SELECT DISTINCT label, value, stream_id FROM area JOIN crossed USING (r, c)"),
    "q25_stream_polygon_semi": with_ctes("crossed", "SELECT DISTINCT label, value FROM area SEMI JOIN crossed USING (r, c)"),
    "q26_bathy_mask": with_ctes("bed", f"SELECT r, c, {_R('v')} FROM bed"),
    "q27_bathy_targets": with_ctes("bed", "SELECT r, c, CASE WHEN v = 0 THEN 'target' ELSE 'source' END AS kind FROM bed WHERE v >= 0"),
    "q28_topobathy_target_weight": with_ctes("bed", topo(weight("(sr - t.r)", "(sc - t.c)"))),
    "q29_topobathy_corner_weight": with_ctes("bed", topo(_CORNER)),
    "q30_neighborhood_argmin": with_ctes("seed", "SELECT s.event, s.r, s.c, arg_min(d.r, (d.z, d.r, d.c)) AS to_r, arg_min(d.c, (d.z, d.r, d.c)) AS to_c FROM seed s JOIN dem d ON d.r BETWEEN s.r - 3 AND s.r + 3 AND d.c BETWEEN s.c - 3 AND s.c + 3 WHERE d.z > 0.1 GROUP BY s.event, s.r, s.c"),
    "q31_implausible_report": with_ctes("reach_hyd", f"SELECT event, comid, {_R('tw', 'depth')} FROM reach_hyd WHERE tw > 20"),
    "q32_raster_algebra": with_ctes("bed", "SELECT r, c, round(z - v * m, 4) AS d FROM dem JOIN watermask USING (r, c) JOIN bed USING (r, c)"),
    "q33_config_first_match": rf"SELECT key, arg_min(value, n) AS value FROM (SELECT n, regexp_extract(trim(line), '^(\S+)', 1) AS key, regexp_extract(trim(line), '^\S+\s+(.+)$', 1) AS value FROM (VALUES {_CONFIG}) t(n, line)) WHERE value <> '' GROUP BY key",
    "q34_raster_extent": with_ctes("dem", "SELECT max(c) + 1 AS ncols, max(r) + 1 AS nrows, 1000e0 AS minx, 5000e0 - (max(r) + 1) * 10e0 AS miny, 1000e0 + (max(c) + 1) * 10e0 AS maxx, 5000e0 AS maxy FROM dem"),
    "q35_vdt_fixed_vs_curve_mode": with_ctes("cap", "SELECT 'curve' AS mode, event, round(cap, 4) AS cap FROM cap UNION ALL SELECT 'vdt', event, round(least(max(tw), 200e0), 4) FROM vdt_reach GROUP BY event UNION ALL SELECT 'fixed', 0, 200e0"),
    "q36_vdt_cells": with_ctes("vh", "SELECT event, r, c, round(arg_max(tw, line_no), 4) AS tw, round(arg_max(wse, line_no), 4) AS wse FROM vh WHERE tw > 0.0001 AND wse > 0.0001 GROUP BY event, r, c"),
    "q37_vdt_seeds": with_ctes("seed", """SELECT event, r, c, round(wse, 4) AS wse, round(tw, 4) AS tw, CASE WHEN n <= 1 THEN 2 ELSE n END AS k FROM (
      SELECT event, r, c, wse, tw, round_even(least(tw, cap) / 10e0, 0)::INT AS n FROM (
        SELECT s.r, s.c, rh.event, CASE WHEN ch.wse >= 0.001 AND ch.tw >= 1e-5 THEN ch.wse ELSE z + rh.depth END AS wse, CASE WHEN ch.wse >= 0.001 AND ch.tw >= 1e-5 THEN ch.tw ELSE rh.tw END AS tw
        FROM stream s JOIN dem USING (r, c) JOIN vdt_reach rh ON rh.comid = s.comid
        LEFT JOIN (SELECT event, r, c, arg_max(tw, line_no) AS tw, arg_max(wse, line_no) AS wse FROM vh WHERE tw > 0.0001 AND wse > 0.0001 GROUP BY event, r, c) ch ON ch.event = rh.event AND ch.r = s.r AND ch.c = s.c
      ) JOIN (SELECT event, least(max(tw), 200e0) AS cap FROM vdt_reach GROUP BY event) USING (event) WHERE wse >= 0.001 AND tw >= 1e-5)"""),
    "q38_stamp_means": with_ctes("stamp", f"SELECT event, r, c, round(swz / sw, 4) AS wse, {_R('sw')} FROM stamp"),
    "q39_local_flood": with_ctes("fill", f"""SELECT r, c, (100 * count(*) // 3)::INT AS pct FROM (
      SELECT event, r, c FROM (
        SELECT b.event, b.r + b.dr AS r, b.c + b.dc AS c, sum(wse * {weight("b.dr", "b.dc")}) / sum({weight("b.dr", "b.dc")}) AS level
        FROM (SELECT * FROM box WHERE {ELLIPSE.format(dx='10e0', dy='10e0')}) b JOIN fill f ON f.event = b.event AND f.seed_r = b.r AND f.seed_c = b.c AND f.dr = b.dr AND f.dc = b.dc
        GROUP BY b.event, b.r + b.dr, b.c + b.dc) JOIN dem USING (r, c) WHERE level > z
      UNION SELECT event, r, c FROM stream CROSS JOIN events) GROUP BY r, c"""),
    "q40_grid_file": with_ctes("dem", f"SELECT r, c, {_R('z')} FROM dem"),
    "q41_curve_file": with_ctes("curve", f"SELECT row_number() OVER (ORDER BY line_no) AS line_no, comid, r, c, {_R('base_elev', 'depth_a', 'depth_b', 'tw_a', 'tw_b')} FROM curve"),
    "q42_flow_file": with_ctes("flow", f"SELECT row_number() OVER (ORDER BY line_no) AS line_no, comid, {_R('q0', 'q1', 'q2')} FROM flow"),
    "q43_stage_file": with_ctes("vdt", f"SELECT line_no, comid, r, c, {_R('elev', 'qb')}, (j - 1)::INT AS step, round(steps[j].q, 4) AS q, 1e0 AS v, round(steps[j].tw, 4) AS tw, round(steps[j].wse, 4) AS wse FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS j FROM (SELECT * REPLACE (row_number() OVER (ORDER BY line_no) AS line_no) FROM vdt))"),
    "q44_polygon_file": with_ctes("crossed", "SELECT value, stream_id, cells FROM (SELECT DISTINCT label, value, stream_id FROM area JOIN crossed USING (r, c)) JOIN (SELECT label, count(*) AS cells FROM area WHERE value > 0 GROUP BY label) USING (label)"),
    "q45_whole_run": with_ctes("ens", "SELECT r, c, pct FROM ens WHERE pct > 0"),
    "q46_grid_details": with_ctes("dem", "SELECT max(r) + 1 AS n_rows, max(c) + 1 AS n_cols, 10e0 AS dx, -10e0 AS dy, 1000e0 AS minx, 5000e0 - (max(r) + 1) * 10e0 AS miny, 1000e0 + (max(c) + 1) * 10e0 AS maxx, 5000e0 AS maxy FROM dem"),
    "q47_counts": with_ctes("seed", "SELECT (SELECT count(*) FROM curve) AS n_lines, (SELECT count(DISTINCT comid) FROM stream) AS n_reaches, (SELECT min(comid) FROM stream) AS min_id, (SELECT max(comid) FROM stream) AS max_id, (SELECT count(DISTINCT event) FROM rf) AS n_events, (SELECT count(*) FROM seed) AS n_seeds"),
    "q48_topobathy_file": with_ctes("bed", f"SELECT r, c, round(raw::FLOAT::DOUBLE, 4) AS z FROM ({topo_rows(weight('(sr - t.r)', '(sc - t.c)'))})"),
    "q49_raster_list": "SELECT unnest(['b.img', 'd.tif', 'dem.tif']) AS name",
    "q50_fixed_depth_run": with_ctes("stream", f"""SELECT r, c, 100 AS pct FROM (
      SELECT r, c FROM (
        SELECT r + dr AS r, c + dc AS c, sum(wse * {weight()}) / sum({weight()}) AS level FROM (
          SELECT s.r, s.c, z + 0.1e0 AS wse, 20 AS k, dr, dc FROM stream s JOIN dem USING (r, c), (SELECT unnest(range(-20, 21)) AS dr), (SELECT unnest(range(-20, 21)) AS dc))
        WHERE {ELLIPSE.format(dx='10e0', dy='10e0')} GROUP BY r + dr, c + dc) JOIN dem USING (r, c) WHERE level > z
      UNION SELECT r, c FROM stream)"""),
}
