"""The decision report on a raster, and its verdicts."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import functions as F

from orogen.api import NAMES, Raster, _checked, _shape, quantized
from orogen.functions import pixel as px
from orogen.operators import budget, stats
from orogen.operators import kernels as kn
from orogen.plans.staging import stage
from orogen.sources.container import IDENTITY

AUTHORITY = re.compile(r"(?:AUTHORITY|ID)\[\s*\"([^\"]+)\"\s*,\s*\"?(\w+)\"?\s*\]")
RESIDUAL = {kn.NONE: "none", kn.AVERAGE: "average", kn.MEDIAN: "median", kn.LEFT2: "left", kn.GRADIENT2: "gradient", kn.GAP2: "gap", kn.LEAST_SQUARES2: "least_squares"}


def crs_of(wkt: str) -> tuple[str, str]:
    """Authority code, the last one in the text, and unit of a projection text."""
    if not wkt:
        return "", ""
    codes = AUTHORITY.findall(wkt)
    return ":".join(codes[-1]) if codes else "", "deg" if re.match(r"\s*GEO(?:GCS|GCRS|DCRS)", wkt) else "m"


def bounds(transform: tuple[float, ...], width: int, height: int) -> tuple[float, float, float, float]:
    ox, pw, rx, oy, ry, ph = transform
    corners = [(ox + c * pw + r * rx, oy + c * ry + r * ph) for c in (0, width) for r in (0, height)]
    xs, ys = zip(*corners, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def digits_of(precision: float) -> int:
    """Decimal digits below one; 0 for a precision of one or more, -1 if it is no power of ten."""
    if precision >= 1:
        return 0
    m = kn.half_away(1.0 / precision)
    k = len(str(m)) - 1
    return k if m == 10**k else -1


def analyze(raster: Raster, precision: float = 1.0, wavelets: bool = False) -> dict[str, Any]:
    """The report as a dictionary: dataset, compressibility, predictors, tree, entropy budget and verdicts.

    Grid and tile costs are written once and read by the aggregates; the coarser precisions take
    a pass each over the quantized grid."""
    _checked(precision, "predictor", "simple")
    width, height = _shape(raster.pixels)
    cells = width * height
    grid = stage(quantized(raster, precision), "quantized")
    raw = raster.pixels.select("y", "x", "z", px.is_nodata(F.col("z"), raster.nodata).alias("nodata"))
    r, q, c = stats.raw_stats(raw, "nodata").first(), stats.quantized_stats(grid).first(), stats.spatial_correlation(grid).first()
    ranks = {f"p{round(100 * p['fraction'])}": p["value"] for p in stats.percentiles(raw, "nodata", cells).collect()}
    bars = {b["bucket"]: b["height"] for b in stats.histogram(raw, "nodata").collect()}
    k = digits_of(precision)
    places = sorted((p["place"], p["entropy"]) for p in stats.digit_planes(grid, k + 1).collect()) if k >= 0 else []

    found = stage(budget.costs(grid, precision, wavelets), "costs")
    t = budget.totals(found).first()
    table = budget.predictor_table(found).collect()
    overhead = t["blocks"] * (25 if precision < 1 else 17) + t["structure"]
    parts = {"magnitude": t["classes"], "zero_runs": t["runs"], "remainder": t["remainders"], "parameters": t["params"], "overhead": overhead}
    parts = {name: v / cells for name, v in parts.items()}
    bpp = sum(parts.values())
    size = bpp * cells / 8 + 36 * t["blocks"] + 256
    sweep = [{"precision": precision, "bpp": bpp, "estimated_bytes": size}]
    for i in range(1, k + 1):
        coarse = grid.withColumn("q", px.div(F.col("q"), 10**i))
        s = budget.totals(budget.costs(coarse, precision * 10**i, leaves_only=True)).first()
        bits = s["bits"] + s["structure"] + 9 * s["blocks"]
        sweep.append({"precision": precision * 10**i, "bpp": bits / cells, "estimated_bytes": bits / 8 + 36 * s["blocks"] + 256})

    crs, units = crs_of(raster.wkt)
    chosen = max(table, key=lambda p: p["usage_blocks"])  # the first of equals, which is the cheaper
    report = {
        "dataset": {
            "dimensions": [width, height], "pixel_count": cells, "nodata_count": q["masked"], "crs": crs, "pixel_units": units,
            "has_georeference": bool(raster.wkt) or tuple(raster.transform) != IDENTITY,
            "pixel_resolution": [abs(raster.transform[1]), abs(raster.transform[5])], "bounding_box": list(bounds(raster.transform, width, height)),
            "elevation": {"min": r["min"], "max": r["max"], "mean": r["mean"], "stddev": r["stddev"], "valid_pixels": r["valid"], "percentiles": ranks, "histogram": [bars.get(i, 0.0) for i in range(stats.BUCKETS)] if bars else []},
            "quantized": {x: q[x] for x in ("min", "max", "mean", "stddev")},
            "spatial_correlation": {x: c[x] for x in "hvd"},
        },
        "compressibility": {
            "precision": precision, "bpp": bpp, "estimated_bytes": size, "estimated_bytes_stddev": (t["blocks"] * t["variance"]) ** 0.5 / 8 if t["blocks"] > 1 else 0.0,
            "compression_ratio": 4 * cells / size, "precision_estimates": sweep if len(sweep) > 1 else [], "digit_planes": [{"place": p, "bpp": v} for p, v in places],
        },
        "predictors": [{"rank": i, "name": NAMES[p["pid"]], "selection_bpp": p["selection_bpp"], "shannon_bpp": p["shannon_bpp"], "usage": p["usage_blocks"] / t["blocks"], "avg_abs_residual": p["avg_abs_residual"]} for i, p in enumerate(table, 1)],
        "encoder_choice": NAMES[chosen["pid"]],
        "encoder_choice_usage_pct": 100 * chosen["usage_blocks"] / t["blocks"],
        "residual_reprediction": {"usage_pct": 100 * t["second_blocks"] / t["blocks"], "savings_bpp": t["saved"] / cells, "savings_bytes": t["saved"] / 8, "blocks": {RESIDUAL[x["second"]]: x["count"] for x in found.where(F.col("kind") == budget.LEAF).groupBy("second").count().collect()}},
        "quadtree": {"leaves": {str(w): t[f"leaves_{w}"] for w in (512, 256, 128, 64)}, "total_blocks": t["blocks"]},
        "entropy_budget": parts | {"total": bpp},
    }
    if wavelets:
        own, other = (t["classes"] + t["runs"] + t["remainders"]) / cells, t["wavelet"] / cells
        report["wavelet"] = {"evaluated": True, "predictor_estimate_bpp": own, "wavelet_estimate_bpp": other, "recommended": other < own}
    report["verdicts"] = verdicts(report)
    return report


def verdicts(report: dict[str, Any]) -> list[str]:
    """What the figures say, in words."""
    d, comp = report["dataset"], report["compressibility"]
    h, v = d["spatial_correlation"]["h"], d["spatial_correlation"]["v"]
    out = []
    if comp["compression_ratio"] >= 5:
        out.append("compresses well")
    if comp["compression_ratio"] < 2 or comp["bpp"] > 8:
        out.append("compresses badly")
    if min(h, v) >= 0.95:
        out.append("smooth terrain")
    elif max(h, v) < 0.3:
        out.append("noisy terrain")
    if d["nodata_count"] > 0.1 * d["pixel_count"]:
        out.append("more than a tenth of the cells hold no data")
    return out
