"""Scalar functions: native ``Column`` expressions only."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword groups, in declared order (first hit wins for actions).
ACTION_KEYWORDS = {
    "food": ("feed", "food", "meal"),
    "play": ("play", "toy"),
    "access": ("door", "access", "gate", "window"),
    "social": ("contact", "pet", "stroke", "call", "acknowledge", "social"),
}
OBJECT_KEYWORDS = {
    "door": ("door", "gate", "window", "access"),
    "toy": ("toy", "play"),
    "food_area": ("food", "feeder", "bowl", "meal", "kitchen"),
}
SENTINEL = -1.0
MISSING_LABEL = "__missing__"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_scaled(c: Column | str, digits: int = 6) -> Column:
    """The double nearest to ``c * 10^digits`` rounded half away from zero, over ``10^digits``: the rule of DuckDB's ``round``.

    Spark's ``round`` goes by the decimal text of the double, so that 41.0 / 640 (0.0640625, in binary a little less) becomes another value.
    """
    x, scale = col(c).cast("double"), F.lit(10.0 ** digits)
    return F.when(F.abs(x * scale) < float("inf"), F.round(x * scale) / scale).otherwise(x) + F.lit(0.0)


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round for display and comparison; adding 0.0 turns -0.0 into 0.0."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def norm_token(c: Column | str) -> Column:
    text = F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.replace(F.replace(text, F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))


def keyword_category(c: Column | str, groups: dict[str, Sequence[str]] = ACTION_KEYWORDS) -> Column:
    """First declared group with a substring hit in the normalised token, else NULL."""
    token = norm_token(c)
    out = F.lit(None).cast("string")
    for name, words in reversed(list(groups.items())):
        out = F.when(_hit(token, words), F.lit(name)).otherwise(out)
    return out


def keyword_flags(c: Column | str, groups: dict[str, Sequence[str]] = OBJECT_KEYWORDS) -> dict[str, Column]:
    """One boolean column per group (multi-label)."""
    token = norm_token(c)
    return {name: _hit(token, words) for name, words in groups.items()}


def _hit(token: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs; one pattern, so that the token is made once and not for every word."""
    return token.rlike("|".join(map(re.escape, words)))


_OFFSET = r"(Z|[+-][0-9]{2}:[0-9]{2})$"


def iso_micros(c: Column | str) -> Column:
    """Epoch microseconds of an ISO instant; NULL when it does not parse or carries no offset."""
    text = col(c)
    return F.when(text.rlike(_OFFSET), F.unix_micros(F.try_to_timestamp(text)))


def iso_problem(c: Column | str) -> Column:
    text = col(c)
    return (
        F.when(text.isNull(), F.lit("time_missing"))
        .when(~text.rlike(_OFFSET), F.lit("time_without_offset"))
        .when(F.try_to_timestamp(text).isNull(), F.lit("time_unparseable"))
    )


def local_hour(c: Column | str) -> Column:
    """Hour of day as written in the ISO text, so the recorded offset is respected."""
    text = col(c)
    part = lambda a, n: F.substring(text, a, n).cast("double")
    return part(12, 2) + part(15, 2) / 60.0 + part(18, 2) / 3600.0


def cyclic_hour(hour: Column) -> tuple[Column, Column]:
    angle = hour * F.lit(2.0 * math.pi) / F.lit(24.0)
    return F.sin(angle), F.cos(angle)


def abs_time(start_us: Column | str, offset_ms: Column | str) -> Column:
    return col(start_us) + col(offset_ms).cast("long") * F.lit(1000).cast("long")


def image_diagonal(width: Column | str, height: Column | str) -> Column:
    return F.hypot(col(width).cast("double"), col(height).cast("double"))


def dist2(ax, ay, bx, by) -> Column:
    return F.hypot(col(ax) - col(bx), col(ay) - col(by))


def dist3(ax, ay, az, bx, by, bz) -> Column:
    sq = lambda a, b: (col(a) - col(b)) * (col(a) - col(b))
    return F.sqrt(sq(ax, bx) + sq(ay, by) + sq(az, bz))


def bbox_iou_xywh(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    ax, ay, aw, ah, bx, by, bw, bh = (col(c).cast("double") for c in (ax, ay, aw, ah, bx, by, bw, bh))
    zero = F.lit(0.0)
    iw = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    ih = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = iw * ih
    usable = (aw > 0) & (ah > 0) & (bw > 0) & (bh > 0)
    return F.when(usable, inter / (aw * ah + bw * bh - inter)).otherwise(zero)


def angle_deg(ax, ay, bx, by) -> Column:
    """Angle between two vectors in degrees, NULL when either is shorter than 1e-12."""
    ax, ay, bx, by = (col(c) for c in (ax, ay, bx, by))
    na, nb = F.hypot(ax, ay), F.hypot(bx, by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (na * nb)))
    return F.when((na > 1e-12) & (nb > 1e-12), F.degrees(F.acos(cosine)))


def fingerprint(*cols: str) -> Column:
    """Tamper digest over a frozen projection: names sorted, NULL kept apart from absent text."""
    fields = [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in sorted(cols)]
    return F.sha2(F.to_json(F.array(*fields), {"ignoreNullFields": "false"}), 256)


def derived_seed(base: int | str, *parts: Column | str) -> Column:
    """60-bit seed from SHA-256 of base and parts joined by a vertical bar."""
    text = F.concat_ws("|", F.lit(str(base)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def stable_hash(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256)


def is_sha256(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def is_close(a, b, rel: float = 1e-9, abs_tol: float = 0.0) -> Column:
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))


def rgb_bin(r, g, b, bins: int = 8) -> Column:
    one = lambda v: F.least(F.floor(col(v) * bins / 256), F.lit(bins - 1)).cast("long")
    return (one(r) * bins + one(g)) * bins + one(b)


def seg_visible(counts: Column | str) -> Column:
    return F.coalesce(F.exists(col(counts), lambda c: c != 0), F.lit(False))


def sentinel(c: Column | str, missing: float = SENTINEL) -> tuple[Column, Column]:
    """(value or the sentinel, 1.0/0.0 missing flag)."""
    return F.coalesce(col(c).cast("double"), F.lit(missing)), col(c).isNull().cast("double")


def finite(c: Column | str) -> Column:
    """Text or number to a finite double; blank, NaN and infinities become NULL."""
    value = F.try_cast(F.trim(col(c).cast("string")), "double") if hasattr(F, "try_cast") else F.expr(
        f"try_cast(trim(cast({c} AS string)) AS double)"
    )
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def finite_double(c: Column | str) -> Column:
    value = col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def centroid(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    return F.avg(col(x)), F.avg(col(y))


def centroid_of(points: Column | str, x: str = "x_px", y: str = "y_px") -> Column:
    """struct<x, y, error> of an array of points; without any, or with a coordinate that is not finite, there is only the error."""
    points = col(points)
    mean = lambda name: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[name].cast("double")) / F.size(points)
    bad = F.exists(points, lambda p: finite_double(p[x]).isNull() | finite_double(p[y]).isNull())
    error = F.when(points.isNull() | (F.size(points) == 0), F.lit("reference_points_required")).when(bad, F.lit("reference_point_not_finite"))
    return F.struct(F.when(error.isNull(), mean(x)).alias("x"), F.when(error.isNull(), mean(y)).alias("y"), error.alias("error"))


def lgamma(x: Column) -> Column:
    """ln Gamma for x >= 1: shift to x >= 8, then the Stirling series."""
    shift = F.greatest(F.lit(0.0), F.ceil(F.lit(8.0) - x).cast("double"))
    product = F.lit(1.0)
    for k in range(8):
        product = product * F.when(F.lit(float(k)) < shift, x + F.lit(float(k))).otherwise(F.lit(1.0))
    z = x + shift
    z2 = z * z
    series = (
        (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2.0 * math.pi))
        + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z2) + 1.0 / (1260.0 * z * z2 * z2)
        - 1.0 / (1680.0 * z * z2 * z2 * z2)
    )
    return series - F.ln(product)
