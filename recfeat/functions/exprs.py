"""Column builders shared by batch and streaming operators."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed action weights, by scheme.
WEIGHTS: dict[str, tuple[dict[str, float], float]] = {
    "profile": ({"purchase": 5.0, "like": 3.0, "click": 2.0, "view": 1.0}, 0.5),
    "behaviour": ({"view": 1.0, "click": 2.0, "like": 3.0, "share": 3.5, "add_cart": 4.0, "purchase": 10.0, "favorite": 5.0}, 1.0),
    "offline": ({"view": 1.0, "click": 2.0, "like": 3.5, "share": 4.0, "purchase": 10.0}, 1.0),
    "stream": ({"view": 1.0, "click": 2.0, "add_cart": 3.0, "purchase": 10.0, "favorite": 4.0}, 0.0),
    "engagement": ({"impression": 0.1, "click": 0.3, "view": 0.5, "like": 0.7, "comment": 0.75, "favorite": 0.8, "share": 0.85, "add_cart": 0.9, "purchase": 1.0}, 0.0),
    "graph": ({"view": 1.0, "click": 2.0, "cart": 3.0, "add_cart": 3.0, "purchase": 5.0}, 0.0),
    "tag": ({"view": 1.0, "click": 2.0, "like": 3.0, "share": 4.0, "comment": 5.0, "add_cart": 6.0, "favorite": 7.0, "purchase": 10.0}, 0.0),
}


def action_weight(action: Column, scheme: str = "profile") -> Column:
    """The weight of an action under a scheme; other actions get the scheme's default."""
    weights, default = WEIGHTS[scheme]
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, action), F.lit(default))


def sd(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def m1(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a / F.greatest(b, F.lit(1))


def p1(a: Column, b: Column) -> Column:
    """a / (b + 1)."""
    return a / (b + 1)


def r6(c: Column) -> Column:
    """Rounded to six decimals, so that engines that sum in another order agree."""
    return F.round(c, 6)


def half_up(c: Column, places: int) -> Column:
    """floor(c * 10^places + .5) / 10^places: the same in every engine, also at ties, which ROUND takes up or down by its own arithmetic."""
    return F.floor(c * float(10**places) + 0.5) / float(10**places)


def sql_half_up(c: str, places: int) -> str:
    return f"floor(({c})::double * 1e{places}::double + 0.5::double) / 1e{places}::double"


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


def hash_bucket(c: Column, buckets: int) -> Column:
    """A bucket by the leading 32 bits of md5; other engines can compute the same."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def day_part(hour: Column) -> Column:
    return F.when(hour.between(6, 11), "morning").when(hour.between(12, 17), "afternoon").when(hour.between(18, 22), "evening").otherwise("night")


def price_band(price: Column) -> Column:
    return F.when(price < 20, "budget").when(price < 40, "mid").when(price < 60, "premium").otherwise("luxury")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle."""
    return F.sin(value * (2 * pi / period)), F.cos(value * (2 * pi / period))


def decay(days: Column, kind: str, rate: float) -> Column:
    """Interest decay; 1 for no time passed.  The logarithmic form is capped at 1, as it would exceed it for short times."""
    forms = {
        "exponential": F.exp(-rate * days),
        "linear": F.greatest(F.lit(0.0), 1 - rate * days),
        "logarithmic": F.least(F.lit(1.0), 1 / F.log(1 + rate * days)),
        "power": F.pow(days, F.lit(-rate)),
    }
    return F.when(days <= 0, 1.0).otherwise(forms[kind])


def trend(longer: Column, shorter: Column, ratio: float) -> Column:
    """The longer period's value per short period against the shorter one's, within -1..1."""
    return F.when(shorter == 0, 0.0).otherwise(clip((longer / ratio - shorter) / shorter, -1.0, 1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return sd(dot(a, b), norm(a) * norm(b))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function by the rational approximation of the error function (1.5e-7)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))
