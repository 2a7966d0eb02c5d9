"""Column functions over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formfield import constants as K


def finite(col, default) -> Column:
    """The value, or ``default`` where it is NULL, NaN or infinite."""
    x = F.col(col) if isinstance(col, str) else col
    x = x.cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(ok, x).otherwise(F.lit(default).cast("double"))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def fixed_point(x, digits: int) -> Column:
    """Round a double to ``digits`` decimals by its exact binary value, ties to even.

    Formatting rounds the shortest decimal instead, which turns 22.25 into 22.3. Only a
    scaled value of exactly one half is in doubt; the product's own rounding error (split
    into two halves of the mantissa) tells on which side it lies.
    """
    x = F.col(x) if isinstance(x, str) else x
    a, scale = F.abs(x), 10.0 ** digits
    scaled = a * scale
    whole = F.floor(scaled)
    high = a * 134217729.0 - (a * 134217729.0 - a)
    error = (high * scale - scaled) + (a - high) * scale
    part = scaled - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    rounded = F.when(up, whole + 1).otherwise(whole) / scale
    return F.when(x < 0, rounded * -1.0).otherwise(rounded)


def shrunk_rate(wins, places23, starts, place_weight: float = 0.35) -> Column:
    """Win rate plus weighted top-3 rate, both pulled toward a prior of eight starts."""
    w, p, s = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for c in (wins, places23, starts))
    prior = F.greatest(s, F.lit(0)) + 8.0
    return (w + 1.0) / prior + place_weight * ((w + p + 3.0) / prior)


def box_prior(box) -> Column:
    """Broad win rate of a starting box (a fixed table of eight entries)."""
    b = F.col(box) if isinstance(box, str) else box
    pairs = [F.lit(v) for kv in K.BOX_PRIOR.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), b.cast("int")), F.lit(K.BOX_PRIOR_OTHER))


def box_rates(box, wins, places23, starts) -> tuple[Column, Column]:
    """Prior-shrunk win and top-3 rate of a runner from its current box."""
    w, p, s = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for c in (wins, places23, starts))
    win = (w + box_prior(box) * 6.0) / (s + 6.0)
    place = (w + p + 0.375 * 6.0) / (s + 6.0)
    return win, place


def box_score(box, wins, places23, starts) -> Column:
    win, place = box_rates(box, wins, places23, starts)
    return win + 0.32 * place


def freshness_score(days) -> Column:
    """Piecewise score of the days since the last run, best near a week."""
    d = F.greatest(F.col(days) if isinstance(days, str) else days, F.lit(0.0))
    return (
        F.when(d <= 2, 0.45)
        .when(d <= 12, 1.0 - F.abs(d - 7.0) / 25.0)
        .when(d <= 28, 0.75 - (d - 12.0) / 80.0)
        .when(d <= 56, 0.55 - (d - 28.0) / 100.0)
        .otherwise(0.25)
    )


def trainer_score(win, place) -> Column:
    return 0.72 * finite(win, K.DEFAULTS["trainer_win"]) + 0.28 * finite(place, K.DEFAULTS["trainer_place"])


def trackdist_score(course_distance, distance, course) -> Column:
    """Blend of three shrunk rates; each argument is a (wins, places23, starts) triple."""
    return (
        0.48 * shrunk_rate(*course_distance)
        + 0.31 * shrunk_rate(*distance)
        + 0.21 * shrunk_rate(*course)
    )


def listed_price(listed: Column, tab_price: Column) -> Column:
    """The listed price, or the bookmaker's price of the detail block where none is listed, or none."""
    listed = F.coalesce(listed, F.lit(K.NO_PRICE))
    return F.when(listed >= K.NO_PRICE, F.coalesce(tab_price.cast("double"), listed)).otherwise(listed)
