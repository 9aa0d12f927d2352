"""Scalar rules on vessels: categories, hulls, margins, times and colours."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category of ship type decades, and category colours (red, green, blue, alpha).
CATEGORIES = {"hs_craft": 40, "tug": 50, "passenger": 60, "cargo": 70, "tanker": 80}
COLORS = {
    "hs_craft": (253, 119, 3, 200), "tug": (253, 248, 3, 200), "passenger": (3, 236, 253, 200),
    "cargo": (182, 2, 254, 200), "tanker": (3, 253, 69, 200), "others": (222, 222, 222, 200),
}
RED, CYAN = (255, 0, 0, 150), (66, 247, 255, 150)


def _literal(color: tuple[int, ...]) -> Column:
    return F.array(*map(F.lit, color))


def ship_category(ship_type: Column) -> Column:
    out = None
    for name, low in CATEGORIES.items():
        test = (ship_type >= low) & (ship_type < low + 10)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("others")


def is_tanker(ship_type: Column) -> Column:
    return F.coalesce((ship_type >= 80) & (ship_type < 90), F.lit(False))


def category_color(category: Column) -> Column:
    return F.create_map(*[x for k, v in COLORS.items() for x in (F.lit(k), _literal(v))])[category]


def hull_dims(to_bow: Column, to_stern: Column, to_port: Column, to_starboard: Column) -> tuple[Column, Column]:
    """(length, beam); a null part gives null."""
    return to_bow + to_stern, to_port + to_starboard


def normalize_cog(cog: Column) -> Column:
    return F.when(cog == 360, F.lit(0.0)).otherwise(cog)


def as_time(as_of: datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def elapsed_seconds(as_of: datetime, ts: Column) -> Column:
    """Whole seconds from ts to as_of."""
    return F.timestamp_diff("SECOND", ts.cast("timestamp_ntz"), as_time(as_of))


def older_than(as_of: datetime, ts: Column, hours: float) -> Column:
    return ts.cast("timestamp_ntz") < as_time(as_of) - F.make_dt_interval(secs=F.lit(hours * 3600.0).cast("decimal(18,6)"))


def time_margin(as_of: datetime, ts: Column) -> Column:
    """Metres added to a hull distance by the age of the last report, first matching rule."""
    age = lambda h: older_than(as_of, ts, h)
    young = lambda h: ts.cast("timestamp_ntz") > as_time(as_of) - F.make_dt_interval(secs=F.lit(h * 3600.0).cast("decimal(18,6)"))
    return F.when(age(2.0), F.lit(50.0)).when(young(0.5), F.lit(10.0)).when(young(0.1), F.lit(2.5)).otherwise(F.lit(30.0))


def time_sog_limit(as_of: datetime, ts: Column) -> Column:
    """Largest speed of a partner by the age of its last report, first matching rule."""
    age = lambda h: older_than(as_of, ts, h)
    young = lambda h: ts.cast("timestamp_ntz") > as_time(as_of) - F.make_dt_interval(secs=F.lit(h * 3600.0).cast("decimal(18,6)"))
    return F.when(age(1.0), F.lit(1.0)).when(young(0.5), F.lit(0.5)).when(young(0.1), F.lit(0.3)).otherwise(F.lit(1.0))


def heading_diff(a: Column, b: Column) -> Column:
    """Plain absolute difference, not around the circle."""
    return F.abs(a - b)


def sts_threshold_m(diff: Column, partner_beam: Column, anchor_beam: Column, anchor_stern: Column, partner_margin: Column) -> Column:
    """Largest distance of a partner: side by side by half beams and margin, crossing by beam and stern length."""
    beside = (partner_beam + anchor_beam) / F.lit(2.0) + partner_margin
    across = (partner_beam + anchor_stern).cast("double")
    crossing = ((diff > 30) & (diff <= 110) | (diff >= 260) & (diff <= 280) | (diff > 300) & (diff < 350))
    return F.when(crossing, across).otherwise(beside)


def local_time(ts: Column, hours: int = 8) -> Column:
    return F.date_format(ts + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd HH:mm:ss")


def utc_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def time_text(ts: Column) -> Column:
    """A time as text, with six digits of a second only where it is no whole second."""
    whole, micros = F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def epoch_ms_to_ts(ms: Column) -> Column:
    """UTC time without zone; independent of the session's time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))


def parse_ts(text: Column) -> Column:
    """Time without zone, null where the text is none."""
    return text.try_cast("timestamp_ntz")


def default_text(text: Column, default: str = "Not Available") -> Column:
    return F.coalesce(text, F.lit(default))


def lane_short_name(name: Column) -> Column:
    return F.substring(name, 1, 5)


def severity_color(anchor_length: Column, any_zero: Column, any_short: Column) -> Column:
    """Red where a length is unknown (0), else cyan where a hull is at most 68 m, else red; nulls are false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(anchor_length == 0) | yes(any_zero), _literal(RED)).when(yes(anchor_length <= 68) | yes(any_short), _literal(CYAN)).otherwise(_literal(RED))


def highlight(color: Column, flagged: Column, compat: bool = False) -> Column:
    """color with alpha 255 where flagged (300 with compat, which is out of range) and 70 elsewhere."""
    alpha = F.when(flagged == 1, F.lit(300 if compat else 255)).otherwise(F.lit(70))
    return F.concat(F.slice(color, 1, 3), F.array(alpha))


def split_command(value: Column) -> tuple[Column, Column]:
    """(verb, mmsi) of `verb:mmsi`; mmsi is null where it is no number."""
    parts = F.split(value, ":")
    return F.get(parts, 0), F.get(parts, 1).try_cast("bigint")


def clean_number(x: Column) -> Column:
    """NaN to null."""
    return F.when(~F.isnan(x), x)
