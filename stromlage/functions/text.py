"""Display text of queue and context rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stromlage import fixed_values as fv


def infra_text(hospitals: Column, schools: Column, markets: Column) -> Column:
    """``Hospital (n), School (n), Market (n)`` without the empty parts."""
    parts = [
        F.when(count != 0, F.format_string(f"{word} (%d)", count))
        for word, count in (("Hospital", hospitals), ("School", schools), ("Market", markets))
    ]
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "Residential").otherwise(text)


def disco_label(name: Column) -> Column:
    return F.when(name.endswith("DisCo"), name).otherwise(F.concat(name, F.lit(" DisCo")))


def strip_class(name: Column) -> Column:
    """Without the voltage class."""
    return F.replace(F.replace(name, F.lit(" 330kV"), F.lit("")), F.lit(" 132kV"), F.lit(""))


def short_name(name: Column, width: int = 18) -> Column:
    return F.substring(strip_class(name), 1, width)


def without_last_word(name: Column) -> Column:
    return F.regexp_replace(name, " [^ ]*$", "")


def fill_defaults(df: DataFrame) -> DataFrame:
    """Replace what a queue row may lack; columns not present are left out."""
    defaults = {
        "name": fv.DEFAULT_NAME,
        "risk": 0.0,
        "loss": 0.0,
        "lat": fv.DEFAULT_LAT,
        "lon": fv.DEFAULT_LON,
        "hospital_count": 0,
        "school_count": 0,
        "market_count": 0,
    }
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in df.columns}
    )


def crew_name(position: Column) -> Column:
    """Name for a 1-based position; numbered once the names run out."""
    names = F.array(*[F.lit(c) for c in fv.CREWS])
    numbered = F.concat(F.lit("Crew "), position.cast("string"))
    return F.coalesce(F.get(names, (position - 1).cast("int")), numbered)


def delta_direction(change: Column, invert: bool = False) -> Column:
    """``better``, ``worse`` or ``flat``; ``invert`` when higher is worse."""
    up, down = ("worse", "better") if invert else ("better", "worse")
    return (
        F.when(change.isNull(), F.lit(None).cast("string"))
        .when(change > 0, up)
        .when(change < 0, down)
        .otherwise("flat")
    )


def delta_text(change: Column, unit: str = "", decimals: int = 1) -> Column:
    """Arrow, sign and value of an hour-on-hour change."""
    arrow = F.when(change > 0, "↑ +").when(change < 0, "↓ ").otherwise("→ ")
    value = F.format_string(f"%.{decimals}f", change.cast("double"))
    shown = F.concat(arrow, value, F.lit(f"{unit} vs last hr"))
    return F.when(change.isNotNull(), shown).otherwise("— vs last hour")


def format_value(value: Column, unit: str, decimals: int = 2) -> Column:
    shown = F.when(
        value.isNotNull(), F.format_string(f"%.{decimals}f {unit}".replace(" %", " %%"), value)
    )
    return F.coalesce(shown, F.lit("— unavailable"))


def marker_size(risk: Column) -> Column:
    return (F.lit(10) + F.floor(risk / 10)).cast("int")


def time_label(ts: Column) -> Column:
    """Day, month name, year and minute; a dash without a time."""
    return F.coalesce(F.date_format(ts, "dd MMM yyyy HH:mm"), F.lit("—"))
