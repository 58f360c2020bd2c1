"""Code lists and bucket boundaries, kept as fixed values, and the columns over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cancellation codes of the published extract.
CANCELLATION_REASONS = (("A", "Carrier"), ("B", "Weather"), ("C", "National Air System"), ("D", "Security"))

# Readable names of the five delay causes.
CAUSE_LABELS = (
    ("carrier_delay", "Carrier Delay"),
    ("weather_delay", "Weather Delay"),
    ("nas_delay", "NAS Delay"),
    ("security_delay", "Security Delay"),
    ("late_aircraft_delay", "Late Aircraft Delay"),
)

# Scheduled-buffer buckets of the turnaround view, as (upper bound in minutes, label).
BUFFER_BUCKETS = (
    (0, "<=0 (no scheduled buffer)"), (30, "0-30"), (45, "30-45"), (60, "45-60"),
    (90, "60-90"), (120, "90-120"), (None, "120+"),
)

# Prior-leg delay bins, and buffer bins that leave out non-positive
# buffers, as (upper bound in minutes, label).
PRIOR_DELAY_BINS = ((0, "<=0"), (15, "1-15"), (30, "15-30"), (60, "30-60"), (120, "60-120"), (None, "120+"))
POSITIVE_BUFFER_BINS = ((30, "<30"), (45, "30-45"), (60, "45-60"), (90, "60-90"), (120, "90-120"), (None, "120+"))


def lookup(code: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """The text paired with a code, null for any other code."""
    first, *rest = pairs
    picked = F.when(code == first[0], first[1])
    for key, text in rest:
        picked = picked.when(code == key, text)
    return picked


def bin_number(value: Column, bins: tuple[tuple[int | None, str], ...]) -> Column:
    """Position of the right-closed bin a value falls in; null stays null."""
    (first_bound, _), *rest = bins
    number = F.when(value <= first_bound, 0)
    for position, (bound, _) in enumerate(rest, start=1):
        number = number.when(value.isNotNull() if bound is None else value <= bound, position)
    return number.cast("int")


def bin_label(number: Column, bins: tuple[tuple[int | None, str], ...]) -> Column:
    """The label that belongs to a bin position."""
    return F.element_at(F.array(*[F.lit(label) for _, label in bins]), number + 1)
