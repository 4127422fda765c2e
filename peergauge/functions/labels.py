"""Turn raw classifier answers into labels of a closed set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from peergauge.functions.text import strip

# Markers of unusable answers, and how much of the answer is kept.
UNPARSEABLE = "UNPARSEABLE"
FAILURE = "API_FAILURE"
ECHO_CHARS = 60


def _unparseable(text: Column) -> Column:
    return F.concat(F.lit(f"{UNPARSEABLE}::"), F.substring(text, 1, ECHO_CHARS))


def normalise_label(answer: Column, labels: Sequence[str], missing: str | None = FAILURE) -> Column:
    """The label of the set that equals the answer but for case and outer blanks.

    Other answers keep their first characters behind a marker. A missing answer
    becomes ``missing`` (``None`` keeps it null).
    """
    text = strip(answer)
    known = F.create_map(*[F.lit(x) for label in labels for x in (label.lower(), label)])
    return F.when(answer.isNull(), F.lit(missing)).otherwise(
        F.coalesce(F.try_element_at(known, F.lower(text)), _unparseable(text))
    )


def normalise_yes_no(answer: Column, missing: str | None = FAILURE) -> Column:
    """YES or NO whatever the case and trailing full stops; marked text otherwise."""
    text = strip(answer)
    word = F.rtrim(F.upper(text), F.lit("."))
    return F.when(answer.isNull(), F.lit(missing)).otherwise(
        F.when(word.isin("YES", "NO"), word).otherwise(_unparseable(text))
    )


def usable(label: Column) -> Column:
    """False for marked and failed answers, and for null."""
    return F.coalesce(~(label.startswith(UNPARSEABLE) | label.startswith(FAILURE)), F.lit(False))
