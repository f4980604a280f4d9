"""Text cleaning: steps that Catalyst has as expressions, and the whole chain as one Arrow UDF.

Order: NFKC, tags to a space, entities decoded, control characters removed, white space collapsed. It is applied once:
decoded entities may look like markup.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .types import slices, struct, struct_array

# What counts as a tag and as a control character.
TAG = r"<[^>]{1,200}>"
CONTROL = "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u200b-\u200f\ufeff]"
_TAG, _CONTROL, _SPACE = re.compile(TAG), re.compile(CONTROL), re.compile(r"\s+")
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def remove_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200f}\x{feff}]", "")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")


def strip_space(text: Column) -> Column:
    """Unicode white space at both ends."""
    return F.regexp_replace(text, STRIP, "")


def decode_basic_entities(text: Column) -> Column:
    """The five XML entities, the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def clean_one(text: str) -> tuple[str, list[str]]:
    """Cleaned text and the codes of the steps that changed it, in the order of the steps."""
    codes = []
    now = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if now != text:
        codes.append("W003")
    plain = html.unescape(_TAG.sub(" ", now)) if "<" in now or "&" in now else now
    if plain != now:
        codes.append("W002")
    kept = _CONTROL.sub("", plain)
    if kept != plain:
        codes.append("W004")
    done = _SPACE.sub(" ", kept).strip()
    if done != kept:
        codes.append("W001")
    return done, codes


_CLEANED = "text string, warnings array<string>"


@F.arrow_udf(struct(_CLEANED))
def clean_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Null stays null, with no warnings."""
    for part in slices(batches):
        yield struct_array(_CLEANED, [clean_one(t) if t is not None else (None, []) for t in part.to_pylist()])


@F.arrow_udf(StringType())
def _casefold(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([None if t is None else t.casefold() for t in part.to_pylist()], pa.string()) for part in slices([texts])] or [texts])


def casefold(text: Column | str) -> Column:
    """Of pure ASCII it is lower case, which needs no crossing to Python; the other texts cross."""
    text = F.col(text) if isinstance(text, str) else text
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(_casefold(F.when(~ascii_only, text)))


def fingerprint(headline: Column, description: Column) -> Column:
    """Of casefolded texts; exact otherwise."""
    return F.sha2(F.concat(casefold(headline), F.lit("\n"), casefold(description)), 256)


def read_bid(value: object) -> tuple[float | None, list[str]]:
    """Numbers as they are; text without dollar signs and commas, with a warning; anything else is no number."""
    if isinstance(value, bool):
        return None, []
    if isinstance(value, int | float):
        try:
            return float(value), []
        except OverflowError:
            return float("inf") if value > 0 else float("-inf"), []
    if isinstance(value, str):
        try:
            return float(value.strip().replace("$", "").replace(",", "")), ["W005"]
        except ValueError:
            pass
    return None, []


def read_time(value: object) -> tuple[str | None, list[str]]:
    """UTC to the second; without an offset UTC is meant."""
    try:
        moment = datetime.fromisoformat(value.strip()) if isinstance(value, str) else None
        if moment is None:
            return None, []
        moment = moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)
    except (ValueError, OverflowError):
        return None, []
    text = f"{moment:%Y-%m-%dT%H:%M:%SZ}" if moment.year > 999 else f"{moment.year:04d}{moment:-%m-%dT%H:%M:%SZ}"
    return text, [] if text == value else ["W007"]


def doubles(values: list[float | None]) -> pd.Series:
    """A column in which NaN and null stay apart."""
    return pd.Series(pd.arrays.ArrowExtensionArray(pa.array(values, pa.float64(), from_pandas=False)))


@F.pandas_udf(struct("bid double, warnings array<string>"))
def coerce_bid(texts: pd.Series) -> pd.DataFrame:
    done = [read_bid(t) for t in texts]
    return pd.DataFrame({"bid": doubles([d[0] for d in done]), "warnings": [d[1] for d in done]})


@F.pandas_udf(struct("time string, warnings array<string>"))
def normalize_time(texts: pd.Series) -> pd.DataFrame:
    done = [read_time(t) for t in texts]
    return pd.DataFrame({"time": [d[0] for d in done], "warnings": [d[1] for d in done]}, dtype=object)
