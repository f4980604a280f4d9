"""From raw lines to verdicts: strict JSON, cleaning, rules in a fixed order, first failure wins."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_one, read_bid, read_time
from ..functions.types import slices, struct, struct_array
from ..schema import REQUIRED, TEXT_FIELDS, Limits

_READ = (
    "state string, field string, kind string, ad_id string, headline string, description string, category string, advertiser_id string, "
    "bid double, bid_text string, time string, time_text string, warnings array<string>, folded string"
)


def _read_line(line: str) -> tuple:
    """state is null for a record whose fields could be read; else what stopped it."""
    empty = (None,) * 9 + ([], None)
    try:
        raw = json.loads(line)
        if "\\u" in line:
            json.dumps(raw, ensure_ascii=False).encode()  # a lone surrogate has no UTF-8 form
    except (ValueError, RecursionError):
        return ("json", None, None, *empty)
    if not isinstance(raw, dict):
        return ("root", None, type(raw).__name__, *empty)
    for name in REQUIRED:
        if raw.get(name) is None:
            return ("missing", name, None, *empty)
    for name in TEXT_FIELDS:
        if raw.get(name) is not None and not isinstance(raw[name], str):
            return ("type", name, type(raw[name]).__name__, *empty)
    headline, codes = clean_one(raw["headline"])
    if raw.get("description") is None:
        description, more = "", ["W006"]
    else:
        description, more = clean_one(raw["description"])
    category, of_category = clean_one(raw["category"])
    bid, of_bid = read_bid(raw["bid_cpm_usd"])
    time, of_time = read_time(raw["created_at"])
    warnings = [*codes, *more, *of_category, *of_bid, *of_time]
    folded = f"{headline.casefold()}\n{description.casefold()}"
    return (None, None, None, raw["ad_id"].strip(), headline, description, category.lower(), raw["advertiser_id"].strip(), bid, repr(raw["bid_cpm_usd"]), time, raw["created_at"], warnings, folded)


@F.arrow_udf(struct(_READ))
def read_record(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """One crossing to Python for all that needs it: strict JSON, NFKC, entities, case folding, Python's numbers and dates.
    Lines become Python's objects a bounded slice at a time."""
    for part in slices(batches):
        yield struct_array(_READ, [_read_line(x) for x in part.to_pylist()])


def _fails(code: str, when: Column, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))


def verdict(r: Column, limits: Limits) -> Column:
    """Struct of code and detail of the first rule that fails, or null. Duplicates are judged elsewhere."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    title, body, bid = F.length(r["headline"]), F.length(r["description"]), r["bid"]
    return F.coalesce(
        _fails("E001", r["state"] == "json", F.lit("not valid JSON")),
        _fails("E003", r["state"] == "root", text("top level is ", r["kind"], ", not an object")),
        _fails("E002", r["state"] == "missing", text("no value for ", r["field"])),
        _fails("E003", r["state"] == "type", text(r["field"], " is ", r["kind"], ", not text")),
        _fails("E004", title == 0, F.lit("empty headline")),
        _fails("E005", title < limits.headline_min, text("headline length ", title, " below ", str(limits.headline_min))),
        _fails("E006", title > limits.headline_max, text("headline length ", title, " above ", str(limits.headline_max))),
        _fails("E006", body > limits.description_max, text("description length ", body, " above ", str(limits.description_max))),
        _fails("E007", bid.isNull(), text("unreadable bid ", r["bid_text"])),
        # NaN sorts above all numbers here, so it is asked for by name.
        _fails("E008", F.isnan(bid) | (F.abs(bid) == float("inf")) | (bid <= limits.bid_floor) | (bid > limits.bid_max), text("bid ", bid, " outside the range")),
        _fails("E009", ~r["category"].isin(*sorted(limits.categories)), text("unknown category ", r["category"])),
        _fails("E012", r["time"].isNull(), text("unreadable time ", r["time_text"])),
    )


def judged(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """line_no, line, r (the record as read), verdict; blank lines are left out."""
    rows = lines.where(F.trim(F.regexp_replace("line", r"(?U)[\s\x1c-\x1f]+", " ")) != "").withColumn("r", read_record("line"))
    return rows.withColumn("verdict", verdict(F.col("r"), limits))
