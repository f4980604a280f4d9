"""License scans with ordered signature rules, in DataFrame functions only.

A text becomes lower-case words (A-Z only) with one space between. Keywords gate the rules: the text's words are met
with all keywords at once, and a rule's regex runs only over texts that hold one of its own. Detections are intervals
of words. They are resolved by priority, the best first: a detection goes if it overlaps a kept one of a better priority,
or lies within a kept one of its own priority (of equal intervals the rule that comes first stays). Base phrases are
looked up apart and are never suppressed.

Within a priority that is three sweeps over sorted intervals, so a text's detections cost about as much as their sorting.

Cases: null text is empty: no words, no places, score 0, empty label lists. Repeated rows give repeated results.
Columns other than those named in ``keep`` are ignored. Texts are scanned whole; all work is within a row, so no group
of rows can grow hot, and the memory that a text takes grows with its length only. Results hold each text's detections
as an array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lower_ascii
from .license_rules import CONFIDENCE, RULES

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sorted by start, kept ones before others, then the longest first.
_SPAN = "struct<start:int,side:int,minus_end:int,priority:int,rule:int>"
_NO_START = 2**31 - 1


def _spaces(x: Column) -> Column:
    return (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))).cast("int")


def words(text: Column) -> Column:
    """The text's words with a space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _let(value: Column, then: Callable) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(numbers: Column, join: Callable) -> Column:
    """What ``join`` makes of each number and all before it, by doubling strides: a fold would copy its state at each step."""
    rounds = F.when(F.size(numbers) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, numbers, lambda a, r: F.transform(a, lambda x, i: join(x, F.get(a, i - F.call_function("shiftleft", F.lit(1), r)))))


def _end(span: Column) -> Column:
    return -span["minus_end"]


def _filtered(spans: Column, number: Callable, carried: Callable, keep: Callable) -> Column:
    """The spans for which ``keep`` holds, given what ``carried`` makes of the ``number`` of each span and all before it."""
    bind = lambda s: _let(F.struct(s.alias("s"), _running(F.transform(s, number), carried).alias("c")), lambda t: F.filter(t["s"], lambda x, i: keep(x, F.get(t["c"], i), F.get(t["c"], i - 1))))
    return _let(spans, bind)


def _within_level(kept: Column, found: Column) -> Column:
    """Those of one priority's spans that overlap no kept span (all of better priorities) and lie in no other of theirs."""
    both = F.sort_array(F.concat(F.transform(kept, lambda s: s.withField("side", F.lit(0))), found))
    # Kept spans that begin no later reach to the largest end so far; then from the back, the nearest that begins later.
    clear = _filtered(both, lambda x: F.when(x["side"] == 0, _end(x)).otherwise(-1), F.greatest, lambda x, c, _: (x["side"] == 0) | (c < x["start"]))
    clear = _filtered(F.reverse(clear), lambda x: F.when(x["side"] == 0, x["start"]).otherwise(_NO_START), F.least, lambda x, c, _: (x["side"] == 1) & (c > _end(x)))
    return _filtered(F.sort_array(clear), _end, F.greatest, lambda x, _, before: F.coalesce(before < _end(x), F.lit(True)))


def _resolved(spans: Column) -> Column:
    """The kept spans, in order of start."""
    none = F.array().cast(f"array<{_SPAN}>")
    levels = F.array(*map(F.lit, sorted(CONFIDENCE)))
    kept = F.aggregate(levels, none, lambda kept, p: F.concat(kept, _within_level(kept, F.filter(spans, lambda s: s["priority"] == p))))
    return F.sort_array(F.transform(kept, lambda s: s.withField("side", F.lit(1))))


def _marked(rules) -> Callable:
    """The text with marks around what a rule, given by its number, matches. Each regex is a literal, so a task compiles
    it once."""
    cases = [(i, f"(?<= )(?:{regex})(?= )") for i, (*_, regex) in enumerate(rules)]

    def of(number: Column) -> Column:
        out = F
        for i, regex in cases:
            out = out.when(number == i, F.regexp_replace("__words", regex, "\x01$0\x02"))
        return out

    return of


def _spans(marked: Column, rule: Column) -> Column:
    """Where a rule matches: each match's first and last word, from the text cut at the marks."""

    def placed(t: Column) -> Column:
        first = lambda i: F.get(t["at"], i) - 1
        last = lambda piece, i: first(i) + _spaces(F.substring_index(piece, "\x02", 1))
        span = lambda piece, i: F.struct(first(i).alias("start"), F.lit(1).alias("side"), (-last(piece, i)).alias("minus_end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"))
        return F.transform(F.slice(t["pieces"], 2, F.size(t["pieces"])), span)

    at = lambda pieces: _running(F.transform(pieces, _spaces), lambda x, y: x + F.coalesce(y, F.lit(0)))
    return _let(F.split(marked, "\x01"), lambda pieces: _let(F.struct(pieces.alias("pieces"), at(pieces).alias("at")), placed))


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", rules=RULES, base: dict[str, str] = BASE) -> DataFrame:
    """The columns in ``keep``, and n_words, base (a struct for each phrase: label, n, first, last), detections (start
    and end word, label, priority, confidence)."""
    body = F.col("__words")
    listed = ", ".join(repr(w) for w in sorted({w for _, _, words, _ in rules for w in words}))
    rows = docs.select(*keep, words(F.col(text)).alias("__words"))
    rows = rows.select("*", F.when(F.length(F.trim(body)) > 0, _spaces(body) - 1).otherwise(0).cast("long").alias("n_words"), F.array_intersect(F.split(body, " "), F.expr(f"array({listed})")).alias("__present"))
    places = []
    for phrase, label in base.items():
        pieces = F.split(body, f"(?<= ){phrase}(?= )", -1)
        last = F.col("n_words") - (_spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split())
        found = F.struct(F.lit(label).alias("label"), (F.size(pieces) - 1).cast("long").alias("n"), (_spaces(F.element_at(pieces, 1)) - 1).cast("long").alias("first"), last.cast("long").alias("last"))
        places.append(F.when(F.contains(body, F.lit(f" {phrase} ")), found))
    table = ", ".join(f"named_struct('rule', {i}, 'priority', {p}, 'keywords', array({', '.join(map(repr, k))}))" for i, (_, p, k, _) in enumerate(rules))
    tried, marked = F.expr(f"filter(array({table}), x -> arrays_overlap(__present, x.keywords))"), _marked(rules)
    none = F.array().cast(f"array<{_SPAN}>")
    spans = F.when(F.size("__present") > 0, F.flatten(F.transform(tried, lambda r: _spans(marked(r["rule"]), r)))).otherwise(none)
    rows = rows.select(*keep, "n_words", F.array_compact(F.array(*places)).alias("base"), spans.alias("__spans"))
    kept = F.when(F.size("__spans") > 0, _resolved(F.col("__spans"))).otherwise(none)
    sure = F.create_map(*(F.lit(v) for p in CONFIDENCE.items() for v in p))
    labels = F.array(*(F.lit(label) for label, *_ in rules))
    shape = F.transform(kept, lambda s: F.struct(s["start"].cast("long").alias("start"), _end(s).cast("long").alias("end"), F.element_at(labels, s["rule"] + 1).alias("label"), s["priority"].alias("priority"), F.element_at(sure, s["priority"]).alias("confidence")))
    return rows.select(*keep, "n_words", "base", shape.alias("detections"))
