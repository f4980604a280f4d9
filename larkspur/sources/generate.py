"""Synthetic raw records with seeded defects, and the counts that a validation must then report.

Every choice is a hash of seed, row and purpose, so rows are made in parallel and alike on every run. A random order of
the rows assigns each at most one defect at a fixed rate; some others get noise that cleaning undoes. Repeated ids and
texts come from a clean row before, which is found by range: the nearest one below a random position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CATEGORIES, CLEAN_COLUMNS
from ..storage import fixed, make_dirs, write_json, write_lines

#: Parts per thousand of all rows; repeats are dealt first and need rows before them.
RATES = {"E010": 15, "E011": 10, "E001": 3, "E002": 15, "E003": 8, "E004": 5, "E005": 10, "E006": 8, "E007": 6, "E008": 20, "E009": 10, "E012": 6}
NOISE = 150
FIRST_REPEAT = 100
#: For each category its makers and goods.
_GOODS = {
    "apparel": ("Nettle Loom|Holt & Vane|Quillon", "wool scarf|linen shirt|rain jacket|work trousers|cotton socks"), "beauty": ("Myrica|Sable Fern|Dewlight", "face balm|hair oil|clay mask|hand soap|lip tint"),
    "education": ("Tallow Desk|Brightstep|Polyglot House", "grammar course|coding class|exam guide|drawing lessons|history lectures"), "electronics": ("Voltaire Works|Kestrel Audio|Ohmic", "wireless headset|desk speaker|travel charger|tablet stand|smart lamp"),
    "finance": ("Harrow Bank|Pennywell|Keel Savings", "savings account|travel card|budget planner|home loan|pension plan"), "fitness": ("Ironleaf|Stride Lab|Marrow", "adjustable weights|yoga mat|rowing plan|jump rope|foam roller"),
    "food_delivery": ("Soup Courier|Basil Run|Lunchwise", "dinner box|noodle menu|breakfast plan|salad kit|family feast"), "footwear": ("Cobblegate|Strand & Sole|Fellmark", "hiking boots|trail shoes|canvas sneakers|winter clogs|running shoes"),
    "gaming": ("Pixel Moor|Ninth Level|Gambit Forge", "strategy game|racing wheel|puzzle pack|game pad|card battler"), "home_kitchen": ("Copperpot|Larder & Co|Ember Range", "iron pan|bread knife|storage jars|stand mixer|tea kettle"),
    "pet_supplies": ("Wagtail|Burrow Pets|Otter & Ash", "cat food|dog harness|bird feeder|litter box|fish flakes"), "travel": ("Farlane|Gullwing Tours|Pathfinder Stays", "autumn flights|city breaks|rail passes|island ferries|cabin bags"),
}
_HOOKS = "Made to last for years|Loved by thousands of people|Simple to begin with|Built with care and tested twice|Ready when you are|Fair prices all year".split("|")
_LOOKS = "Fresh Bold Calm Bright Sturdy Quiet Quick Fine Warm Clever".split()
_DEALS = "two for one|free delivery|ten percent off|a month on us|new this week|while stocks last|members first|order today".split("|")


def _h(tag: str, seed: int, key: Column | None = None) -> Column:
    return F.xxhash64(F.lit(f"{seed}:{tag}"), key if key is not None else F.col("i"))


def _pick(options: list[str], tag: str, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(_h(tag, seed), F.lit(len(options))) + 1).cast("int"))


def _of_category(at: int, tag: str, seed: int) -> Column:
    """A maker (0) or goods (1) of the row's own category."""
    of = F.array(*(F.lit(_GOODS[name][at]) for name in sorted(CATEGORIES)))
    options = F.split(F.get(of, F.pmod(_h("category", seed), F.lit(len(CATEGORIES))).cast("int")), r"\|")
    return F.get(options, F.pmod(_h(tag, seed), F.size(options)).cast("int"))


def _unit(tag: str, seed: int) -> Column:
    """In (0, 1)."""
    return (F.pmod(_h(tag, seed), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def base_records(spark: SparkSession, count: int, seed: int, now: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """i and the clean columns; headlines are told apart by the row's number."""
    rows = spark.range(count).withColumnRenamed("id", "i")
    look, deal, category, hook = (_pick(o, t, seed) for o, t in ((_LOOKS, "look"), (_DEALS, "deal"), (sorted(CATEGORIES), "category"), (_HOOKS, "hook")))
    maker, goods = (_of_category(at, t, seed) for at, t in ((0, "maker"), (1, "goods")))
    rows = rows.select("i", *(c.alias(n) for c, n in ((maker, "maker"), (goods, "goods"), (look, "look"), (deal, "deal"), (hook, "hook"), (category, "category"))))
    maker, goods, look, deal, hook = map(F.col, ("maker", "goods", "look", "deal", "hook"))
    tail = F.concat(F.lit(" no. "), F.col("i") + 1)
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), tail)
    forms = [
        join(look, " ", goods, " by ", maker), join(maker, " ", goods, ": ", deal), join(look, " ", maker, " ", goods, ", ", deal),
        join(goods, " from ", maker, ". ", hook), join(hook, ": ", maker, " ", goods), join(deal, " on ", look, " ", goods, " by ", maker),
    ]
    headline = F.get(F.array(*forms), F.pmod(_h("form", seed), F.lit(len(forms))).cast("int"))
    gauss = F.sqrt(-2 * F.log(_unit("g1", seed))) * F.cos(2 * F.pi() * _unit("g2", seed))
    age = (F.pow(_unit("age", seed), 2) * 180 * 86400).cast("long")
    return rows.select(
        "i", F.format_string("ad_%07d", "i").alias("ad_id"), headline.alias("headline"), F.concat(_pick(_HOOKS, "hook2", seed), F.lit(". "), F.initcap(goods), F.lit(" of "), maker, F.lit(". "), F.initcap(deal), F.lit(".")).alias("description"), "category",
        F.format_string("adv_%04d", F.pmod(_h("adv", seed), F.lit(400)) + 1).alias("advertiser_id"), F.round(F.least(F.exp(0.9 + 0.6 * gauss), F.lit(45.0)), 2).alias("bid_cpm_usd"),
        F.date_format(F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(now))) - age), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )


def assigned(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """i, defect (or null), noised: each defect on exactly its share of rows, none twice."""
    order = fixed(rows.select("i", (F.col("i") >= FIRST_REPEAT).alias("late"), _h("order", seed).alias("o")).repartitionByRange(F.desc("late"), "o", "i").sortWithinPartitions(F.desc("late"), "o", "i").withColumn("slot", F.monotonically_increasing_id()))
    parts = sorted(order.groupBy(F.shiftright("slot", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    shifts, total = [], 0
    for part, n in parts:
        shifts.append((part, total - (part << 33)))
        total += n
    known = F.broadcast(rows.sparkSession.createDataFrame(shifts, "part long, shift long"))  # a row for each partition
    at, start, defect = F.col("slot") + F.col("shift"), 0, F
    for code, rate in RATES.items():
        n = count * rate // 1000
        defect = defect.when((at >= start) & (at < start + n), code)
        start += n
    return order.join(known, F.shiftright("slot", 33) == F.col("part")).select("i", defect.alias("defect"), ((at >= start) & (at < start + count * NOISE // 1000)).alias("noised"))


def nearest_before(known: DataFrame, asks: DataFrame, block: int = 4096) -> DataFrame:
    """i, j: for each ask (i, at) the largest known ``at`` that is no more than its own, or null. Both are sorted together
    within blocks of numbers; what a block lacks comes from the last known one of all blocks before, one row a block."""
    events = known.select("at", F.col("at").alias("j"), F.lit(None).cast("long").alias("i")).unionByName(asks.select("at", F.lit(None).cast("long").alias("j"), "i"))
    events = events.withColumn("b", F.floor(F.col("at") / block))
    w = W.partitionBy("b").orderBy("at", F.col("j").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    near = events.withColumn("j", F.last("j", True).over(w)).where("i IS NOT NULL")
    ends = events.groupBy("b").agg(F.max("j").alias("last"))
    ends = ends.select(F.col("b").alias("block"), F.max("last").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("end"))
    return near.join(ends, F.col("b") == F.col("block")).select("i", F.coalesce("j", "end").alias("j"))


def earlier_source(rows: DataFrame, chosen: DataFrame, seed: int) -> DataFrame:
    """i and j: for each repeat the nearest clean row below a random point before it, or the first clean one."""
    clean = chosen.where("defect IS NULL AND NOT noised").select(F.col("i").alias("at"))
    asks = chosen.where(F.col("defect").isin("E010", "E011")).select("i", F.pmod(_h("source", seed), F.col("i")).alias("at"))
    first = clean.agg(F.min("at")).first()[0]
    return nearest_before(clean, asks).select("i", F.coalesce("j", F.lit(first)).alias("j")).where("j < i")


def raw_lines(spark: SparkSession, count: int, seed: int, now: str = "2026-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """(i, line) and (i, defect, noised)."""
    rows = fixed(base_records(spark, count, seed, now))
    chosen = fixed(assigned(rows, count, seed))
    source = earlier_source(rows, chosen, seed)
    old = rows.select(F.col("i").alias("j"), F.col("ad_id").alias("old_id"), F.col("headline").alias("old_headline"), F.col("description").alias("old_description"))
    chosen = fixed(chosen.join(source, "i", "left").withColumn("defect", F.when(F.col("defect").isin("E010", "E011") & F.col("j").isNull(), None).otherwise(F.col("defect"))))
    r = rows.join(chosen, "i").join(old, "j", "left")
    kind = lambda n: F.pmod(_h("kind", seed), F.lit(n))
    is_ = lambda code: F.col("defect") == code
    noise = lambda n: F.col("noised") & (kind(5) == n)
    as_text = lambda value: F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    some = lambda tag, *options: as_text(_pick(list(options), tag, seed))
    past = lambda c, most: F.repeat(F.concat(F.col(c), F.lit(" ")), (F.lit(most) / F.length(c)).cast("int") + 2)
    text = {c: as_text(F.col(c)) for c in CLEAN_COLUMNS if c != "bid_cpm_usd"} | {"bid_cpm_usd": F.col("bid_cpm_usd").cast("string")}
    wrong = {0: ("headline", '["Warm", "socks"]'), 1: ("category", "7"), 2: ("advertiser_id", '{"id": 1}'), 3: ("created_at", "1780000000")}
    lost = dict(enumerate(("headline", "category", "bid_cpm_usd", "advertiser_id", "created_at")))  # each is dropped or null
    bid = F.col("bid_cpm_usd")
    far = {0: -F.round(0.5 + 8.5 * _unit("far", seed), 2), 1: F.lit(0.0), 2: F.round(100 + 800 * _unit("far", seed)), 3: F.round(60 + 4940 * _unit("far", seed), 2)}
    cases = {
        "ad_id": [(is_("E010"), as_text(F.col("old_id")))],
        "headline": [
            (is_("E011"), as_text(F.col("old_headline"))), (is_("E004"), some("empty", "   ", "\t\n ", "<b></b>", "&nbsp;")), (is_("E005"), some("short", "Deal", "Half off", "Sale!", "New in", "Buy")),
            (is_("E006") & (kind(2) == 0), as_text(past("headline", 120))), (noise(0), as_text(F.concat(F.lit("<b>"), F.col("headline"), F.lit("</b>")))), (noise(1), as_text(F.concat(F.lit("  "), F.col("headline"), F.lit(" \n\t ")))),
            (noise(2), as_text(F.regexp_replace("headline", "^([^ ]*) ", "$1\u200b "))),
        ],
        "description": [(is_("E011"), as_text(F.col("old_description"))), (is_("E006") & (kind(2) == 1), as_text(past("description", 1000)))],
        "category": [(is_("E009"), some("bad", "misc", "other", "toys", "n/a", "cars", "garden", "unknown", ""))],
        "created_at": [(is_("E012"), some("when", "yesterday", "03/14/2026", "2026-13-01T00:00:00Z", "March 14 2026", ""))],
        "bid_cpm_usd": [
            (is_("E007"), F.when(kind(6) == 0, F.lit("[1]")).otherwise(some("bid", "call us", "N/A", "unset", "--", "auto"))), *((is_("E008") & (kind(4) == n), x.cast("string")) for n, x in far.items()),
            (noise(3), F.concat(F.lit('"$'), F.format_string("%.2f", bid), F.lit('"'))),
        ],
    }
    for n, (field, value) in wrong.items():
        cases.setdefault(field, []).append((is_("E003") & (kind(4) == n), F.lit(value)))
    for n, field in lost.items():
        cases.setdefault(field, []).append((is_("E002") & (kind(10) == n), F.lit("null")))
    parts = []
    for c in CLEAN_COLUMNS:
        value = F
        for when, then in cases.get(c, []):
            value = value.when(when, then)
        value = value.otherwise(text[c]) if cases.get(c) else text[c]
        gone = noise(4) if c == "description" else F.lit(False)
        for n, field in lost.items():
            gone = gone | (is_("E002") & (kind(10) == n + 5)) if field == c else gone
        parts.append(F.when(~F.coalesce(gone, F.lit(False)), F.concat(F.lit(f'"{c}": '), value)))
    line = F.concat(F.lit("{"), F.concat_ws(", ", F.array_compact(F.array(*parts))), F.lit("}"))
    line = F.when(is_("E001"), F.left(line, 20 + F.pmod(_h("cut", seed), F.lit(41)).cast("int"))).otherwise(line)
    return r.select("i", line.alias("line")), chosen.select("i", "defect", "noised")


def generate(spark: SparkSession, count: int, seed: int, out: str) -> dict:
    """Writes ads_raw.jsonl in row order and expected_defects.json beside it."""
    lines, chosen = raw_lines(spark, count, seed)
    folder = out.rpartition("/")[0] or "."
    make_dirs(spark, folder)
    write_lines(lines, "i", "line", out)
    by_code = {r["defect"]: r["n"] for r in chosen.where("defect IS NOT NULL").groupBy("defect").agg(F.count(F.lit(1)).alias("n")).orderBy("defect").collect()}
    bad = sum(by_code.values())
    told = {"seed": seed, "count": count, "expected_rejections_by_code": by_code, "expected_rejected_total": bad, "expected_accepted_total": count - bad, "noised_records": chosen.where("noised").count()}
    write_json(spark, f"{folder}/expected_defects.json", told)
    return told
