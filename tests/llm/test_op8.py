import random
import re
from re import _parser

import pytest

from larkspur.llm.license_rules import CONFIDENCE, RULES
from larkspur.llm.licenses import BASE, scan
from larkspur.llm.queries import op8

from .helpers import DOCUMENTS, SF, documents, rows_of, sql_rows, with_clashes, write

COLS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def found(text):
    """Words, base places and kept detections by a plain loop over words."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    body = f" {' '.join(words)} "
    spans = []
    for n, (label, priority, _, rule) in enumerate(RULES):
        for m in re.finditer(f"(?<= )(?:{rule})(?= )", body):
            start = body[: m.start()].count(" ") - 1
            spans.append((priority, -len(m[0].split()), start, n, label))
    return words, base, resolved(spans)


def resolved(spans):
    """By the definition: from the best priority and the longest on, a span stays unless a kept one of a better priority
    has a word in common with it, or one of its own priority has all its words."""
    kept = []
    for p, minus, start, n, label in sorted(spans):
        mine = range(start, start - minus)
        if not any(q < p and set(mine) & set(other) or q == p and set(mine) <= set(other) for q, other, *_ in kept):
            kept.append((p, mine, n, label))
    return kept


def brute(rows):
    out = []
    for i, text in rows:
        words, base, kept = found(text)
        starts = [p for p, _ in base]
        own = {label for _, label in base}
        score = max([CONFIDENCE[s[0]] for s in kept] + [0.75] * bool(base), default=0.0)
        out.append((i, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[3] for s in kept})), score))
    return sorted(out, key=repr)


def test_agrees_with_a_loop_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(op8.run(spark, SF), COLS) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


TEXTS = [
    None, "", " .,;", "MIT License", "the mit license, mit-license MIT.License", "cc by cc by cc by-sa 4.0", "a CC BY-NC-SA 4.0 cc", "cc\nby", "CC BYE", "xcc by",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use", "GNU General Public License", "GNU General Public License version 3 or later", "gnu  GENERAL public license gnu general public license v2",
    "Copyright (c) 2020-2021 Some One. All rights reserved.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-2.0-only\n", "no licences here, ÄÖ mit lizenz", "İstanbul cc by K", "mit license" * 3, "Licensed under Apache License Version 2.0", "x" * 100_000 + " apache license", "apache license " * 3000,
    "released into the public domain under the unlicense or the do what the fuck you want to public license", "agpl v3 lgpl 2.1 mpl 2.0 epl-2.0 bsd-3-clause isc license zlib license",
]


@pytest.mark.parametrize("clash", [False, True])
def test_odd_texts(spark, tmp_path, clash):
    rows = list(enumerate(TEXTS)) + [(None, "mit license"), (3, "MIT License"), (3, "MIT License")]
    table = documents(rows)
    folder = write(tmp_path, documents=with_clashes(*table) if clash else table)
    assert rows_of(op8.run(spark, folder), COLS) == brute(rows)


def test_empty(spark, tmp_path):
    assert op8.run(spark, write(tmp_path, documents=(DOCUMENTS, []))).collect() == []


def test_detections_give_spans_and_suppress(spark):
    df = spark.createDataFrame([(1, "This is under the GNU General Public License version 2, June 1991, and the MIT License.")], "doc_id long, text string")
    d = scan(df).first()["detections"]
    assert [(x["start"], x["end"], x["label"], x["priority"]) for x in d] == [(4, 11, "gpl-2.0", 1), (13, 15, "mit", 3)]


def expanded(items):
    """Each text that a parsed regex matches, optional parts both there and not, and only the ends of a range."""
    out = [""]
    for op, value in items:
        match str(op):
            case "LITERAL":
                more = [chr(value)]
            case "IN":
                more = [chr(c) for kind, v in value for c in ([v] if str(kind) == "LITERAL" else v if str(kind) == "RANGE" else [63])]
            case "ANY":
                more = ["?"]
            case "SUBPATTERN":
                more = expanded(value[-1])
            case "BRANCH":
                more = [t for branch in value[1] for t in expanded(branch)]
            case "MAX_REPEAT" | "MIN_REPEAT":
                more = [t * max(value[0], 1) for t in expanded(value[2])] + [""] * (value[0] == 0)
            case _:
                raise ValueError(op)
        out = [a + b for a in out for b in more]
    return out


def test_every_text_of_a_rule_holds_a_keyword():
    lost = [(keywords, text) for _, _, keywords, rule in RULES for text in expanded(_parser.parse(rule)) if not set(keywords) & set(text.split())]
    assert not lost


def samples(rule):
    """Texts that a rule matches, with something for each part that may be anything."""
    return [re.sub(r"\?", "1", t) for t in expanded(_parser.parse(rule))]


def test_every_rule_is_kept_for_a_text_of_its_own(spark):
    assert len(RULES) > 250
    texts = [(n, t) for n, (*_, rule) in enumerate(RULES) for t in samples(rule)]
    kept = {n for n, t in texts if any(k[2] == n for k in found(t)[2])}
    assert not [RULES[n] for n in set(range(len(RULES))) - kept]
    df = spark.createDataFrame(list(enumerate(t for _, t in texts)), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: [(d["start"], d["end"], d["label"]) for d in r["detections"]] for r in scan(df).collect()}
    for i, (_, t) in enumerate(texts):
        assert rows[i] == sorted((k[1].start, k[1].stop - 1, k[3]) for k in found(t)[2]), t


def test_priority_decides_and_then_containment(spark):
    rules = (("a", 1, ("x",), "x y"), ("b", 2, ("y",), "y z"), ("c", 4, ("w",), "w x y z"), ("d", 2, ("z",), "z q r"), ("e", 2, ("q",), "q r"), ("f", 3, ("s",), "s t"), ("g", 3, ("t",), "t u"), ("h", 3, ("s",), "s t"))
    df = spark.createDataFrame([(1, "w x y z q r s t u s")], "doc_id long, text string")
    got = [(d["label"], d["start"], d["end"]) for d in scan(df, rules=rules).first()["detections"]]
    assert got == [("a", 1, 2), ("d", 3, 5), ("f", 6, 7), ("g", 7, 8)]


def test_random_overlaps_agree_with_the_definition(spark):
    rng = random.Random(5)
    phrases = {" ".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(40)}
    rules = tuple((f"l{i}", rng.randint(1, 4), (p.split()[0],), p) for i, p in enumerate(sorted(phrases)))
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(d["start"], d["end"], d["label"]) for d in r["detections"]] for r in scan(df, rules=rules).collect()}
    for i, text in enumerate(texts):
        spans = []
        for n, (label, p, _, phrase) in enumerate(rules):
            for m in re.finditer(f"(?<= )(?:{phrase})(?= )", f" {text} "):
                spans.append((p, -len(phrase.split()), f" {text} "[: m.start()].count(" ") - 1, n, label))
        assert got[i] == sorted((k[1].start, k[1].stop - 1, k[3]) for k in resolved(spans)), text


@pytest.mark.parametrize("text", ["SPDX-License-Identifier: GPL" + " 1" * 1_000_000, "cc by " * 200_000, "copyright 2020 " * 200_000, "the name of the " * 200_000, "licensed under the apache license version 2.0 " * 50_000])
def test_long_runs_of_a_rules_words(spark, text):
    r = op8.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["n_words"] == len(re.findall("[A-Za-z0-9]+", text))


def test_agrees_with_sql(spark, tmp_path):
    rows = [r for r in enumerate(t for t in TEXTS if len(t or "") < 1000)] + [(None, "mit license"), (3, "MIT License"), (3, "MIT License")]
    folder = write(tmp_path, documents=documents(rows))
    assert rows_of(op8.run(spark, folder)) == sql_rows(folder, op8.SQL, "documents")
    assert rows_of(op8.run(spark, SF)) == sql_rows(SF, op8.SQL, "documents")


def test_spellings_that_gates_once_dropped(spark):
    texts = {"same terms as Perl 5 itself": "perl", "the same terms as Perl programming language system itself": "perl", "X.Net license": "xnet", "Llama 2 Community Licence": "llama-community", "End User Licence Agreement": "eula", "dual-licenced": "dual-license"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [d["label"] for d in r["detections"]] for r in scan(df).collect()}
    assert all(label in got[i] for i, label in enumerate(texts.values())), got


def test_main_path_has_no_python(spark):
    plan = op8.run(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)
