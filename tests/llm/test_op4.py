import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import bpe
from larkspur.llm.queries import op4

from .helpers import DOCUMENTS, SF, documents, rows_of, with_clashes, write

PATH = public_tokenizers.path("word_bpe_49k.json")
COLS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def brute(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


def test_whole_table(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op4.run(spark, SF), COLS) == brute(library, rows)


PIECES = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "IT'S", "we'll", "'", "’s", "1234", "½", "Σίσυφος ΣΑΣ", "é", "é", "ＡＢ", "İ", "ß", "ﬁ", "😀", "👨‍👩‍👧", "中文", "한국", "​", " ", " ", "\x00", "\x1f", "\n\t", "a" * 300, "#@!", "<w>", "</w>", "ǆ", "﻿", "ͅ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=8)), max_size=10), st.sampled_from(["", " "]))
def test_any_text(pieces, glue):
    text = glue.join(pieces)
    library, ours = _pair()
    ids = ours.encode([text])[0]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


_made = []


def _pair():
    if not _made:
        t = Tokenizer.from_file(PATH)
        t.no_truncation()
        t.no_padding()
        _made.extend((t, bpe.load(PATH)))
    return _made


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, tmp_path, library, clash):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "no id"), (4, "same"), (4, "same"), (5, "x" * 20_000), (6, "word " * 100_000), (7, "<|endoftext|>a<|startoftext|>"), (8, "".join(PIECES))]
    table = documents(rows)
    folder = write(tmp_path, documents=with_clashes(*table) if clash else table)
    assert rows_of(op4.run(spark, folder), COLS) == brute(library, rows)


def test_encoded_tables_decode(spark, library):
    df = spark.createDataFrame([(1, "Hello there", "k"), (2, None, None)], "doc_id long, text string, decoded_as string")
    coded = bpe.encode(df, PATH, keep=("doc_id", "decoded_as"))
    back = bpe.decode(coded, PATH)
    assert back.columns == ["doc_id", "decoded_as", "ids", "decoded"]
    assert rows_of(back, ["doc_id", "decoded"]) == [(1, library.decode(library.encode("Hello there", add_special_tokens=False).ids)), (2, "")]
    bad = spark.createDataFrame([([10**6],)], "ids array<int>")
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(bad, PATH).collect()


def test_empty(spark, tmp_path):
    assert op4.run(spark, write(tmp_path, documents=(DOCUMENTS, []))).collect() == []


def test_a_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 20)
    ours, rng = bpe.WordBPE(PATH), random.Random(3)
    for _ in range(30):
        texts = [" ".join(rng.choices(["alpha", "beta", "gamma's", "delta99", "zulu", "über", "qqq" * rng.randint(1, 9), str(rng.random())], k=8)) for _ in range(5)]
        assert ours.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_random_merges_in_any_order(tmp_path, seed):
    """Vocabularies whose merges don't ascend are encoded step by step; all agree with the library."""
    rng = random.Random(seed)
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    letters = bpe.byte_letters()
    tokens = [*letters, *(x + "</w>" for x in letters)]
    parts, merges = ["a", "b", "c", "a</w>", "b</w>", "c</w>"], []
    for _ in range(40):
        x, y = rng.choice([p for p in parts if not p.endswith("</w>")]), rng.choice(parts)
        if x + y not in tokens:
            tokens.append(x + y)
            parts.append(x + y)
        if [x, y] not in merges:
            merges.append([x, y])
    if seed:
        rng.shuffle(merges)
    spec["model"]["vocab"] = {t: i for i, t in enumerate(tokens)}
    spec["model"]["merges"] = merges
    for t in spec["added_tokens"]:
        t["id"] = len(spec["model"]["vocab"])
        spec["model"]["vocab"][t["content"]] = t["id"]
    if "unk_token" in spec["model"]:
        spec["model"]["unk_token"] = spec["added_tokens"][-1]["content"]
    spec["post_processor"] = None
    path = str(tmp_path / "v.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    library, ours = Tokenizer.from_file(path), bpe.WordBPE(path)
    for _ in range(300):
        text = "".join(rng.choices("abc ", weights=[4, 4, 4, 1], k=rng.randint(1, 25)))
        assert ours.encode([text])[0] == library.encode(text, add_special_tokens=False).ids
