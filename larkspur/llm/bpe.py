"""BPE encoding and decoding with a pair occurrence index.

The words of a slice of a partition that have no encoding yet are laid out in one array of symbols. An index maps each
adjacent pair to all its positions in that array. The active pair of lowest rank is merged at all its positions, left
to right; the pairs that a merge makes or breaks at its neighbours update their lists. When no active pair is left,
each word's symbols are its ids. Encodings of words are kept for later slices, up to ``WORDS_KEPT`` words.

Vocabularies are files in the tokenizers JSON format of the "word BPE" kind: NFC, lower case, words split by the
file's own pattern, bytes as letters, a suffix at a word's end. Special tokens in a text are themselves.

Cases: a null or empty text, or one of white space only, has no ids and decodes to the empty text. Ids out of the
vocabulary raise an error in decoding; a null list of ids decodes as an empty one. Columns that the caller has beside
the text are kept as they are; the caller names the new ones. Texts of any length are encoded whole: the index grows
with the longest word, the rest is bounded by ``SLICE`` bytes or one text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

SLICE = 1_000_000
WORDS_KEPT = 150_000
#: Bytes of the largest vocabulary file that is broadcast.
LARGEST = 64 << 20
_FIRST, _SECOND = itemgetter(0), itemgetter(1)
_loaded: dict[str, "WordBPE"] = {}
#: Bits of an id in a pair; the largest number stands between words.
_ID = 24
_END = (1 << _ID) - 1
#: Finds all that ``LATE`` and ``LATE_LOWER`` hold, at less cost.
_UNCOMMON = re.compile("[^\x00-\u0557\u2010-\u2060]")
#: Letters and digits of Unicode 17, which are symbols to the tables that vocabularies are made with (16).
LATE = re.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: Lower-case forms that came with Unicode 16 and 17.
LATE_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATE_LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class WordBPE:
    """A vocabulary, its ranks and the encodings found so far."""

    def __init__(self, source: str | bytes):
        """source: a file's path, or what it holds."""
        if isinstance(source, str):
            with open(source, "rb") as f:
                source = f.read()
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        # The same pattern for lower-case ASCII, where the classes are short.
        self.ascii_words = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r a-z0-9]"))
        #: A pair, as one number, to its rank and the id that it makes.
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(self.vocab[a] << _ID | self.vocab[b], (rank, self.vocab[a + b]))
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + self.suffix] for x in letters]
        made = defaultdict(int)
        for rank, z in self.ranks.values():
            made[z] = max(made[z], rank)
        #: Whether each merge ranks after all that make its parts; then ascending ranks never go back.
        self.ascending = all(rank > max(made.get(a, -1), made.get(b, -1)) for a, b, rank in ((k >> _ID, k & _END, v[0]) for k, v in self.ranks.items()))
        #: A word to its ids as bytes, and to what they decode to.
        self.known: dict[str, tuple[bytes, str]] = self._specials()
        self.older: dict[str, tuple[bytes, str]] = {}

    def _specials(self) -> dict[str, tuple[bytes, str]]:
        return {t: self._found([i]) for t, i in self.special.items()}

    def _found(self, ids: list[int]) -> tuple[bytes, str]:
        return array("i", ids).tobytes(), self.decode(ids)

    def split(self, text: str) -> list[str]:
        """Words of a text after normalisation; special tokens stay whole."""
        if self.split_special and any(t in text for t in self.special):
            return list(chain.from_iterable([part] if part in self.special else self._split(part) for part in self.split_special.split(text)))
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        # A capital sigma has one lower-case form here, whatever its place in a word.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if _UNCOMMON.search(text):
            text = text.translate(LATE_LOWER).lower()
            if LATE.search(text):  # what is found there is found as a symbol
                return [text[m.start() : m.end()] for m in self.words.finditer(LATE.sub("\u2021", text))]
            return self.words.findall(text)
        text = text.lower()
        return self.words.findall(text)

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't known yet."""
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = self._specials(), self.known
        new = []
        for w in words.difference(self.known):
            if (ids := self.older.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = ids
        if self.ascending:
            self._index(new)
        else:
            for w in new:  # a merge may rank before one that makes its parts: one word at a time, one merge at a time
                self.known[w] = self._found(self._stepwise(w))

    def _symbols(self, word: str) -> list[int]:
        b = word.encode()
        return [*(self.inner[x] for x in b[:-1]), self.final[b[-1]]]

    def _stepwise(self, word: str) -> list[int]:
        s, ranks = self._symbols(word), self.ranks
        while len(s) > 1:
            best = min(((ranks[p][0], i) for i, p in enumerate(a << _ID | b for a, b in zip(s, s[1:], strict=False)) if p in ranks), default=None)
            if best is None:
                break
            i = best[1]
            s[i : i + 2] = [ranks[s[i] << _ID | s[i + 1]][1]]
        return s

    def _index(self, words: list[str]) -> None:
        ranks, inner, final = self.ranks, self.inner, self.final
        sym: list[int] = []
        starts = []
        for w in words:
            b = w.encode()
            starts.append(len(sym))
            sym += [inner[x] for x in b]
            sym[-1] = final[b[-1]]
            sym.append(_END)  # no pair crosses a word's end
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = defaultdict(list)
        for i, pair in enumerate([a << _ID | b for a, b in zip(sym, sym[1:], strict=False)]):
            if pair in ranks:
                places[pair].append(i)
        active = [(*ranks[p], p) for p in places]
        heapq.heapify(active)
        while active:
            rank, z, pair = heapq.heappop(active)
            where = places.pop(pair)
            a, b = pair >> _ID, pair & _END
            where.sort()
            left = z << _ID
            for i in where:
                if sym[i] != a or sym[j := after[i]] != b:
                    continue  # an earlier merge took one of the two
                after[i] = k = after[j]
                before[k] = i
                sym[i], sym[j] = z, -1
                if (p := left | sym[k]) in ranks:
                    if p not in places:
                        heapq.heappush(active, (*ranks[p], p))
                    places[p].append(i)
                if (h := before[i]) >= 0 and (p := sym[h] << _ID | z) in ranks:
                    if p not in places:
                        heapq.heappush(active, (*ranks[p], p))
                    places[p].append(h)
        for w, i in zip(words, starts, strict=True):
            out = []
            while (x := sym[i]) != _END:
                out.append(x)
                i = after[i]
            self.known[w] = self._found(out)

    def encode_all(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """For each text its ids, as bytes of 32-bit numbers, and what they decode to."""
        split = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get, ids, back = self.known.__getitem__, [], []
        for words in split:
            found = list(map(get, words))
            ids.append(b"".join(map(_FIRST, found)))
            back.append(" ".join(map(_SECOND, found)))
        return ids, back

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [array("i", x).tolist() for x in self.encode_all(texts)[0]]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


@functools.cache
def load(path: str) -> WordBPE:
    """One vocabulary for each process and path."""
    return WordBPE(path)


class Shared:
    """A vocabulary on its way to the workers: the driver's file, of at most ``LARGEST`` bytes, as a broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            held = f.read(LARGEST + 1)
        if len(held) > LARGEST:
            raise ValueError(f"{path} has more than {LARGEST} bytes")
        self.name, self.held = hashlib.sha256(held).hexdigest(), spark.sparkContext.broadcast(held)

    def get(self) -> WordBPE:
        """One vocabulary for each worker process and content, with the words that it knows so far."""
        if self.name not in _loaded:
            _loaded[self.name] = WordBPE(self.held.value)
        return _loaded[self.name]


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``SLICE`` bytes of text in all, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    s = total = 0
    for e, size in enumerate(sizes):
        if e > s and total + size > SLICE:
            yield batch.slice(s, e - s)
            s, total = e, 0
        total += size
    if s < len(sizes):
        yield batch.slice(s)


def _encode(shared: Shared, at: int, decoded: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = shared.get()
    for batch in batches:
        for part in _slices(batch, at):
            ids, back = bpe.encode_all(part.column(at).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            new = {"ids": lists} | ({"decoded": pa.array(back, pa.string())} if decoded else {})
            rest = [i for i in range(part.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *new.values()], [*(part.schema.names[i] for i in rest), *new])


def _decode(shared: Shared, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = shared.get()
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            texts = pa.array([bpe.decode(x or ()) for x in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", decoded: bool = False) -> DataFrame:
    """The columns in ``keep``, and ids: the text's token ids; with ``decoded``, also the text that they decode to."""
    chosen = docs.select(*keep, text)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(functools.partial(_encode, Shared(docs.sparkSession, path), len(keep), decoded), f"{types}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The table and decoded: the text of its column ids."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(functools.partial(_decode, Shared(encoded.sparkSession, path), encoded.columns.index("ids")), f"{types}, decoded string")
