"""Operator 2: BPE encoding and decoding with a contiguous rank array per word.

Reads tokenizer files of the kind "lower-cased words, end-of-word suffix" (BPE model, byte-level
alphabet, normalisers NFC / white space / lower case). The file is only read, never copied.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import small_batches, table

#: Words of more symbols than this are merged with a heap instead of repeated scans.
SCAN_SYMBOLS = 256
#: Entries each worker keeps of words and of white-space-separated chunks.
CACHE_ENTRIES = 700_000
#: Rows in one Arrow batch that goes back to Spark.
BATCH_ROWS = 256
_NONE = 1 << 30
#: Python's split() takes these for white space, the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Filled(dict):
    """A dict that computes what it lacks and starts anew once it is full."""

    def __init__(self, compute, entries: int):
        super().__init__()
        self._compute, self._entries = compute, entries

    def __missing__(self, key):
        if len(self) >= self._entries:
            self.clear()
        value = self[key] = self._compute(key)
        return value


class WordBpe:
    """Encoder and decoder for one tokenizer file; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(split["pattern"]["Regex"])
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._at_special = regex.compile("|".join(map(regex.escape, sorted(self._special, key=len, reverse=True))))
        self.tokens = [""] * (max([*vocab.values(), *self._special.values()]) + 1)
        for token, i in [*vocab.items(), *self._special.items()]:
            self.tokens[i] = token
        letters = _byte_letters()
        self._inner = [vocab[c] for c in letters]
        self._last = [vocab[c + suffix] for c in letters]
        self._ranks: dict[tuple[int, int], int] = {}
        self._merged: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self._ranks[vocab[left], vocab[right]] = rank
            self._merged.append(vocab[left + right])
        self._raw = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self._words = _Filled(self._encode_word, cache_entries)
        self._chunks = _Filled(self._encode_chunk, cache_entries)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: part boundaries and the ranks of adjacent parts side by side."""
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self._inner[b] for b in raw]
        parts[-1] = self._last[raw[-1]]
        if len(parts) > SCAN_SYMBOLS:
            return self._merge_long(parts)
        rank_of, merged = self._ranks.get, self._merged
        ranks = [rank_of(pair, _NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order for very long words, n log n instead of n squared."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := self._ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else -1
            if j < 0 or self._ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = self._merged[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self._ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def _encode_word(self, word: str) -> bytes:
        return b"".join(map(self._raw.__getitem__, self.merge(word)))

    def _encode_chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        # One character at a time where the lower case depends on its neighbours.
        low = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        if low.isalpha():  # one run of letters is one piece
            return self._words[low]
        if low[-1:] in ".," and low[:-1].isalpha():
            return self._words[low[:-1]] + self._words[low[-1]]
        return b"".join(map(self._words.__getitem__, self._pieces.findall(low)))

    def _encode_plain(self, text: str) -> bytes:
        chunks = regex.split(r"[\s--[\x1c-\x1f]]+", text, flags=regex.V1) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self._chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        if "<|" not in text or not self._at_special.search(text):
            return self._encode_plain(text)
        out, end = [], 0
        for m in self._at_special.finditer(text):
            out += [self._encode_plain(text[end : m.start()]), self._special[m.group()].to_bytes(4, "little")]
            end = m.end()
        return b"".join([*out, self._encode_plain(text[end:])])

    def decode(self, ids: bytes) -> str:
        """Token strings joined by blanks: files of this kind name no decoder."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One per worker process and file."""
    return WordBpe(path)


def _by_row(df: DataFrame, column: str, out: str, kind: T.DataType, make) -> DataFrame:
    """df with column replaced by out = make()(value), in Arrow batches of few rows."""
    if out in df.columns and out != column:
        raise ValueError(f"{out} is a column already")
    schema = T.StructType([f for f in df.schema.fields if f.name != column] + [T.StructField(out, kind)])
    arrow = pa.large_binary() if isinstance(kind, T.BinaryType) else pa.large_string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            rest = [i for i, n in enumerate(batch.schema.names) if n != column]
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                values = [one(v) for v in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in rest), pa.array(values, arrow)], [*(batch.schema.names[i] for i in rest), out]
                )

    return small_batches(df).mapInArrow(run, schema)


def bpe_encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Replace text_col by ids_col: its token ids as binary, little-endian unsigned 32-bit integers.

    All other columns stay. Null text counts as empty and gives empty ids; texts of any length
    are encoded whole; special-token strings in a text become their ids, as in the public library.
    ids_col must not name another column; repeated rows are encoded alike; an empty table gives an empty result. Each worker keeps a bounded cache of words.
    """
    path = path or public_path()
    return _by_row(df, text_col, ids_col, T.BinaryType(), lambda: lambda v, t=tokenizer(path): t.encode(v or ""))


def bpe_decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Replace ids_col by text_col: the decoded text. Null or empty ids give the empty text.

    All other columns stay, and text_col must not name one of them; repeated rows are decoded alike; an empty table
    gives an empty result.
    """
    path = path or public_path()
    return _by_row(df, ids_col, text_col, T.StringType(), lambda: lambda v, t=tokenizer(path): t.decode(v or b""))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded again, as digests."""
    ids = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = ids.withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    decoded = bpe_decode(kept)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
