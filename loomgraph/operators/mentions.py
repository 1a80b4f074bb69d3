"""How often each name of a vocabulary stands in each text: one automaton for all names of a shard.

The names of a shard become an Aho-Corasick automaton whose transitions are one numpy array. Texts are cut
into stretches that overlap by the longest name, and all stretches of a batch advance together, one character per step.
A text is read once per shard and never copied per name; only hits leave a task, and none is shuffled.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of a transition table: 32 MB of 32-bit numbers. Names of a shard are dealt so that characters times alphabet stay below.
TABLE = 1 << 23
#: Beyond so many shards texts are read too often: then candidates are found by a join instead.
MOST_SHARDS = 64
_STRETCH, _CHARS = 1024, 1 << 20


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """Per code point whether it is part of a word: letters, marks, digits, letter numbers, connectors."""
    kinds = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc"}
    return np.fromiter((unicodedata.category(chr(c)) in kinds for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Automaton:
    """All names of a list at once. Transitions are complete: a state's row falls back along its failure link."""

    def __init__(self, names: list[str]):
        self.names = names
        letters = sorted({ord(c) for name in names for c in name})
        self.classes = np.zeros(sys.maxunicode + 1, np.int32)  # 0: in no name
        self.classes[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.lengths = np.array([len(n) for n in names], np.int64)
        self.longest = int(self.lengths.max())
        self._build()

    def _build(self) -> None:
        goto: list[dict[str, int]] = [{}]
        level, ends = [0], {}
        for i, name in enumerate(self.names):
            at = 0
            for c in name:
                step = goto[at].get(c)
                if step is None:
                    step = goto[at][c] = len(goto)
                    goto.append({})
                    level.append(level[at] + 1)
                at = step
            ends[at] = i
        n = len(goto)
        parent, letter = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at, steps in enumerate(goto):
            for c, step in steps.items():
                parent[step], letter[step] = at, self.classes[ord(c)]
        depth = np.array(level)
        self.ending = np.full(n, -1, np.int64)
        self.ending[list(ends)] = list(ends.values())
        self.next = np.zeros((n, self.width), np.int32)
        fail, self.also = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        by_depth = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
        for d in range(1, len(edges) - 1):  # level by level: a failure link leads to a level above
            states = by_depth[edges[d] : edges[d + 1]]
            own, above = letter[states], parent[states]
            if d > 1:
                fail[states] = self.next[fail[above], own]
            # the parent's row was made with its own children missing; they replace what the failure row says
            self.next[states] = self.next[fail[states]]
            self.also[states] = np.where(self.ending[fail[states]] >= 0, fail[states], self.also[fail[states]])
            self._link(by_depth[edges[d + 1] :], states, parent, letter, depth, d)
            if d == 1:
                self.next[0, own] = states
                self.next[states] = self.next[0]
                self._link(by_depth[edges[d + 1] :], states, parent, letter, depth, d)
        self.reports = (self.ending >= 0) | (self.also >= 0)

    def _link(self, below: np.ndarray, states: np.ndarray, parent: np.ndarray, letter: np.ndarray, depth: np.ndarray, d: int) -> None:
        kids = below[: np.searchsorted(depth[below], d + 2)]
        self.next[parent[kids], letter[kids]] = kids

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, name, end) of every occurrence between word borders, ends in the texts joined by line feeds."""
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        ends = begins[1:] - 1
        steps, stretch = self.classes[codes], max(_STRETCH, 4 * self.longest)
        pieces = -(-np.maximum(ends - begins[:-1], 1) // stretch)
        owner = np.repeat(np.arange(len(texts)), pieces)
        first = begins[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stretch
        last = np.minimum(first + stretch, ends[owner])
        start = np.maximum(first - self.longest + 1, begins[owner])
        order = np.argsort(start - last, kind="stable")  # longest first, so that those still running are a prefix
        start, size = start[order], (last - start)[order]
        running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        state, flat, found = np.zeros(len(start), np.int32), self.next.ravel(), []
        for t, a in enumerate(running.tolist()):
            state = flat[state[:a] * np.int64(self.width) + steps[start[:a] + t]]
            hit = np.flatnonzero(self.reports[state])
            if len(hit):
                found.append((hit, np.full(len(hit), t), state[hit]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        lane, step, at = (np.concatenate(c) for c in zip(*found))
        end = start[lane] + step + 1
        fresh = end > first[order][lane]  # the overlap belongs to the stretch before
        lane, end, at = lane[fresh], end[fresh], at[fresh].astype(np.int64)
        out = []
        while len(at):
            here = self.ending[at] >= 0
            out.append((owner[order][lane[here]], self.ending[at[here]], end[here]))
            at = self.also[at]
            on = at >= 0
            lane, end, at = lane[on], end[on], at[on]
        text, name, end = (np.concatenate(c) for c in zip(*out))
        word = np.concatenate([[False], _word_characters()[codes], [False]])
        begin = end - self.lengths[name]
        whole = (word[begin] != word[begin + 1]) & (word[end] != word[end + 1])
        return text[whole], name[whole], end[whole]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, name, n): occurrences that do not overlap others of their own name, from the left."""
        text, name, end = self.hits(texts)
        order = np.lexsort((end, name, text))
        text, name, end = text[order], name[order], end[order]
        same = np.zeros(len(text), bool)
        same[1:] = (text[1:] == text[:-1]) & (name[1:] == name[:-1])
        close = np.zeros(len(text), bool)
        close[1:] = same[1:] & (end[1:] - end[:-1] < self.lengths[name[1:]])
        group = np.cumsum(~same) - 1
        kept = np.ones(len(text), bool)
        for g in np.unique(group[close]).tolist():  # names that overlap themselves
            free = -1
            for i in range(*np.searchsorted(group, [g, g + 1]).tolist()):
                kept[i] = end[i] - self.lengths[name[i]] >= free
                free = end[i] if kept[i] else free
        firsts = np.flatnonzero(~same)
        return text[firsts], name[firsts], np.add.reduceat(kept.astype(np.int64), firsts) if len(firsts) else firsts


_compiled: dict[int, tuple[Automaton, list[list[str]]]] = {}


def _automaton(shared) -> tuple[Automaton, list[list[str]]]:
    """A worker's automaton of a broadcast shard, and the spellings behind each lowered name; one is held at a time."""
    if shared.value and id(shared.value) not in _compiled:
        spellings: dict[str, list[str]] = {}
        for name, low in shared.value:
            spellings.setdefault(low, []).append(name)
        _compiled.clear()
        _compiled[id(shared.value)] = Automaton(list(spellings)), list(spellings.values())
    return _compiled[id(shared.value)]


def _shard_counts(files: DataFrame, shard: list[tuple[str, str]], key: str, content: str) -> DataFrame:
    """(key, name, n) of the names of one shard."""
    shared = files.sparkSession.sparkContext.broadcast(shard)
    kind = files.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, spellings = _automaton(shared)

        def counted(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            text, name, n = automaton.counts(texts)
            many = np.array([len(s) for s in spellings])[name]
            names = [s for i in name.tolist() for s in spellings[i]]
            rows = np.repeat(np.arange(len(text)), many)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(text[rows])), pa.array(names, pa.string()), pa.array(n[rows])], schema.names)

        for batch in batches:
            texts, low, size = batch.column(1).to_pylist(), 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= _CHARS or i == len(texts) - 1:
                    yield counted(batch.column(0).slice(low, i + 1 - low), texts[low : i + 1])
                    low, size = i + 1, 0

    conf = files.sparkSession.conf  # a worker holds a batch of texts; 10,000 rows of them are too many for a small executor
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    texts = files.select(key, F.lower(F.coalesce(F.col(content), F.lit(""))).alias("_text"))
    return texts.mapInArrow(run, schema)


def shards_needed(names: DataFrame) -> int:
    """Shards for a vocabulary (low): characters times alphabet over the size of a table."""
    letters = names.select(F.explode(F.array_distinct(F.split("low", ""))).alias("c")).agg(F.count_distinct("c")).first()[0]
    chars = names.agg(F.coalesce(F.sum(F.length("low")), F.lit(0))).first()[0]
    return -(-(chars + 1) * (letters + 1) // TABLE) if chars else 0


def scanned_mentions(files: DataFrame, names: DataFrame, key: str, content: str, shards: int) -> DataFrame:
    """Mentions by automata: one scan of the files per shard of names (name, low)."""
    dealt = names.select("name", "low", F.pmod(F.xxhash64("low"), F.lit(shards)).alias("shard"))
    out = None
    for i in range(shards):  # a shard's names are bounded by TABLE
        shard = [tuple(r) for r in dealt.filter(F.col("shard") == i).select("name", "low").collect()]
        if shard:
            found = _shard_counts(files, shard, key, content)
            out = found if out is None else out.unionAll(found)
    return out


_APART, _WORDS = r"(?U)\W+", r"(?U)\w+"


def joined_mentions(files: DataFrame, names: DataFrame, key: str, content: str) -> DataFrame:
    """Mentions for a vocabulary (name, low) of any size: names are candidates of the files that have their longest word.

    Every run of word characters in a name must be a run of the file. The candidates of a file meet its text in
    one row, where each is counted; a name without word characters is a candidate by its first and last sign's run.
    """
    runs = F.filter(F.split("low", _APART), lambda w: w != "")
    longest = F.array_max(F.transform(runs, lambda w: F.struct(F.length(w).alias("size"), w.alias("run"))))["run"]
    wanted = names.select("name", "low", F.coalesce(F.concat(F.lit("w"), longest), F.concat(F.lit("s"), F.col("low"))).alias("token"))
    low = F.lower(F.coalesce(F.col(content), F.lit("")))
    split = lambda pattern, mark: F.transform(F.split(low, pattern), lambda w: F.concat(F.lit(mark), w))
    tokens = files.select(key, F.explode(F.array_distinct(F.concat(split(_APART, "w"), split(_WORDS, "s")))).alias("token"))
    likely = tokens.join(wanted, "token").groupBy(key).agg(F.collect_list(F.struct("name", "low")).alias("_names"))
    both = likely.join(files.select(key, low.alias("_text")), key)
    literal = lambda s: F.concat(F.lit(r"(?U)\b\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))
    counted = F.transform("_names", lambda x: F.struct(x["name"].alias("name"), F.regexp_count(F.col("_text"), literal(x["low"])).cast("long").alias("n")))
    return both.select(key, F.inline(F.filter(counted, lambda x: x["n"] > 0)))
