"""Operator 9: document scores by masked pseudo-likelihood of a bidirectional window network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import small_batches, table, written
from loomgraph.llm.shingles import mix, sized_words, text_parts, word_hashes
from loomgraph.sources.tables import discarded

#: Word types: CLASSES classes of CLASSES types, the most frequent words first. The last BUCKETS types stand for all rarer
#: words, by hash; a rarer word's probability is its bucket's times its share of the bucket's words.
CLASSES, BUCKETS = 181, 256
TYPES = CLASSES * CLASSES
#: Words the network sees on either side of the hidden one, and its width.
WINDOW, HIDDEN = 2, 32
#: One position in SHARE, by document id and position, is trained on in each of ROUNDS passes.
SHARE, ROUNDS = 32, 2
#: Positions of one training shard: as many networks are trained, from a common start, and averaged as the corpus has shards.
SHARD = 1 << 18
#: Nats that each byte of an unseen word costs, and its end: one of 26 letters or the end.
SPELLED = float(np.log(27))
_BATCH = 2048
_RARE = np.dtype([("word", "<i8"), ("alone", "<f4")])
#: Rows whose class distributions are held at once.
_ROWS = 2048
_POSITIONS = 1 << 15
#: Parts of the parameter vector that are averaged apart from each other.
_PARTS = 32
#: Shards whose changes are averaged in one group.
FAN = 64


class WindowNetwork:
    """p(word | words around it) = p(class | h) p(word | class, h) with h = tanh(b + sum of S_j * E[neighbour j])."""

    shapes = {
        "E": (TYPES + 1, HIDDEN),
        "S": (2 * WINDOW, HIDDEN),
        "b": (HIDDEN,),
        "Wc": (HIDDEN, CLASSES),
        "bc": (CLASSES,),
        "Wi": (CLASSES, HIDDEN, CLASSES),
        "bi": (CLASSES, CLASSES),
    }
    pad = TYPES

    def __init__(self, vector: np.ndarray):
        self.vector, at = vector, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            setattr(self, name, vector[at : at + size].reshape(shape))
            at += size

    @classmethod
    def started(cls, counts: np.ndarray, seed: int = 5) -> "WindowNetwork":
        """Small random weights and the word frequencies as biases."""
        size = sum(int(np.prod(s)) for s in cls.shapes.values())
        net = cls(np.random.default_rng(seed).normal(0, 0.05, size).astype(np.float32))
        p = (counts + 0.5) / (counts + 0.5).sum()
        grid = p.reshape(CLASSES, CLASSES)
        net.b[:], net.S[:] = 0, 1
        net.bc[:] = np.log(grid.sum(axis=1))
        net.bi[:] = np.log(grid / grid.sum(axis=1, keepdims=True))
        return net

    def _hidden(self, near: np.ndarray) -> np.ndarray:
        h = np.repeat(self.b[None, :], len(near), axis=0)
        for j in range(2 * WINDOW):
            h += self.S[j] * self.E[near[:, j]]
        return np.tanh(h, out=h)

    @staticmethod
    def _softmax(z: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of each row's choice, the whole distributions); z is overwritten."""
        z -= z.max(axis=1, keepdims=True)
        picked = z[np.arange(len(z)), chosen]
        np.exp(z, out=z)
        total = z.sum(axis=1)
        z /= total[:, None]
        return picked - np.log(total), z

    @staticmethod
    def _by_class(cls: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
            yield c, order[bounds[c] : bounds[c + 1]]

    def log_probabilities(self, words: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of each word given its 2 * WINDOW neighbours."""
        h, cls, inner = self._hidden(near), words // CLASSES, words % CLASSES
        h = np.column_stack((h, np.ones(len(h), h.dtype)))  # the biases are a row of the weights
        top = np.vstack((self.Wc, self.bc))
        out = np.concatenate([self._log_choice(h[at : at + _ROWS], top, cls[at : at + _ROWS]) for at in range(0, len(h), _ROWS)] or [np.zeros(0)])
        for c, own in self._by_class(cls):
            out[own] += self._log_choice(h[own], np.vstack((self.Wi[c], self.bi[c])), inner[own])
        return out

    @staticmethod
    def _log_choice(h: np.ndarray, weights: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        z = h @ weights
        if np.abs(weights).sum(axis=0).max() > 80:  # else no exponential overflows, as h is within 1
            z -= z.max(axis=1, keepdims=True)
        picked = z[np.arange(len(z)), chosen]
        return picked - np.log(np.exp(z, out=z).sum(axis=1))

    def _slopes(self, words: np.ndarray, near: np.ndarray) -> Iterator[tuple[str, object, np.ndarray]]:
        """(block, index in it, gradient there) of the mean negative log-probability; only what the words touch."""
        h, cls, inner, n = self._hidden(near), words // CLASSES, words % CLASSES, len(words)
        d = self._softmax(h @ self.Wc + self.bc, cls)[1]
        d[np.arange(n), cls] -= 1
        yield "Wc", ..., h.T @ d / n
        yield "bc", ..., d.sum(axis=0) / n
        back = d @ self.Wc.T
        for c, own in self._by_class(cls):
            d = self._softmax(h[own] @ self.Wi[c] + self.bi[c], inner[own])[1]
            d[np.arange(len(own)), inner[own]] -= 1
            back[own] += d @ self.Wi[c].T
            yield "Wi", c, h[own].T @ d / n
            yield "bi", c, d.sum(axis=0) / n
        back *= (1 - h * h) / n
        yield "b", ..., back.sum(axis=0)
        beside = self.E[near]
        yield "S", ..., (beside * back[:, None, :]).sum(axis=0)
        each = (self.S[None, :, :] * back[:, None, :]).reshape(-1, HIDDEN)
        order = np.argsort(near.ravel(), kind="stable")
        rows, first = np.unique(near.ravel()[order], return_index=True)
        yield "E", rows, np.add.reduceat(each[order], first, axis=0)

    def gradient(self, words: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability."""
        g = WindowNetwork(np.zeros_like(self.vector))
        for name, index, slope in self._slopes(words, near):
            getattr(g, name)[index] += slope
        return g.vector

    def train(self, words: np.ndarray, near: np.ndarray, rate: float = 0.1) -> None:
        """One pass of adaptive gradient steps; memory holds the squared gradients so far."""
        memory = WindowNetwork(np.zeros_like(self.vector))
        for at in range(0, len(words), _BATCH):
            for name, index, slope in list(self._slopes(words[at : at + _BATCH], near[at : at + _BATCH])):
                past = getattr(memory, name)
                past[index] += slope * slope
                getattr(self, name)[index] -= rate * slope / (np.sqrt(past[index]) + 1e-4)


def windows(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each word, row of each word); pads stand beyond either end of a row."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(ids)) + row * WINDOW + WINDOW
    padded = np.full(len(ids) + (len(n) + 1) * WINDOW, WindowNetwork.pad, np.int64)
    padded[at] = ids
    return np.stack([padded[at + j] for j in range(-WINDOW, WINDOW + 1) if j], axis=1), row


def _word_counts(docs: DataFrame) -> DataFrame:
    """How often each word stands in all documents, counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_parts(batch.column("text")):
                words, counts = np.unique(word_hashes(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _buckets(words: np.ndarray) -> np.ndarray:
    """The type that stands for each rarer word."""
    return (TYPES - BUCKETS + (mix(words) % np.uint64(BUCKETS))).astype(np.uint16)


def _bucket_sizes(counts: DataFrame, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences, different words) of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            word = batch.column("word").to_numpy().view(np.uint64)
            rare = ~np.isin(word, frequent)
            bucket = _buckets(word[rare]) - (TYPES - BUCKETS)
            np.add.at(n, bucket, batch.column("n").to_numpy()[rare])
            words += np.bincount(bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(n), pa.array(words)], ["bucket", "n", "words"])

    sums = counts.mapInArrow(run, "bucket int, n long, words long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    n, words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # one row per bucket
        n[r["bucket"]], words[r["bucket"]] = r["n"], r["words"]
    return n, words


def _encoded(docs: DataFrame, frequent: np.ndarray, different: np.ndarray) -> DataFrame:
    """(key, mark, row, words, rare, alone) of each document: its word types as 16-bit integers, its rarer words' hashes and
    what each counts as if no other document has it, and the sum of that; row is unique.

    Such a word is spelled, from the mass that its bucket leaves to unseen words.
    """
    order = np.argsort(frequent)
    keys = frequent[order]
    mass = np.log(np.maximum(different, 1))
    fields = [T.StructField("row", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("rare", T.BinaryType()), T.StructField("alone", T.DoubleType())]
    schema = T.StructType([docs.schema["key"], docs.schema["mark"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, data, offsets in text_parts(batch.column("text")):
                words, row, size = sized_words(data, offsets)
                ids = _buckets(words)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                    known = keys[at] == words
                    ids[known] = order[at[known]]
                rare, n = ids >= TYPES - BUCKETS, len(offsets) - 1
                left = np.empty(int(rare.sum()), _RARE)
                left["word"] = words[rare].view(np.int64)
                left["alone"] = mass[ids[rare].astype(np.int64) - (TYPES - BUCKETS)] - SPELLED * (size[rare] + 1.0)
                alone = np.bincount(row[rare], left["alone"].astype(float), n).astype(float)
                cells = [_cells(ids.astype("<u2"), row, n), _cells(left, row[rare], n), pa.array(alone)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, n), batch.column("mark").slice(first, n), pa.array(np.arange(number, number + n)), *cells], schema.names)
                number += n

    return docs.mapInArrow(run, schema)


def _cells(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The bytes of each row's values."""
    ends = np.cumsum(np.bincount(row, minlength=rows)) * values.itemsize
    raw = values.tobytes()
    return pa.array([raw[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])), ends)], pa.binary())


def _shares(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, share): what each document's rarer words gain over being spelled because other documents have them, in logs.

    A word counts as often as it stands in all other documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("rare").to_pylist()
            rare = np.frombuffer(b"".join(cells), _RARE)
            rows, words = np.repeat(batch.column("row").to_numpy(), [len(c) // _RARE.itemsize for c in cells]), rare["word"]
            order = np.lexsort((words, rows))
            rows, words, alone = rows[order], words[order], rare["alone"][order].astype(np.float32)
            first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (words[1:] != words[:-1])))) if len(rows) else order
            own = np.diff(np.concatenate((first, [len(rows)]))).astype(np.int32)
            for at in range(0, len(first), _POSITIONS):
                part = first[at : at + _POSITIONS]
                columns = (rows[part], words[part], own[at : at + _POSITIONS], alone[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["row", "word", "own", "alone"])

    rare = encoded.select("row", "rare").mapInArrow(run, "row long, word long, own int, alone float")
    met = rare.join(counts.filter("n > 1"), "word").filter("n > own")
    return met.groupBy("row").agg(F.sum(F.col("own") * (F.log(F.col("n") - F.col("own")) - F.col("alone"))).alias("share"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, word types, offsets) of runs of rows with a bounded number of words, or one longer row."""
    for batch in batches:
        cells = batch.column("words").to_pylist()
        at = 0
        while at < len(cells):
            end, size = at, 0
            while end < len(cells) and (size == 0 or size + len(cells[end]) <= 2 * _POSITIONS):
                size += len(cells[end])
                end += 1
            ids = np.frombuffer(b"".join(cells[at:end]), "<u2").astype(np.int64)
            yield batch.slice(at, end - at), ids, np.concatenate(([0], np.cumsum([len(c) // 2 for c in cells[at:end]])))
            at = end


#: The neighbours of a position as the digits of one number.
_PLACES = (1 << 15) ** np.arange(2 * WINDOW, dtype=np.int64)


def _examples(encoded: DataFrame, share: int, rounds: int, shards: int) -> DataFrame:
    """The positions to train on, of each round: which, and in what order and shard, follows from document id and position alone."""
    names = ["round", "shard", "place", "word", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, offsets in _runs(batches):
            near, row = windows(ids, offsets)
            marks = rows.column("mark").to_numpy().view(np.uint64)
            place = mix(marks[row] + mix(np.arange(len(ids)).astype(np.uint64) - offsets[row].astype(np.uint64)))
            for number in range(rounds):
                chosen = np.flatnonzero(mix(place + np.uint64(number)) % np.uint64(share) == 0)
                at = place[chosen]
                beside = near[chosen] @ _PLACES
                columns = [np.full(len(at), number, np.int32), ((at >> np.uint64(20)) % np.uint64(shards)).astype(np.int32), at.view(np.int64), ids[chosen].astype(np.int16), beside]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return encoded.select("mark", "words").mapInArrow(run, "round int, shard int, place long, word short, near long")


_CHANGES = "part int, shard int, n long, v binary"


def _change_table(part, shard, n, v) -> pa.Table:
    return pa.table({"part": pa.array(part, pa.int32()), "shard": pa.array(shard, pa.int32()), "n": pa.array(n, pa.int64()), "v": pa.array([x.tobytes() for x in v], pa.binary())})


def _averaged(changes: DataFrame, shards: int) -> DataFrame:
    """One row per part: the mean of the shards' changes (part, shard, n, v as 16-bit numbers), by n, as 32-bit numbers.

    Neighbouring shards are averaged FAN at a time, in as many levels as their number asks for, so a group is never larger.
    """

    def mean(kind: type):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("shard")
            n = group["n"].to_numpy()
            total = sum(np.frombuffer(x, kind).astype(np.float64) * k for x, k in zip(group["v"].to_pylist(), n / n.sum()))
            return _change_table([group["part"][0].as_py()], [group["shard"][0].as_py() // FAN], [int(n.sum())], [total.astype(np.float32)])

        return run

    kind, left = np.float16, shards
    while kind is np.float16 or left > 1:
        changes = changes.groupBy("part", F.floor(F.col("shard") / FAN)).applyInArrow(mean(kind), _CHANGES)
        kind, left = np.float32, -(-left // FAN)
    return changes


def _round(examples: DataFrame, vector: np.ndarray, shards: int) -> np.ndarray:
    """Train one network on each shard of the examples; average their changes by the shards' positions, in a fixed order."""
    start = examples.sparkSession.sparkContext.broadcast(vector)  # of the network's fixed size

    def change(group: pa.Table) -> pa.Table:
        place, words, near = (group[c].to_numpy() for c in ("place", "word", "near"))
        order = np.lexsort((near, words, place))
        net = WindowNetwork(start.value.copy())
        net.train(words[order].astype(np.int64), near[order][:, None] // _PLACES % (1 << 15))
        parts = np.array_split((net.vector - start.value).astype(np.float16), _PARTS)
        return _change_table(range(_PARTS), [group["shard"][0].as_py()] * _PARTS, [len(words)] * _PARTS, parts)

    changes = examples.groupBy("shard").applyInArrow(change, _CHANGES)
    rows = _averaged(changes, shards).orderBy("part").collect()  # the network's fixed size
    return vector + np.frombuffer(b"".join(r["v"] for r in rows), np.float32) if rows else vector


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, rounds: int = ROUNDS) -> tuple[DataFrame, WindowNetwork]:
    """(scores, network): id_col, n_words, log_likelihood and mean_log_likelihood per input row.

    Words are runs of non-white-space, A-Z lowered. Their counts over all documents give the types;
    the network is trained on a share of all positions, chosen, ordered and dealt to shards by document id and position, and
    the shards' networks are averaged by weight, so scores do not depend on partitions. Every word of every document is then
    predicted from the WINDOW words on both sides; the sum of the log-probabilities is the score.
    A word without a type of its own has its bucket's probability times count(word) / (n + t), where
    n counts the bucket's words and t the different ones; t / (n + t) is left to unseen words, which are spelled letter by letter. The count is that in all
    other documents: a document is no evidence for itself, and a word of its own is an unseen one.

    Defined cases: null, empty and blank texts have no words, a sum of 0 and no mean; texts of any
    length are scored whole; null and repeated ids are scored row by row; repeated rows score
    alike; equally frequent words are ordered by hash; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    source = small_batches(docs).select(F.col(id_col).alias("key"), F.xxhash64(id_col).alias("mark"), F.col(text_col).alias("text"))
    counts = written(_word_counts(source), "lm-words")
    frequent = counts.orderBy(F.desc("n"), "word").limit(TYPES - BUCKETS).collect()  # a fixed number of rows
    known = np.array([r["word"] for r in frequent], np.int64).view(np.uint64)
    sizes, different = _bucket_sizes(counts, known)
    types = np.zeros(TYPES)
    types[: len(frequent)] = [r["n"] for r in frequent]
    types[TYPES - BUCKETS :] = sizes
    encoded = written(_encoded(source, known, different), "lm-encoded")
    below = np.zeros(TYPES)  # what a word of each type loses to the other words of its bucket and to unseen ones
    below[TYPES - BUCKETS :] = np.log(np.maximum(sizes + different, 1))

    net = WindowNetwork.started(types)
    shards = max(1, int(-(-types.sum() // (share * SHARD))))
    examples = written(_examples(encoded, share, rounds, shards), "lm-examples") if rounds else None
    for number in range(rounds):
        net = WindowNetwork(_round(examples.filter(F.col("round") == number), net.vector, shards))
    discarded(examples)
    final = docs.sparkSession.sparkContext.broadcast(net.vector)
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("sum", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = WindowNetwork(final.value)
        for rows, ids, offsets in _runs(batches):
            near, row = windows(ids, offsets)
            sums = rows.column("alone").to_numpy().copy()
            for at in range(0, len(ids), _POSITIONS):
                part = slice(at, at + _POSITIONS)
                sums += np.bincount(row[part], fitted.log_probabilities(ids[part], near[part]) - below[ids[part]], len(rows))
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("row"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums)], schema.names)

    scored = encoded.select("key", "row", "words", "alone").mapInArrow(run, schema).join(_shares(encoded, counts), "row", "left")
    scored = scored.select(F.col("key").alias(id_col), "n_words", (F.col("sum") + F.coalesce("share", F.lit(0.0))).alias("log_likelihood"))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return scored.withColumn("mean_log_likelihood", mean), net


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of every document."""
    return score_documents(table(spark, sf_dir, "documents"))[0]
