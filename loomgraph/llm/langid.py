"""Operator 4: language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomgraph.llm.common import small_batches, table
from loomgraph.llm.shingles import mix, powers

ORDER = 5
#: Labelled documents per language that the models are fitted on, whole texts; every fifth calibrates.
TRAIN_ROWS = 500
#: Characters a uniform model spreads its mass over.
ALPHABET = 1 << 12
UNKNOWN = "und"
_PAD, _BLANK = 0, 32
_POWERS = powers(np.uint64(0xC6A4A7935BD1E995), 16)
_CHUNK_CHARS = 1 << 19


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point -> lower-case letter, or blank for all that is no letter."""
    out = np.full(0x110000, _BLANK, dtype=np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def folded(text: str) -> np.ndarray:
    """Code points of a text: lower-case letters, one blank for each run of other characters."""
    codes = _folding()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    blank = codes == _BLANK
    return codes[~(blank & np.concatenate(([True], blank[:-1])))] if len(codes) else codes


def letters_in(codes: np.ndarray) -> int:
    return int((codes != _BLANK).sum())


def _joined(rows: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each behind order - 1 pads; begins of their own characters."""
    pad = np.zeros(order - 1, np.int32)
    begins = np.cumsum([0] + [len(r) + order - 1 for r in rows])[:-1] + order - 1
    return np.concatenate([x for r in rows for x in (pad, r)]) if rows else pad, begins


def gram_hashes(letters: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0..order the hash of the n characters that end at each position."""
    own = mix(letters.astype(np.uint64) + np.uint64(0x9E37))
    out = [np.zeros(len(letters), np.uint64)]
    for n in range(1, order + 1):
        h = out[-1].copy()
        h[n - 1 :] += own[: len(own) - n + 1] * _POWERS[n - 1]
        out.append(h)
    return out


class KneserNey:
    """Models of all languages side by side: sorted hash arrays, one column per language.

    Per order: keys of the n-grams any language has seen with each language's log-probability,
    and keys of the contexts with each language's log weight of the next lower order.
    """

    def __init__(self, langs: list[str], order: int, grams: list, contexts: list, uniform: float):
        self.langs, self.order, self.grams, self.contexts, self.uniform = langs, order, grams, contexts, uniform

    @classmethod
    def fit(cls, langs: list[str], lang: np.ndarray, chars: np.ndarray, count: np.ndarray, alphabet: int = ALPHABET) -> "KneserNey":
        """lang: index into langs; chars: (rows, order) code points; count: occurrences of each."""
        order, n_langs = chars.shape[1], len(langs)
        levels = []  # from the highest order down: (chars, lang, count)
        c, l, k = chars, lang, count.astype(float)
        for n in range(order, 0, -1):
            levels.append((c, l, k))
            if n > 1:  # continuation counts: in how many different n-grams an (n-1)-gram ends
                rows, inverse = np.unique(np.column_stack((l, c[:, 1:])), axis=0, return_inverse=True)
                k = np.bincount(inverse.ravel()).astype(float)
                l, c = rows[:, 0], rows[:, 1:]
        grams: list = [None] * (order + 1)
        contexts: list = [None] * (order + 1)
        lower_keys, lower_p = None, None
        for n, (c, l, k) in enumerate(reversed(levels), 1):
            real = c[:, -1] != _PAD  # pads are contexts only, never predicted
            c, l, k = c[real], l[real], k[real]
            once = np.array([((k == 1) & (l == i)).sum() for i in range(n_langs)], float)
            twice = np.array([((k == 2) & (l == i)).sum() for i in range(n_langs)], float)
            discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
            own = mix(c.astype(np.uint64) + np.uint64(0x9E37))
            key = (own * _POWERS[:n][::-1]).sum(axis=1, dtype=np.uint64)
            head = ((own[:, :-1] * _POWERS[: n - 1][::-1]).sum(axis=1, dtype=np.uint64) if n > 1 else np.zeros(len(c), np.uint64))
            tail = ((own[:, 1:] * _POWERS[: n - 1][::-1]).sum(axis=1, dtype=np.uint64) if n > 1 else np.zeros(len(c), np.uint64))
            heads, at = np.unique(head, return_inverse=True)
            total, kinds = np.zeros((len(heads), n_langs)), np.zeros((len(heads), n_langs))
            np.add.at(total, (at, l), k)
            np.add.at(kinds, (at, l), 1)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            mass = np.zeros((len(keys), n_langs))
            np.add.at(mass, (inverse, l), np.maximum(k - discount[l], 0))
            head_of = at[first]
            below = np.full((len(keys), n_langs), 1 / alphabet) if n == 1 else lower_p[np.searchsorted(lower_keys, tail[first])]
            p = mass / np.maximum(total[head_of], 1) + weight[head_of] * below
            grams[n], contexts[n] = (keys, np.log(p).astype(np.float32)), (heads, np.log(weight).astype(np.float32))
            lower_keys, lower_p = keys, p
        return cls(langs, order, grams, contexts, float(np.log(1 / alphabet)))

    def log_probabilities(self, letters: np.ndarray) -> np.ndarray:
        """(positions, languages) log-probability of each character after those before it."""
        hashes = gram_hashes(letters, self.order)
        out = np.zeros((len(letters), len(self.langs)), np.float32)
        left = np.arange(len(letters))
        for n in range(self.order, 0, -1):
            keys, logs = self.grams[n]
            wanted = hashes[n][left]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[at] == wanted
            out[left[found]] += logs[at[found]]
            left = left[~found]
            if not len(left):
                return out
            heads, weights = self.contexts[n]
            wanted = hashes[n - 1][left - 1] if n > 1 else np.zeros(len(left), np.uint64)
            at = np.minimum(np.searchsorted(heads, wanted), len(heads) - 1)
            known = heads[at] == wanted
            out[left[known]] += weights[at[known]]
        out[left] += np.float32(self.uniform)
        return out

    def cross_entropies(self, rows: list[np.ndarray]) -> np.ndarray:
        """(rows, languages) mean negative log-probability per character; rows must not be empty."""
        letters, begins = _joined(rows, self.order)
        logs = self.log_probabilities(letters)
        logs[: self.order - 1] = 0
        for k in range(self.order - 1):
            logs[begins[1:] - 1 - k] = 0  # pads
        sums = np.add.reduceat(logs, begins, axis=0, dtype=np.float64)
        return -sums / np.array([[len(r)] for r in rows])


class Identifier:
    """A model with its calibration: sharpness of the confidence and bounds of rejection."""

    def __init__(self, model: KneserNey, sharpness: float, bound: float, spread: float):
        self.model, self.sharpness, self.bound, self.spread = model, sharpness, bound, spread

    def predict(self, texts: list) -> Iterator[tuple[str, float, float, bool]]:
        """(language, confidence, cross-entropy, rejected) of each text."""
        rows = [folded(t or "") for t in texts]
        usable = [i for i, r in enumerate(rows) if letters_in(r)]
        out: list = [(UNKNOWN, 0.0, None, True)] * len(rows)
        at = 0
        while at < len(usable):
            end, size = at, 0
            while end < len(usable) and (size == 0 or size < _CHUNK_CHARS):
                size += len(rows[usable[end]])
                end += 1
            part = usable[at:end]
            entropy = self.model.cross_entropies([rows[i] for i in part])
            for i, h in zip(part, entropy):
                best = int(np.argmin(h))
                confidence = 1 / np.exp(self.sharpness * (h[best] - h)).sum()
                rejected = h[best] - self.spread / np.sqrt(len(rows[i])) > self.bound
                out[i] = (self.model.langs[best], float(confidence), float(h[best]), bool(rejected))
            at = end
        yield from out


def _calibrated(model: KneserNey, lang: np.ndarray, entropy: np.ndarray, length: np.ndarray) -> Identifier:
    """Fit the confidence by likelihood and put the rejection bound beyond all calibration texts' usual range."""
    grid = 2.0 ** np.arange(-1, 9)
    gap = entropy - entropy.min(axis=1, keepdims=True)
    likely = [np.mean(-s * gap[np.arange(len(lang)), lang] - np.log(np.exp(-s * gap).sum(axis=1))) for s in grid]
    own = entropy.min(axis=1)
    spread = 4.0  # nats over the root of the length: short texts vary more
    margin = 0.5 + 10 / np.sqrt(len(own))  # wider where few texts calibrate
    bound = float(np.quantile(own - spread / np.sqrt(length), 0.999) + margin)
    return Identifier(model, float(grid[int(np.argmax(likely))]), bound, spread)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, order: int = ORDER) -> Identifier | None:
    """Fit on at most train_rows documents of each language of labelled (key, text, lang).

    The rows with the least hashed key are taken, whole texts; four fifths of them count for the
    models, one fifth calibrates. n-grams are counted by Spark; tables bounded by the sample
    come to the driver. None if no labelled text has a letter.
    """
    rows = small_batches(labelled).filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("key"))
    shares = [(r["lang"], min(1.0, (2.0 * train_rows + 100) / r["n"])) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not shares:
        return None
    langs = sorted(name for name, _ in shares)
    cut = F.create_map([F.lit(x) for name, share in shares for x in (name, int((share - 0.5) * (2**64 - 2**12)))])
    some = rows.filter(F.col("h") <= cut[F.col("lang")])  # about twice as many as wanted
    ranked = some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "key"))).filter(F.col("r") <= train_rows)
    sample = ranked.select("text", F.array_position(F.lit(langs), F.col("lang")).cast("int").alias("l"), "r")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("l").to_numpy()
            texts = batch.column("text").to_pylist()
            for i, text in zip(lang, texts):
                letters, _ = _joined([folded(text)], order)
                key = gram_hashes(letters, order)[order][order - 1 :]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                grams = ["".join(map(chr, letters[f : f + order])) for f in first]
                yield pa.RecordBatch.from_pydict({"l": pa.array(np.full(len(n), i - 1, np.int32)), "gram": grams, "n": pa.array(n.astype(np.int64))})

    models = sample.filter("r % 5 != 0").mapInArrow(count, "l int, gram string, n long")
    counted = models.groupBy("l", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counted.num_rows:
        return None
    chars = np.frombuffer("".join(counted["gram"].to_pylist()).encode("utf-32-le"), dtype="<u4").reshape(-1, order).astype(np.int64)
    model = KneserNey.fit(langs, counted["l"].to_numpy().astype(np.int64), chars, counted["n"].to_numpy())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column("l").to_pylist(), batch.column("text").to_pylist()):
                row = folded(text)
                if letters_in(row):
                    h = model.cross_entropies([row])[0]
                    yield pa.RecordBatch.from_pydict({"l": pa.array([i - 1], pa.int32()), "h": [h.tolist()], "n": pa.array([len(row)], pa.int64())})

    held = sample.filter("r % 5 = 0").mapInArrow(measure, "l int, h array<double>, n long").collect()
    if not held:
        return Identifier(model, 32.0, 12.0, 4.0)
    return _calibrated(model, np.array([r["l"] for r in held]), np.array([r["h"] for r in held]), np.array([r["n"] for r in held], float))


def identify(docs: DataFrame, identifier: Identifier | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col (and the columns of keep) with lang_pred, score, cross_entropy and rejected.

    lang_pred is the language of least length-normalised cross-entropy, score its calibrated
    probability. Only the text is read. rejected marks texts without letters and texts that no
    model explains as well as calibration texts. Null, empty and letterless texts are `und`
    with score 0 and no cross-entropy; texts of any length are scored whole; ties go to the
    first language by name; rows that repeat are predicted alike; an empty table gives an empty
    result; without a fitted identifier every text is `und`; keep must not name a column of the result.
    """
    if taken := {id_col, "lang_pred", "score", "cross_entropy", "rejected"} & set(keep or []):
        raise ValueError(f"{sorted(taken)} are columns of the result")
    model = docs.sparkSession.sparkContext.broadcast(identifier)  # bounded by the training sample
    names = [id_col, *(keep or [])]
    again = text_col not in names  # the text travels once
    source = small_batches(docs).select(*names, *([F.col(text_col).alias("_text")] if again else []))
    text_at = len(names) if again else names.index(text_col)
    schema = T.StructType(
        [docs.schema[c] for c in names]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(text_at).to_pylist()
                rows = list(found.predict(texts)) if found else [(UNKNOWN, 0.0, None, True)] * len(texts)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *columns], schema.names)

    return source.mapInArrow(run, schema)


def held_out(id_col: str):
    """True for the third of documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Identifier | None:
    """Fit on documents (doc_id, text, lang) that are not held out; null ids are left out."""
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return fit(learn.select(F.col("doc_id").alias("key"), "text", "lang"), train_rows)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, learned from the documents not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_documents(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
