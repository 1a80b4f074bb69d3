"""Operator 7: removal of repeated byte strings by common-prefix interval trees of suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomgraph.llm.common import small_batches, table, written
from loomgraph.llm.shingles import _BASE, _LETTER, _UNBASE, mix, powers, text_parts
from loomgraph.llm.suffix import repeats_in

LENGTH = 100
#: Bytes of an anchor: of the anchors in each LENGTH-byte string, the one with the least hash names its task.
ANCHOR = 20
#: Different fragments of one anchor that one suffix array takes; those of a more crowded anchor are dealt anew by deeper anchors.
GROUP = 8192
#: Fragments gathered before a suffix array is built.
GATHER = 8192
_STRIDE = 1 << 20
_POSITION = np.uint64((1 << 24) - 1)

_FRAGMENTS = "h long, f long, key long, at long, n long"
_TEXTS = "h long, f long, key long, at long, n long, root long, text binary"
_TEXT_NAMES = ["h", "f", "key", "at", "n", "root", "text"]
_MARKS = "key long, a long, b long"


def _strips(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, byte of its text, bytes, offsets): a run of rows, or overlapping parts of one long row."""
    if len(offsets) > 2 or len(data) <= _STRIDE + length:
        yield 0, 0, data, offsets
        return
    for at in range(0, len(data) - length + 1, _STRIDE):
        part = data[at : at + _STRIDE + length - 1]
        yield 0, at, part, np.array([0, len(part)])


def _hash_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes' weights, and the factors that make differences comparable."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * powers(_BASE, n), out=sums[1:])
    return sums, powers(_UNBASE, n + 1)


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, fragment hash, row, start, strings): runs of length-byte strings with one anchor.

    The anchor of a string depends on its bytes alone, so equal strings have equal anchor hashes,
    wherever they are. A fragment is the text that its strings cover.
    """
    n, width = len(data), length - anchor + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums, unit = _hash_sums(data)
    h = mix((sums[anchor:] - sums[:-anchor]) * unit[: n - anchor + 1])
    key = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    blocks = np.concatenate((key, np.full(-len(key) % width, ~np.uint64(0)))).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    least = (np.minimum(backward[:m], forward[width - 1 : width - 1 + m]) & _POSITION).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    starts = np.flatnonzero(np.arange(m) + length <= offsets[row + 1])
    if not len(starts):
        return fragments(data[:0], np.array([0, 0]), length, anchor)
    anchors = least[starts]
    first = np.flatnonzero(np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1))))
    begin, count = starts[first], np.diff(np.concatenate((first, [len(starts)])))
    end = begin + count - 1 + length
    where = (anchors[first] - begin).astype(np.uint64) * np.uint64(129) + count.astype(np.uint64)
    f = mix(mix((sums[end] - sums[begin]) * unit[begin]) + where)
    return h[anchors[first]], f, row[begin], begin - offsets[row[begin]], count


def _first_of_batch(h: np.ndarray, f: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, again): rows sorted by fragment and place, and which of them follow an equal fragment."""
    order = np.lexsort((at, key, f, h))
    h, f = h[order], f[order]
    return order, np.concatenate(([False], (h[1:] == h[:-1]) & (f[1:] == f[:-1])))[: len(h)]


def _fragment_rows(docs: DataFrame, length: int, anchor: int, combine: bool) -> DataFrame:
    """Fragments (n > 0); with combine those that follow an equal one of the same batch have n < 0 and an h of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, data, offsets in text_parts(batch.column("text"), _STRIDE):
                for _, skip, part, bounds in _strips(data, offsets, length):
                    h, f, row, at, n = fragments(part, bounds, length, anchor)
                    key, at = keys[first + row], at + skip
                    if combine and len(h):
                        order, again = _first_of_batch(h, f, key, at)
                        h, f, key, at, n = h[order], f[order], key[order], at[order], n[order]
                        h = np.where(again, mix(f + at.astype(np.uint64)), h)
                        n = np.where(again, -n, n)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), f.view(np.int64), key, at, n)], ["h", "f", "key", "at", "n"])

    return small_batches(docs).mapInArrow(run, _FRAGMENTS)


def _fragment_texts(wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each document's wanted fragments, a document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys, texts, lists = (batch.column(c) for c in ("key", "text", "list"))
            for i in range(batch.num_rows):
                raw, rows = unpack(texts[i].as_py()), lists[i].values
                h, f, at, n, hot = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("h", "f", "at", "n", "hot"))
                parts = [raw[x : x + k - 1 + length] for x, k in zip(at.tolist(), n.tolist())]
                columns = [h, f, np.full(len(h), keys[i].as_py()), at, n, at, pa.array(parts, pa.binary()), hot]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [*_TEXT_NAMES, "hot"])

    return small_batches(wanted).mapInArrow(run, _TEXTS + ", hot boolean")


def _deeper(crowded: DataFrame, length: int, anchor: int, combine: bool) -> DataFrame:
    """Fragments cut into those of a longer anchor; equal strings still share their anchor's hash.

    With combine, fragments that follow an equal one of the same batch have n < 0, no text and an h of their own.
    Where the anchor is the whole string, equal strings are equal fragments and need no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            h, f, row, at, n = fragments(data, offsets - offsets[0], length, anchor)
            old_h, key, start, root = (batch.column(c).to_numpy()[row] for c in ("h", "key", "at", "root"))
            h = mix(h + np.uint64(anchor) * _BASE ^ old_h.view(np.uint64))  # parts of one crowded anchor stay apart from others
            raw, begin, at = data.tobytes(), (offsets - offsets[0])[:-1][row] + at, start + at
            if combine:
                order, again = _first_of_batch(h, f, key, at)
                h, f, key, at, n, root, begin = (c[order] for c in (h, f, key, at, n, root, begin))
                h, n = np.where(again, mix(f + at.astype(np.uint64)), h), np.where(again, -n, n)
            parts = [raw[x : x + k - 1 + length] if k > 0 and anchor < length else b"" for x, k in zip(begin.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), f.view(np.int64), key, at, n, root)] + [pa.array(parts, pa.binary())], _TEXT_NAMES)

    return small_batches(crowded.select(*_TEXT_NAMES)).mapInArrow(run, _TEXTS)


def _groups(texts: list[bytes], key: np.ndarray, at: np.ndarray, n: np.ndarray, length: int):
    """Maximal repeats of gathered fragments as (length, members, whether each is not the first occurrence)."""
    _, base, suffix, of, found = repeats_in(texts, n, length)
    place = at[of] + suffix - base[of]
    rank = np.empty(len(suffix), np.int64)
    rank[np.lexsort((place, key[of]))] = np.arange(len(suffix))
    size = found[:, 2] - found[:, 1] + 1
    begin = np.cumsum(size) - size
    member = np.repeat(found[:, 1] - begin, size) + np.arange(size.sum())
    later = rank[member] != np.repeat(np.minimum.reduceat(rank[member], begin), size) if len(size) else np.zeros(0, bool)
    return base, suffix, of, place, np.repeat(found[:, 0], size), np.repeat(np.arange(len(size)), size), member, later


def _gathered(frags: DataFrame, schema: str, length: int, make) -> DataFrame:
    """Run make(texts, key, at, n, root) over whole anchor groups, GATHER fragments or more at a time."""
    columns = ["h", "key", "at", "n", "root", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows > 1:
                yield from make(t["text"].to_pylist(), *(t[c].to_numpy() for c in ("key", "at", "n", "root")))

        for batch in batches:
            for lo in range(0, batch.num_rows, GATHER):
                held.append(batch.slice(lo, GATHER))
                rows += held[-1].num_rows
                if rows >= GATHER:
                    t = pa.Table.from_batches(held)
                    h = t["h"].to_numpy()
                    cut = len(h) - int(np.argmax(h[::-1] != h[-1])) if h[0] != h[-1] else 0
                    if cut:
                        yield from work(t.slice(0, cut))
                        held, rows = t.slice(cut).to_batches(), len(h) - cut
        if held:
            yield from work(pa.Table.from_batches(held))

    return frags.select(*columns).repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def _mark(length: int):
    def make(texts, key, at, n, _) -> Iterator[pa.RecordBatch]:
        base, suffix, of, _, long, _, member, later = _groups(texts, key, at, n, length)
        edge = np.zeros(base[-1] + 1, np.int64)
        np.add.at(edge, suffix[member[later]], 1)
        np.add.at(edge, suffix[member[later]] + long[later], -1)
        covered = np.concatenate(([0], np.cumsum(edge)[:-1] > 0, [0])).astype(np.int8)
        borders = np.zeros(base[-1] + 1, bool)
        borders[base] = True  # a run ends where its fragment does
        on = np.flatnonzero((covered[1:-1] == 1) & ((covered[:-2] == 0) | borders[:-1]))
        off = np.flatnonzero((covered[1:-1] == 1) & ((covered[2:] == 0) | borders[1:])) + 1
        owner = np.searchsorted(base, on, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[owner], at[owner] + on - base[owner], at[owner] + off - base[owner])], ["key", "a", "b"])

    return make


def _list(length: int):
    def make(texts, key, at, n, root) -> Iterator[pa.RecordBatch]:
        _, _, of, place, long, group, member, _ = _groups(texts, key, at, n, length)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
        name = mix(mix(key[of[member]][first].astype(np.uint64)) + place[member][first].astype(np.uint64) * _BASE + long[first].astype(np.uint64))
        ids = name[group].view(np.int64) if len(group) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, long, key[of[member]], place[member], root[of[member]])], ["repeat_id", "length", "key", "start", "root"])

    return make


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(key, id, text) with keys that order documents; whole numbers serve unless some are null or repeat."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    if whole and rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").isEmpty():
        return rows.select(F.col("id").cast("long").alias("key"), "id", "text"), "id"
    ordered = rows.orderBy(F.asc_nulls_first("id"), "text").select(F.monotonically_increasing_id().alias("key"), "id", "text")
    return written(ordered, "repeat-keys"), "key"


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with k (the place among equal fragments), nf (different fragments of the anchor) and nr (its fragments)."""
    same, anchor = W.partitionBy("h", "f").orderBy("key", "at"), W.partitionBy("h")
    ranked = rows.withColumn("k", F.row_number().over(same))
    return ranked.withColumn("nf", F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).over(anchor))


def _anchors(anchor: int, length: int) -> list[int]:
    """Lengths of the deeper anchors; the last one is the whole string, so its equal strings are equal fragments."""
    return [a for a in (anchor + (length - anchor) // 3, anchor + 2 * (length - anchor) // 3) if anchor < a < length] + [length]


def _span(length: int) -> list:
    """Columns a, b of the bytes that a fragment covers."""
    return [F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + length).alias("b")]


def _packed(keyed: DataFrame) -> DataFrame:
    """keyed with its texts compressed one by one, which shuffles fewer bytes than blocks of rows do."""
    schema = T.StructType([keyed.schema["key"], keyed.schema["id"], T.StructField("text", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(map(pack, texts), pa.binary())], schema.names)

    return small_batches(keyed.select("key", "id", "text")).mapInArrow(run, schema)


def _texts_of(wanted: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """The fragments (h, f, key, at, n, hot) with their bytes; each text is fetched once."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "f", "at", "n", "hot")).alias("list"))  # of one text
    return _fragment_texts(lists.join(_packed(keyed).select("key", "text"), "key"), length)


def _compared(keyed: DataFrame, length: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """(marks of fragments equal to an earlier one, different fragments of each anchor with several, at most GROUP of one)."""
    ranked = _ranked(_fragment_rows(keyed.select("key", "text"), length, anchor, True))
    kept = ranked.filter("n < 0 OR k > 1 OR nf > 1").select("h", "f", "key", "at", F.abs("n").alias("n"), (F.expr("n < 0 OR k > 1")).alias("again"), "nf")
    kept = written(kept, "repeat-fragments")
    marks = kept.filter("again").select("key", *_span(length))
    texts = written(_texts_of(kept.filter("NOT again").withColumn("hot", F.col("nf") > GROUP), keyed, length), "repeat-texts")
    few, rest = texts.filter("NOT hot").drop("hot"), texts.filter("hot").drop("hot")
    for deeper in _anchors(anchor, length):
        if rest.isEmpty():
            break
        ranked = written(_ranked(_deeper(rest, length, deeper, True)), "repeat-deeper")
        marks = marks.unionByName(ranked.filter("n < 0 OR k > 1").withColumn("n", F.abs("n")).select("key", *_span(length)))
        if deeper == length:
            break
        few = few.unionByName(ranked.filter((F.col("n") > 0) & (F.col("k") == 1) & F.col("nf").between(2, GROUP)).select(*_TEXT_NAMES))
        rest = ranked.filter((F.col("k") == 1) & (F.col("nf") > GROUP))
    return marks, few


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Maximal repeats of at least length bytes with all their occurrences.

    Returns repeat_id, length, id_col, start. Repeats are seen within the fragment of one anchor, so a
    repeat of many hundred bytes shows up as several overlapping groups. Of equal fragments the first two enter the suffix
    array; occurrences in the others follow from theirs. Anchors with more than GROUP such fragments are parted by deeper
    ones; where even whole strings are that crowded, their groups have exactly length bytes.

    Defined cases: null, empty and short texts have no repeats; ids of any type may be null or repeat, and each row
    counts as a document; repeated rows repeat each other; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    keyed, _ = _keyed(docs, id_col, text_col)
    rows = _fragment_rows(keyed.select("key", "text"), length, anchor, False)
    copies, in_anchor = W.partitionBy("h", "f").orderBy("key", "at"), W.partitionBy("h")
    ranked = rows.withColumn("k", F.row_number().over(copies)).withColumn("rep", F.first(F.struct("key", "at")).over(copies))
    ranked = ranked.withColumn("nr", F.sum(F.when(F.col("k") <= 2, 1).otherwise(0)).over(in_anchor)).filter("nr > 1")
    ranked = written(ranked, "repeat-fragments")
    texts = written(_texts_of(ranked.filter("k <= 2").withColumn("hot", F.col("nr") > GROUP), keyed, length), "repeat-texts")
    few, rest = texts.filter("NOT hot").drop("hot"), texts.filter("hot").drop("hot")
    listed = "repeat_id long, length long, key long, start long, root long"
    found = None
    for deeper in _anchors(anchor, length):
        if rest.isEmpty():
            break
        parts = _deeper(rest, length, deeper, False).withColumn("nr", F.count(F.lit(1)).over(in_anchor)).filter("nr > 1")
        parts = written(parts, "repeat-deeper")
        if deeper == length:
            found = parts.select(F.col("h").alias("repeat_id"), F.lit(length).cast("long").alias("length"), "key", F.col("at").alias("start"), "root")
            break
        few = few.unionByName(parts.filter(F.col("nr") <= GROUP).select(*_TEXT_NAMES))
        rest = parts.filter(F.col("nr") > GROUP)
    groups = _gathered(few, listed, length, _list(length))
    found = written(groups if found is None else groups.unionByName(found), "repeat-groups")
    others = ranked.filter("k > 2").select(F.col("rep.key").alias("key"), F.col("rep.at").alias("root"), F.col("key").alias("other"), F.col("at").alias("other_at"))
    more = found.join(others, ["key", "root"]).select("repeat_id", "length", F.col("other").alias("key"), (F.col("start") - F.col("root") + F.col("other_at")).alias("start"))
    every = found.select("repeat_id", "length", "key", "start").unionByName(more).distinct()
    return every.join(keyed.select("key", "id"), "key").select("repeat_id", "length", F.col("id").alias(id_col), "start")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Remove each byte that a length-byte string covers which also starts earlier.

    Returns one row per input row: id_col, n_bytes, spans (array of start, end: maximal removed
    runs, in bytes of UTF-8) and kept (binary).

    Every length-byte string has an anchor chosen by content; runs of strings with one anchor are
    fragments. Of equal fragments (by two 64-bit hashes), the first stands in the suffix array for all, and the others are
    marked whole; only fragments whose anchor has different texts around it are fetched. Their suffixes
    are sorted, common-prefix intervals found by a stack scan, and in each left-diverse interval
    all occurrences but the first are marked. Fragments of anchors with more than GROUP different ones
    are cut anew by deeper anchors, up to the whole string, and go the same way.

    Defined cases: earlier means a smaller id, or an earlier start in the same text; null ids come
    first, rows that repeat an id follow each other by text, ids that are no numbers are in their own order; null, empty and
    short texts lose nothing; longer texts are cut into overlapping strips, never truncated; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    keyed, _ = _keyed(docs, id_col, text_col)
    marks, texts = _compared(keyed, length, anchor)
    marks = marks.unionByName(_gathered(texts, _MARKS, length, _mark(length)))
    lists = marks.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("list"))  # of one text
    joined = _packed(keyed).join(lists, "key", "left").select("id", "text", "list")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(id_col, keyed.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, spans, kept = [], [], []
                for text, marked in zip(part.column("text").to_pylist(), part.column("list").to_pylist()):
                    raw, runs, out, end = unpack(text), [], [], 0
                    for a, b in sorted((m["a"], m["b"]) for m in marked or []):
                        if runs and a <= runs[-1]["end"]:
                            runs[-1]["end"] = max(b, runs[-1]["end"])
                        else:
                            runs.append({"start": a, "end": b})
                    for r in runs:
                        out.append(raw[end : r["start"]])
                        end = r["end"]
                    sizes.append(len(raw))
                    spans.append(runs)
                    kept.append(b"".join([*out, raw[end:]]))
                types = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, types), pa.array(kept, pa.large_binary())], schema.names)

    return joined.mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that start earlier, as digests."""
    left = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
