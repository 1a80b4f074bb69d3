import zlib

import corpus_pipeline
from loomgraph.llm.bpe import public_path
from loomgraph.llm.langid import fit_documents, identify
from loomgraph.llm.pii import model, redacted


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages_against_plain_python(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    told = {r["doc_id"]: r["rejected"] for r in identify(docs, fit_documents(docs)).collect()}
    step = corpus_pipeline.language_stage(spark, docs, sf_dir)
    assert step.columns == corpus_pipeline.COLUMNS
    left = {i for i in rows if not told[i]}
    assert {r["doc_id"] for r in step.collect()} == left and len(left) >= 0.99 * len(rows)

    step = corpus_pipeline.exact_stage(spark, step, sf_dir)
    groups = {}
    for i in left:
        groups.setdefault(low(rows[i]["text"]), []).append(i)
    left = {max(g) for g in groups.values()}
    assert {r["doc_id"] for r in step.collect()} == left

    step = corpus_pipeline.near_stage(spark, step, sf_dir)
    sets, least = {i: shingles(rows[i]["text"]) for i in left}, {i: i for i in left}
    links = [(a, b) for a in left for b in left if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in left:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    left = {i for i in left if least[i] == i}
    assert {r["doc_id"] for r in step.collect()} == left

    step = corpus_pipeline.pii_stage(spark, step, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in step.collect()}
    assert texts == {i: redacted(rows[i]["text"], model().spans(rows[i]["text"])) for i in left}
    assert any(texts[i] != rows[i]["text"] for i in left)

    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_path())
    pieces, found = corpus_pipeline.packing_stage(spark, step, sf_dir).collect(), {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        found[p["doc_id"]] = found.get(p["doc_id"], b"") + bytes(p["ids"])
        assert p["ids_crc32"] == zlib.crc32(p["ids"])
    for i in left:
        ids = encoder.encode(texts[i], add_special_tokens=False).ids + [2]
        assert found[i] == b"".join(t.to_bytes(4, "little") for t in ids)


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "123", "en", "s", 3), (4, "the cat sat on the mat again", "en", "s", 9)]
    rows += [(4, "the cat sat on the mat again", "en", "s", 9), (5, "der Hund lief über die Straße", "de", "s", 9), (None, "the dog ran home", "en", "s", 1)]
    rows += [(k, f"the word number {k} of the text is here", "en", "s", 1) for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == corpus_pipeline.COLUMNS
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids.count(4) == 1 and ids.count(None) == 1 and 5 in ids and not {1, 2, 3} & set(ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_further_columns_are_left_out(spark):
    """Columns named like those that operators make, and a long text, change nothing."""
    text = "the cat sat on the mat and the dog ran to the house with a ball " * 3000
    rows = [(k, f"{text} {k * k}" if k == 3 else f"the word number {k} of this text is here and it is new {k * 7}", "en", "s", 1, "x", True, 7) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, kept boolean, keep_id int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"]: r["text"] for r in docs.collect()}[3].startswith(text)
