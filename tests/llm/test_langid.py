import numpy as np
import pytest

from loomgraph.llm import langid
from loomgraph.llm.langid import KneserNey, fit, fit_documents, folded, held_out, identify, letters_in


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(docs, fit_documents(docs), keep=["lang"]).withColumn("held", held_out("doc_id")).filter("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98
    assert not any(r["rejected"] for r in found) and all(0 <= r["score"] <= 1 for r in found)


def test_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_documents(docs)
    rows = [(1, None), (2, ""), (3, "123 !? 4"), (None, "the of and ing"), (4, "the of and ing"), (4, "the of and ing"), (5, "ⴰⵎⴰⵣⵉⵖ ⵜⵉⴼⵉⵏⴰⵖ " * 20), (6, "the of " * 50_000)]
    got = {(r["doc_id"], r["n"]): r for r in identify(spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int, score_of string"), model, keep=["n", "score_of"]).collect()}
    assert len(got) == len(rows)
    for k in (0, 1, 2):
        assert got[rows[k][0], k]["lang_pred"] == "und" and got[rows[k][0], k]["score"] == 0 and got[rows[k][0], k]["rejected"]
    assert got[None, 3]["lang_pred"] == got[4, 4]["lang_pred"] == got[4, 5]["lang_pred"] == "en"
    assert got[5, 6]["rejected"] and not got[6, 7]["rejected"]
    assert identify(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "key long, text string, lang string")
    assert fit(empty) is None
    assert fit(spark.createDataFrame([(1, "123", "en"), (2, None, "de"), (3, "text", None)], "key long, text string, lang string")) is None
    assert [r["lang_pred"] for r in identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), None).collect()] == ["und"]


def test_folding():
    assert "".join(map(chr, folded("Ab%%É 12x"))) == "ab é x"
    assert letters_in(folded("12 !")) == 0


def test_probabilities_sum_to_one_and_equal_the_formula():
    """Interpolated Kneser-Ney by its definition, over a tiny text."""
    text, order, alphabet = "abracadabra abra", 3, 64
    letters, _ = langid._joined([folded(text)], order)
    grams = {}
    for i in range(order - 1, len(letters)):
        g = tuple(letters[i - order + 1 : i + 1])
        grams[g] = grams.get(g, 0) + 1
    chars = np.array(list(grams), dtype=np.int64)
    model = KneserNey.fit(["x"], np.zeros(len(chars), np.int64), chars, np.array(list(grams.values())), alphabet)

    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1
    levels = {n: {g: k for g, k in own.items() if g[-1] != 0} for n, own in levels.items()}

    def p(context, c, n):
        if n == 0:
            return 1 / alphabet
        own = {g: k for g, k in levels[n].items() if g[:-1] == context}
        lower = p(context[1:], c, n - 1)
        if not own:
            return lower
        once, twice = (sum(k == m for k in levels[n].values()) for m in (1, 2))
        d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
        total = sum(own.values())
        return max(own.get((*context, c), 0) - d, 0) / total + d * len(own) / total * lower

    probe, _ = langid._joined([folded("cab raz bra")], order)
    got = model.log_probabilities(probe)[order - 1 :, 0]
    want = [np.log(p(tuple(probe[i - order + 1 : i]), probe[i], order)) for i in range(order - 1, len(probe))]
    assert np.allclose(got, want, atol=1e-4)
    seen = {g[-1] for g in levels[1]}
    assert abs(sum(p((97, 98), c, order) for c in seen) + (alphabet - len(seen)) * p((97, 98), 1, order) - 1) < 1e-9


def test_kept_columns_must_not_clash(spark):
    with pytest.raises(ValueError):
        langid.identify(spark.createDataFrame([(1, "a", 0.5)], "doc_id long, text string, score double"), None, keep=["score"])
