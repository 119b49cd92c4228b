import random

import numpy as np
import pytest

from stratafile.llm import truncation

WORDS = "share folder index copy run group digest owner list report backup drive".split()


def sentence(rng):
    return " ".join([rng.choice(WORDS).capitalize(), *(rng.choice(WORDS) for _ in range(rng.randrange(4, 12)))]) + rng.choice(".!?")


@pytest.fixture(scope="module")
def corpus():
    """Texts of two sources, one cut at 150 characters, with some texts cut anywhere; the true cases by id."""
    rng = random.Random(6)
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 7)))
        source = rng.choice(["free", "limited"])
        whole = text
        if source == "limited":
            text = text[:150]
        elif rng.random() < 0.06:
            text = text[: rng.randrange(10, len(text))]
        rows.append((i, text, source))
        if text != whole and text[-1] not in ".!? ":
            cut.add(i)
    return rows, cut


def test_cut_texts_are_found(spark, corpus):
    rows, cut = corpus
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id for r in truncation.truncated(df).collect()}
    hit = len(got & cut)
    assert hit / len(cut) > 0.9 and hit / len(got) > 0.85
    marked = {r.doc_id: r.at_limit for r in truncation.truncated_with_limits(df).collect()}
    limited = {i for i, _, source in rows if source == "limited"}
    assert set(marked) == got and {i for i, at in marked.items() if at} <= limited and sum(marked.values()) > 50
    by = {r.source: r for r in truncation.truncation_by_source(df).collect()}
    assert by["limited"].cut_at_limit > 50 and by["limited"].share > by["free"].share
    assert sum(r.texts for r in by.values()) == len(rows)


def test_limits_are_found_in_their_unit(spark):
    rng = random.Random(1)
    rows = [("a", "chars", 100 if rng.random() < 0.2 else rng.randrange(20, 100), i) for i in range(800)]
    rows += [("b", "bytes", rng.randrange(20, 400), i) for i in range(800)]
    rows += [("b", "bytes", 250, 5)] * 500  # copies of one text
    df = spark.createDataFrame(rows, "source string, unit string, length long, h long")
    out = truncation.limits(df).collect()
    assert [(r.source, r.unit, r.length) for r in out] == [("a", "chars", 100)]
    assert out[0].excess > 0.8
    assert truncation.limits(df.limit(0)).count() == 0


def test_marks():
    assert truncation.unmarked("so it goes...") == ("so it goes", True)
    assert truncation.unmarked("as the\u2026") == ("as the", True)
    assert truncation.unmarked("x" * 100 + " [more] ") == ("x" * 100, True)
    assert truncation.unmarked("done.") == ("done.", False)
    assert truncation.unmarked("") == ("", False)
    assert truncation.unmarked("as the... " + " " * 60 + "\n") == ("as the", True)


def test_shapes_and_last_sentences():
    assert truncation._shape("Ab cD  12,3\t\u0394\u03b5 x_y") == "A a 0,0 A a_a"
    assert truncation._last_stop("no stop at all" * 1000) == 0 and truncation._last_stop("One. Two. " + "x" * 5000) == 10 and truncation._last_stop("") == 0


def test_the_logit_of_plain_cuts():
    rng = np.random.default_rng(3)
    cut = rng.normal(5, 1, 600)
    whole = -6 + np.abs(rng.logistic(0, 1.0, 20_000))
    t = truncation.plain_logit(np.concatenate([whole, cut]))
    assert 0 <= t < 4 and (whole > t).sum() <= 0.03 * 600
    assert truncation.plain_logit(whole[:5]) == 0.0
    assert truncation.complete_share(whole, np.concatenate([rng.choice(whole, 50), rng.normal(5, 1, 950)])) == pytest.approx(0.05, abs=0.03)


def test_features_of_any_text():
    for text in ["x", "\ufffd", "a" * 100_000, "{\n\"a\": [1", "日本語", "é" * 50, "\x00\x01"]:
        f = truncation.features(text, {})
        assert f and all(0 <= x < 1 << truncation.BITS for x in f)
    rng = np.random.default_rng(0)
    assert 1 <= len(truncation.cut_at_random("abcdef", rng)) <= 6
    assert truncation.cut_at_random("a", rng) == "a"


def test_nulls_blanks_empty_tables_and_clashing_columns(spark, corpus):
    schema = "doc_id long, text string, source string"
    assert truncation.truncated(spark.createDataFrame([], schema)).count() == 0
    odd = [(-1, None, "a"), (-2, "", None), (-3, " \n\u00a0", "a"), (-4, "Run " * 30_000 + "stop.", None), (None, "The run stopp", "a")]
    df = spark.createDataFrame([*odd, *corpus[0][:200]], schema).selectExpr("*", "1 AS chars", "'x' AS SOURCE", "2 AS logit")
    got = {r.doc_id for r in truncation.truncated(df).collect()}
    assert not got & {-1, -2, -3}
    scored = truncation.score_endings(df)
    assert scored.count() == 202
    assert scored.select("chance").where("chance IS NULL OR isnan(chance)").count() == 0


def test_same_result_wherever_rows_lie(spark, corpus):
    df = spark.createDataFrame(corpus[0][:600], "doc_id long, text string, source string")
    a = {r.doc_id for r in truncation.truncated(df.repartition(1)).collect()}
    b = {r.doc_id for r in truncation.truncated(df.repartition(7)).collect()}
    assert a == b


def test_words_outside_the_sample_are_known(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 10))) for _ in range(6000)})
    rows, cut = [], set()
    for i in range(3000):
        text = " ".join(rng.choice(words) for _ in range(20))
        if rng.random() < 0.2:
            cut.add(i)
            text = text[: -rng.randrange(2, len(text.rsplit(" ", 1)[1]))]
        rows.append((i, text, "a"))
    scored = truncation.score_endings(spark.createDataFrame(rows, "doc_id long, text string, source string"), sample=150).collect()
    cuts, wholes = [r.logit for r in scored if r.doc_id in cut], [r.logit for r in scored if r.doc_id not in cut]
    # with words of the sample alone 0.87
    assert sum(a > b for a in cuts for b in wholes) > 0.95 * len(cuts) * len(wholes)


def test_words_of_all_texts_count(spark):
    rows = [(f"the folder{chr(97 + i // 26)}{chr(97 + i % 26)} ends", False) for i in range(26 * 26)]
    found = {r["last"]: (r.whole, r.longer) for r in truncation.vocabulary(spark.createDataFrame(rows, "text string, at_limit boolean")).collect()}
    assert found["the"] == (676, 0) and found["folder"] == (0, 676) and found["folderab"] == (1, 0) and "ends" not in found


def test_all_texts_shape_the_model(spark):
    rng = random.Random(4)
    rows, rare = [], {i for i in range(1600) if i % 40 == 7}
    for i in range(1600):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 5)))
        rows.append((i, text + " Sent by kxq" if i in rare else text, "a"))
    scored = truncation.score_endings(spark.createDataFrame(rows, "doc_id long, text string, source string"), sample=80).collect()
    # an end without a stop, in an unknown word: that it is whole is known from all texts, not from 80
    whole = [r.logit < 0 for r in scored if r.doc_id in rare]
    assert len(whole) == 40 and sum(whole) > 36


def test_parts_hold_every_text_once(spark):
    rng = random.Random(5)
    texts = sorted({" ".join(sentence(rng) for _ in range(rng.randrange(1, 4))) for _ in range(400)})
    df = spark.createDataFrame([(t, i % 5 == 0) for i, t in enumerate(texts)], "text string, at_limit boolean")
    packed = truncation.example_parts(df, truncation.vocabulary(df), part=50, cuts=2)
    kinds = np.array([r.kinds for r in packed.collect()]).reshape(-1, truncation.FOLDS, 3).sum((0, 1))
    assert packed.count() == -(-len(texts) // 50) and packed.select("part").distinct().count() == packed.count()
    assert kinds.tolist() == [len(texts) - -(-len(texts) // 5), -(-len(texts) // 5), 2 * len(texts)]
    model = truncation.fit_weights(packed)
    by_one = truncation.fit_end_model(df, truncation.vocabulary(df), cuts=2)
    # support is that of all parts, so the same properties are known as in a single one
    assert ((model.weights != 0) == (by_one.weights != 0)).mean() > 0.999
    assert truncation.fit_weights(packed.limit(0)) is None


def test_thresholds_from_counts_equal_those_from_ends():
    rng = np.random.default_rng(2)
    whole, cut = np.round(rng.normal(-4, 1.5, 5000), 2), np.round(rng.normal(3, 2, 5000), 2)
    (z, n), (c, m) = (np.unique(a, return_counts=True) for a in (whole, cut))
    assert truncation.plain_logit(z, n=n) == truncation.plain_logit(whole)
    assert truncation.complete_share(z, c, n, m) == pytest.approx(truncation.complete_share(whole, cut))
