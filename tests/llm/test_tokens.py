import random
import time
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafile.llm import tokens

pytestmark = pytest.mark.skipif(not Path(tokens.TOKENIZERS, "byte_bpe_50k.json").exists(), reason="no tokenizer files")

HARD = ["don't 'll x'r e", "  \n\n \t x   ", "a" * 5000, " " * 3000 + "x", "naïve café 日本語のテキスト。" * 40, "😀👩‍👩‍👧 ﬁ ½", "<|endoftext|> x", "x'", "1234567890" * 30, "\r\n\r\n", "e\u0301" * 400]


def plain(texts):
    t = tokens.load("byte_bpe_50k")
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def joined(text, ends):
    t = tokens.load("byte_bpe_50k")
    chunks = [text[a:b] for a, b in zip([0, *ends], ends)]
    return tokens.join_chunks(t, [(c, *p) for c, p in zip(chunks, tokens.encode_parts(t, chunks))]).tolist()


def test_corpus_equals_whole_texts(spark):
    rng = random.Random(1)
    words = ["the", " share", "'s", "\n", "  ", "report_12.pdf", "S:\\Jobs\\", "ü", "日本", "—", "123", "don't"]
    texts = [None, "", *HARD, *("".join(rng.choice(words) for _ in range(rng.randrange(1, 900))) for _ in range(40))]
    texts += texts[:6]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in enumerate(texts)], "doc_id long, text string, key int, TEXT int")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    assert got == dict(enumerate(plain([x or "" for x in texts])))


def test_rows_with_one_id_stay_apart_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, None)], "doc_id long, text string")
    assert sorted(map(len, (r.ids for r in tokens.encode_corpus(df).collect()))) == [0, 2, 2]
    assert tokens.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '\n\tsltrevdm1.é日😀<|_-")), max_size=60), st.data())
def test_joins_at_any_place(text, data):
    if not text:
        return
    ends = sorted(data.draw(st.sets(st.integers(1, len(text)), max_size=8)) | {len(text)})
    assert joined(text, ends) == plain([text])[0]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts_in_small_chunks(text):
    for size in (1, 2, 3, 7, 50):
        assert joined(text, [*range(size, len(text), size), len(text)]) == plain([text])[0]


@pytest.mark.parametrize("kind", ["equal", "letters", "digits"])
def test_long_unbroken_texts_take_linear_time(kind):
    """A megabyte without any pretoken end but its own, and a fourth of it: the joins of the whole take little more than four times as long."""
    rng = random.Random(7)
    text = "a" * 1_000_000 if kind == "equal" else "".join(rng.choices("abcdefghij" if kind == "letters" else "0123456789", k=1_000_000))
    took = []
    for part in (text[:250_000], text):
        ends = tokens.cut_points(part)
        chunks = [part[a:b] for a, b in zip([0, *ends], ends)]
        t = tokens.load("byte_bpe_50k")
        pieces = [(c, *p) for c, p in zip(chunks, tokens.encode_parts(t, chunks))]
        began = time.process_time()
        ids = tokens.join_chunks(t, pieces)
        took.append(time.process_time() - began)
        assert ids.tolist() == plain([part])[0]
    assert took[1] < 12 * took[0] + 1


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    passage = "".join(chr(97 + c) for c in rng.integers(0, 26, 5000))
    a, b = passage, "other start " + passage
    cuts = lambda x: {x[s:e] for s, e in zip([0, *tokens.cut_points(x)], tokens.cut_points(x))}
    shared = cuts(a) & cuts(b)
    assert len(shared) > 0.8 * len(cuts(a))
    assert tokens.cut_points("") == [] and tokens.cut_points("x") == [1]
    assert tokens.cut_points("a" * 20_000)[-1] == 20_000
