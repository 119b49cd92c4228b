import random
import re

import numpy as np

from stratafile.llm import leaks


def tables(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def brute(docs, items, n=13):
    out = set()
    for i, t in items:
        w = leaks.words_of(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, x in docs:
            v = leaks.words_of(x)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ITEM = " ".join(f"word{i}" for i in range(20))


def test_words():
    assert leaks.words_of("Ｆｕｌｌ ﬁne\u200bly don't x_y ½ Straße\u00adn") == ["full", "finely", "don", "t", "x", "y", "1", "2", "straßen"]
    assert leaks.words_of(None) == leaks.words_of("") == leaks.words_of("--") == []


def test_thirteen_words_in_a_row(spark):
    w = ITEM.split()
    docs = [(1, "x " + " ".join(w[:13])), (2, " ".join(w[:12])), (3, "\n".join(w[7:]).upper() + "!"), (4, " ".join(w[:6] + ["y"] + w[6:12])), (5, None), (6, ""), (7, " ".join(f"{a}\u200b," for a in w)), (7, ITEM), (8, "a" * 200_000 + " " + ITEM), (None, None)]
    items = [(10, ITEM), (11, ITEM), (12, " ".join(w[:12])), (13, None), (14, ""), (None, ITEM)]
    d, b = tables(spark, docs, items)
    want = {(i, j) for i in (1, 3, 7, 8) for j in (10, 11)}
    assert found(leaks.leaked_items(d, b)) == want
    assert found(leaks.leaked_items(d, b, block_bytes=24)) == want


def test_against_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    items = [(i, text(rng.randrange(30))) for i in range(20)]
    for n in (1, 2, 5, 8, 13):
        d, b = tables(spark, docs, items)
        want = brute(docs, items, n)
        assert found(leaks.leaked_items(d, b, n)) == want
        assert found(leaks.leaked_items(d, b, n, block_bytes=3000)) == want


def test_window_hashes_depend_on_order():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, 100).astype(np.uint64)
    for n in (1, 2, 3, 7, 13, 16):
        h = leaks.window_hashes(w, n)
        assert len(h) == 100 - n + 1 and len(np.unique(h)) == len(h)
        assert (leaks.window_hashes(w[5 : 5 + n], n) == h[5]).all()
    assert leaks.window_hashes(w, 2)[0] != leaks.window_hashes(w[[1, 0]], 2)[0]


def test_passages_are_taken_out(spark):
    d, b = tables(spark, [(1, f"Before.  {ITEM}! After it"), (2, "clean\ttext"), (3, None), (4, "")], [(1, ITEM)])
    assert {r.doc_id: r.text for r in leaks.without_leaks(d, b).collect()} == {1: "Before.   After it", 2: "clean\ttext", 3: None, 4: ""}


def test_empty_and_clashing(spark):
    d, b = tables(spark, [(1, ITEM)], [(1, ITEM)])
    assert leaks.leaked_items(d.limit(0), b).count() == 0
    assert leaks.leaked_items(d, b.limit(0)).count() == 0
    clash = d.selectExpr("*", "'x' AS TEXT", "5 AS item_id", "6 AS h")
    assert found(leaks.leaked_items(clash, b.selectExpr("*", "1 AS doc_id"))) == {(1, 1)}


def cut_by_hand(text, items, n):
    """Word by word, as the docstring has it."""
    parts = re.split(r"([ \t\r\n]+)", text)
    words = [(w, i) for i, p in enumerate(parts) for w in leaks.words_of(p)]
    grams = {tuple(v[k : k + n]) for _, x in items for v in [leaks.words_of(x)] for k in range(len(v) - n + 1)}
    gone = set()
    for k in range(len(words) - n + 1):
        if tuple(w for w, _ in words[k : k + n]) in grams:
            gone |= set(range(words[k][1], words[k + n - 1][1] + 1))
    return "".join(p for i, p in enumerate(parts) if i not in gone)


def test_clean_texts_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["a", "b", "c", "a-b", "\u00bd"]) + rng.choice([" ", "  ", "\n", ", "]) for _ in range(n))
    docs, items = [(i % 40, text(rng.randrange(60))) for i in range(60)], [(i, text(rng.randrange(20))) for i in range(15)]
    d, b = tables(spark, docs, items)
    for n in (1, 4, 7):
        want = sorted((i, cut_by_hand(t, items, n)) for i, t in docs)
        for block in (leaks.BLOCK_BYTES, 200):
            assert sorted(tuple(r) for r in leaks.without_leaks(d, b, n, block).collect()) == want


def test_short_texts_that_become_many_words(spark):
    """One character may become a word and its end, or several words."""
    texts = ["".join(chr(0x2488 + i) for i in range(13)), "\ufdfa" * 4, "\u00bd " * 7, " ".join(f"{i}." for i in range(1, 14))]
    docs, items = list(enumerate(texts)), [(10 + i, t) for i, t in enumerate(texts)]
    d, b = tables(spark, docs, items)
    want = brute(docs, items)
    assert {(0, 10), (0, 13), (1, 11), (2, 12)} <= want
    assert found(leaks.leaked_items(d, b)) == want
    clean = {r.doc_id: r.text for r in leaks.without_leaks(d, b).collect()}
    assert clean[0] == "" and clean[1] == "" and leaks.words_of(clean[3]) == []


def test_a_passage_that_most_documents_and_items_hold(spark, monkeypatch):
    monkeypatch.setattr("stratafile.operators.common.is_small", lambda *_: False)
    docs = [(i, f"x{i} {ITEM}" if i % 3 else f"y{i} " + " ".join(f"w{i}_{k}" for k in range(15))) for i in range(900)]
    items = [(i, f"{ITEM} z{i}") for i in range(6)] + [(9, docs[0][1])]
    d, b = tables(spark, docs, items)
    assert found(leaks.leaked_items(d, b)) == brute(docs, items)
