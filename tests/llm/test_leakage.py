import random
import re

import pytest

from siftmill.llm import leakage as lk

DOC, ITEM = "doc_id long, text string, item_id long", "item_id long, text string, doc_id long"


def brute(docs, items, n=12):
    w = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = {}
    for i, t, *_ in items:
        x = w(t)
        for k in range(len(x) - n + 1):
            grams.setdefault(tuple(x[k : k + n]), set()).add(i)
    return {(d, i) for d, t, *_ in docs for x in [w(t)] for k in range(len(x) - n + 1) for i in grams.get(tuple(x[k : k + n]), ())}


def run(spark, docs, items):
    got = [(r.doc_id, r.item_id) for r in lk.find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()]
    assert len(got) == len(set(got))
    return set(got)


WORDS = [f"w{i}" for i in range(30)]


@pytest.mark.parametrize("chunk", [50, 4_000_000])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lk, "CHUNK", chunk)
    r = random.Random(7)
    items = [(i, " ".join(r.choices(WORDS, k=20)), 0) for i in range(20)] + [(50, "", 0), (51, None, 0), (52, "a b c", 0)]
    items.append((53, items[0][1], 0))
    docs = [(1, "", 0), (2, None, 0), (3, "...", 0)]
    for d in range(10, 60):
        x = r.choices(WORDS, k=r.randrange(60))
        if d % 2:
            t = items[r.randrange(20)][1].split()
            n = r.randrange(10, 16)
            at = r.randrange(len(t) - n + 1)
            x += t[at : at + n]
        docs.append((d, r.choice([" ", ", ", "\n- ", " É ", " ü"]).join(x).upper(), 0))
    docs.append((99, items[3][1] + " x " * 200_000, 0))
    docs.append((10, items[4][1], 0))
    want = brute(docs, items)
    assert len(want) > 10 and run(spark, docs, items) == want


def test_texts_do_not_run_together(spark):
    item = " ".join(WORDS[:12])
    docs = [(1, " ".join(WORDS[:6]), 0), (2, " ".join(WORDS[6:12]), 0)]
    assert run(spark, docs, [(1, item, 0)]) == set()
    assert run(spark, [], [(1, item, 0)]) == run(spark, docs, []) == set()


def test_odd_letters(spark):
    item = " ".join(WORDS[:12])
    docs = [(1, "İ İ " + item.upper(), 0), (2, item.replace("w3", "K3"), 0), (3, item.replace(" ", "ß"), 0)]
    assert run(spark, docs, [(1, item, 0)]) == brute(docs, [(1, item)])


def test_spans_are_removed(spark):
    item = " ".join(WORDS[:14])
    docs = [(1, "İ before. " + item.upper() + ", after", 0), (2, None, 0), (3, "clean", 0), (4, item, 0)]
    got = {r.doc_id: (r.text, r.chars_removed) for r in lk.remove_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, item, 0)], ITEM), mark="*").collect()}
    assert got == {1: ("İ before. *, after", len(item)), 2: (None, 0), 3: ("clean", 0), 4: ("*", len(item))}


def test_item_sets_are_split_by_size(spark, monkeypatch):
    items = [(i, " ".join(f"v{i}{j}" for j in range(13)), 0) for i in range(4)]
    docs = [(i, items[i][1], 0) for i in range(4)]
    monkeypatch.setattr(lk, "MAX_SET_BYTES", 400)
    assert len(lk.ngram_sets(spark, spark.createDataFrame(items, ITEM))) == 4
    assert run(spark, docs, items) == {(i, i) for i in range(4)}


def test_one_long_item_is_split_without_losing_a_window(spark, monkeypatch):
    r = random.Random(3)
    text = " ".join(f"u{r.randrange(10**6)}" for _ in range(200))
    words = text.split()
    docs = [(k, " ".join(words[k : k + 12]), 0) for k in range(189)]
    monkeypatch.setattr(lk, "MAX_SET_BYTES", 1000)
    assert len(lk.ngram_sets(spark, spark.createDataFrame([(1, text, 0)], ITEM))) > 3
    assert run(spark, docs, [(1, text, 0)]) == {(k, 1) for k in range(189)}


@pytest.mark.parametrize("broadcast", [0, 32_000_000])
def test_what_is_cut_does_not_depend_on_the_split(spark, monkeypatch, broadcast):
    first, second = " ".join(WORDS[:14]), " ".join(WORDS[8:22])  # they overlap in the document
    items = [(1, first, 0), (2, second, 0)]
    docs = [(1, "before " + " ".join(WORDS[:22]) + " after", 0), (1, "before " + " ".join(WORDS[:22]) + " after", 0), (2, None, 0), (3, "clean", 0), (4, "", 0)]
    clean = lambda: sorted((tuple(r) for r in lk.remove_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), mark="*").collect()), key=repr)
    whole = clean()
    monkeypatch.setattr(lk, "MAX_SET_BYTES", 450)
    monkeypatch.setattr(lk, "MAX_SPAN_BYTES", broadcast)
    assert len(lk.ngram_sets(spark, spark.createDataFrame(items, ITEM))) == 2
    n = len(" ".join(WORDS[:22]))
    assert clean() == whole == sorted([(1, "before * after", n), (1, "before * after", n), (2, None, 0), (3, "clean", 0), (4, "", 0)], key=repr)


def test_a_set_takes_no_more_than_it_is_reckoned(spark):
    r = random.Random(5)
    items = [(i, " ".join(f"w{r.randrange(10**4)}" for _ in range(500)).encode()) for i in range(400)]
    reckoned = sum(b for _, t in items for _, b in lk._pieces(t, 12, 10**9))
    assert lk.NgramSet(items).nbytes() <= reckoned + (1 << 16)
