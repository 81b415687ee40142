"""Every pair of substitutions in items of 5 to 13 tokens, and windows inside longer items."""

import itertools

import numpy as np

from loomcat.llm import decontaminate


def _found(spark, texts, items):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    frame = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs, frame).collect()}


def _expected(texts, items):
    """All alignments without gaps of all texts and items."""
    out = set()
    for d, text in texts.items():
        for i, item in items.items():
            x, y = text.split(), item.split()
            size = min(len(y), decontaminate.WINDOW)
            for start in range(len(y) - size + 1):
                part = y[start : start + size]
                for at in range(len(x) - size + 1):
                    if 100 * sum(a == b for a, b in zip(x[at : at + size], part, strict=True)) >= 80 * size:
                        out.add((d, i))
    return out


def test_every_pair_of_substitutions(spark):
    items = {n: " ".join(f"i{n}t{k}" for k in range(n)) for n in range(5, 14)}
    texts, d = {}, 0
    for n, item in items.items():
        for places in itertools.chain(*(itertools.combinations(range(n), k) for k in range(4))):
            words = item.split()
            for p in places:
                words[p] = f"s{p}"
            texts[d] = " ".join([*(f"b{k}" for k in range(d % 3)), *words, *(f"a{k}" for k in range(d % 2))])
            d += 1
    want = _expected(texts, items)
    assert set(_found(spark, texts, items)) == want
    assert {i for _, i in want} == set(items) and len(want) < len(texts)


def test_windows_of_long_items(spark):
    item = [f"t{k}" for k in range(30)]
    random = np.random.default_rng(5)
    texts = {}
    for d in range(200):
        start = int(random.integers(0, 18))
        words = [w if start <= k < start + 13 else f"x{k}" for k, w in enumerate(item)]
        for p in random.choice(13, int(random.integers(1, 4)), replace=False):
            words[start + p] = "other"
        texts[d] = " ".join(words)
    items = {1: " ".join(item)}
    want = _expected(texts, items)
    found = _found(spark, texts, items)
    assert set(found) == want and 0 < len(want) < len(texts)
    assert all(r["start"] == 0 for r in found.values())


def test_blocks_give_equal_results(spark, monkeypatch):
    items = {n: " ".join(f"i{n}t{k}" for k in range(n)) for n in (4, 6, 10, 20)}
    texts = {n: "before " + text + " after" for n, text in items.items()}
    whole = set(_found(spark, texts, items))
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    assert set(_found(spark, texts, items)) == whole == {(6, 6), (10, 10), (20, 20)}


def test_very_long_text(spark):
    item = " ".join(f"t{k}" for k in range(12))
    text = " ".join([*(f"w{k}" for k in range(50_000)), item, *(f"v{k}" for k in range(50_000))])
    assert _found(spark, {1: text, 2: "", 3: None}, {1: item, 2: ""})[1, 1]["start"] == 50_000
