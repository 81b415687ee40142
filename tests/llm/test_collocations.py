"""Collocations against brute force over all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomcat.llm import collocations as module

# Extra columns bear names that the operator uses itself.
SCHEMA = "lang string, text string, shard string, n int, phrase string, words int, last int"
COMMON = ["The", "of", "ça", "x", "É", "new", "york", "a\x00b"]


def brute_force(rows, threshold, top):
    counts, totals, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            of_lang = counts.setdefault(lang, Counter())
            for k in range(1, 6):
                of_lang.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        within = {
            p[i : i + k]
            for p, a in candidates.items()
            for k in range(2, len(p))
            for i in range(len(p) - k + 1)
            if 100 * a >= 100 * candidates[p[i : i + k]]
        }
        ranked = []
        for p, a in candidates.items():
            if p not in within:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    vocabulary = COMMON + [f"w{i}" for i in range(40)]
    gaps = [" "] * 8 + ["  ", "\t", ". ", "\n", ",", "!", " \r\n"]
    out = []
    for _ in range(300):
        words = [draw.choice(COMMON if draw.random() < 0.6 else vocabulary) for _ in range(draw.randint(0, 120))]
        text = "".join(w + draw.choice(gaps) for w in words)
        if draw.random() < 0.4:
            text += " once upon a time there was"
        out.append((draw.choice(["en", "de", None, "und"]), text))
    out += [("en", None), ("en", ""), ("zz", " .. "), ("", "of " * 300), ("en", "once upon a time there was " * 5000)] * 2
    return out


# Many shards, one shard, few slots that many phrases share, a threshold that nothing reaches.
@pytest.mark.parametrize("threshold,shards,slots", [(20, 4, 1 << 16), (20, 3, 16), (50, 1, 1 << 12), (10**6, 2, 64)])
def test_collocations(spark, rows, threshold, shards, slots):
    frame = spark.createDataFrame([(*r, "s", 1, "p", 2, 3) for r in rows], SCHEMA).repartition(3)
    found = module.collocations(frame, threshold, 30, shards, slots)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_force(rows, threshold, 30)


def test_nothing(spark):
    assert module.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_beyond_64_bits(spark):
    """Products of counts pass 64 bits; the score must stay exact."""
    big = 3 * 10**9
    rows = [("en", "", big * 4), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 1)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, n long")
    found = module.scored(counts, 10).first()
    assert found["score"] == 1000 * (big - 1) * (big * 4) // (big * (big + 1))


def test_a_phrase_counts_by_hash_and_then_by_its_words():
    """Both parts reached at step 0: by hash in one full cycle; reached itself: by its words in the next."""
    texts, langs = [b"New York, new\tyork city"], ["en"]
    table = np.full(1 << 10, 255, np.uint8)
    hashed, exact = module.count_phrases(texts, langs, table, 0, 2)
    (keys, n, last), = hashed  # three words
    assert sorted(n.to_pylist()) == [1, 2, 2] and set(last.to_pylist()) == {1}
    assert [(x[1].to_pylist(), x[2].to_pylist()) for x in exact] == [([""], [5])]
    table[np.mod(keys.to_numpy(), 1 << 10)] = 0
    for step in (1, 2):
        hashed, exact = module.count_phrases(texts, langs, table, step, 2)
        pairs, n, last = hashed[-1]
        assert sorted(n.to_pylist()) == [1, 2] and set(last.to_pylist()) == {2}
        words = {p: k for x in exact for p, k in zip(x[1].to_pylist(), x[2].to_pylist(), strict=True) if p}
        assert words == {"new": 2, "york": 2, "city": 1}
    table[np.mod(pairs.to_numpy()[n.to_numpy() == 2], 1 << 10)] = 2
    hashed, exact = module.count_phrases(texts, langs, table, 3, 2)
    assert hashed == [] and [(x[1].to_pylist(), x[2].to_pylist()) for x in exact] == [(["new york"], [2])]
    assert module.count_phrases(texts, langs, table, 5, 2) == ([], [])
