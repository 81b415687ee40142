"""Line deduplication against brute force over all pairs of lines."""

import numpy as np

from loomcat.llm import lines

SCHEMA = "doc_id long, text string"


def one_word_apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer)))


def brute_force(rows):
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            words = line.lower().split()
            near = len(words) >= lines.MIN_WORDS and any(one_word_apart(words, x) for x in seen)
            if not words or not near and words not in seen:
                kept.append(line)
            if words:
                seen.append(words)
        out[doc_id] = "\n".join(kept)
    return out


def edited(rng, words, pool):
    words, at = list(words), int(rng.integers(0, len(words)))
    kind = rng.integers(0, 3)
    if kind == 0:
        words[at] = str(rng.choice(pool))
    elif kind == 1:
        words.insert(at + int(rng.integers(0, 2)), str(rng.choice(pool)))
    else:
        del words[at]
    return words


def test_near_lines_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = ["a", "b", "c", "De", "f"]
    families = [rng.choice(pool, int(rng.integers(8, 15))).tolist() for _ in range(40)]
    rows = []
    for doc_id in range(150):
        text = []
        for _ in range(int(rng.integers(1, 5))):
            words = families[int(rng.integers(0, len(families)))]
            for _ in range(int(rng.integers(0, 4))):
                words = edited(rng, words, pool)
            text.append(" ".join(words))
        rows.append((doc_id, "\n".join([*text, ""])))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(frame).collect()}
    want = brute_force(rows)
    assert got == want
    assert sum(len(t.split("\n")) for t in want.values()) < 0.8 * sum(len(t.split("\n")) for _, t in rows)


def test_every_edit_at_the_shortest_lengths(spark):
    words = [f"w{i}" for i in range(11)]
    for n in (9, 10, 11):
        base = words[:n]
        edits = [base[:i] + base[i + 1 :] for i in range(n)]
        edits += [base[:i] + ["new"] + base[i + 1 :] for i in range(n)]
        edits += [base[:i] + ["new"] + base[i:] for i in range(n + 1)]
        # One pair of documents for each edit, made of words of its own.
        rows = []
        for k, edit in enumerate(edits):
            rows.append((2 * k, " ".join(f"{x}.{k}" for x in base)))
            rows.append((2 * k + 1, " ".join(f"{x}.{k}" for x in edit)))
        got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
        for k, edit in enumerate(edits):
            assert got[2 * k] and bool(got[2 * k + 1]) == (len(edit) < lines.MIN_WORDS), (n, k)
