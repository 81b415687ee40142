"""Small fixtures for every training-data operator: brute force, odd rows and empty tables."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomcat.llm import bpe, decontaminate, graph, lines, near_dedup, packing, pages, passages, pii, quality
from loomcat.llm import token_counts, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Extra columns bear names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, key long, id string, _row int, h1 string, n long"
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def prose(seed: int, size: int) -> list[str]:
    return np.random.default_rng(seed).choice(VOCABULARY, size).tolist()


A = prose(1, 80)
TEXTS = [
    (0, " ".join(A)),
    (1, " ".join(A)),
    (2, " ".join(A[:40] + ["changed"] + A[41:])),
    (3, None),
    (4, ""),
    (5, "one"),
    (6, "Mail a.b@c.example.org, card 4111 1111 1111 1111, ip 10.0.0.1 and 999.1.1.1\n" + " ".join(prose(2, 60))),
    (7, " ".join(prose(3, 60)) + "\n" + " ".join(A[5:70])),
    (8, "\n".join([" ".join(prose(4, 12))] * 3 + ["", " ".join(prose(4, 11) + ["else"])])),
    (9, " ".join(prose(5, 3000))),
    (9, " ".join(prose(5, 3000))),
    (None, "call me at tel 555-123-4567"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en" if d != 5 else None, None, 7, "x", 1, "y", 2) for d, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    part = A[10:30]
    rows = [(1, " ".join(part[:4] + ["other"] + part[5:12] + ["word"] + part[13:])), (2, None), (3, "too short")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 0, 0), (6, 1, 1), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def by_id(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_quality(docs, none):
    got = by_id(quality.quality_verdicts(docs), "doc_id", "n_words", "n_dup_lines", "n_repeat_words", "kept")
    want = []
    for d, t in TEXTS:
        w = (t or "").split()
        rows = [x for x in (t or "").split("\n") if x.split()]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((d, len(w), len(rows) - len(set(rows)), len(covered), not failed))
    assert got == sorted(want, key=str)
    assert quality.quality_filter(docs).columns == docs.columns
    assert quality.quality_verdicts(none).count() == quality.quality_filter(none).count() == 0


def test_pii(docs, none):
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert [(s["kind"], s["value"]) for s in found[6]["base"]] == [
        ("email", "a.b@c.example.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"),
    ]
    assert [s["kind"] for s in found[None]["spans"]] == ["local_phone"] and not found[3]["spans"]
    assert pii.find_personal_data(none).count() == 0


def test_pii_digits(spark):
    one = spark.createDataFrame([("GB82WEST12345698765432", "4" * 20000)], "iban string, run string")
    assert one.select(pii.mod97(F.col("iban"))).first()[0]
    text = one.select(F.lit(1).alias("doc_id"), F.concat_ws(" é ", "run", F.lit("ü@x.y z@q.w"), "iban").alias("text"))
    row = pii.find_personal_data(text).first()
    assert [(s["kind"], s["start"]) for s in row["spans"]] == [("email", 20009), ("iban", 20017)]


def test_leaks(docs, none, items):
    assert by_id(decontaminate.find_leaks(docs, items), "doc_id", "item_id") == [(0, 1), (1, 1), (2, 1), (7, 1)]
    clean = decontaminate.without_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == 8
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_near_duplicates(docs, none):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[d]["component_id"] for d in (0, 1, 2, 3, 4, 5, 7)] == [0, 0, 0, 3, 4, 5, 7]
    assert got[0]["n_shingles"] == len(set(zip(A, A[1:], strict=False))) and got[5]["n_shingles"] == 1
    assert near_dedup.without_near_duplicates(docs).count() == len(TEXTS) - 2
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    base = prose(11, 300)
    copies = []
    for i in range(120):
        words = list(base)
        for j in np.random.default_rng(i).choice(300, 12, replace=False):
            words[j] = f"w{i}x{j}"
        copies.append((1000 - i, " ".join(words)))
    copies.append((5000, " ".join(base)))
    frame = spark.createDataFrame(copies, "doc_id long, text string")
    sets = {d: set(zip(t.split(), t.split()[1:], strict=False)) for d, t in copies}
    roots = {d: d for d in sets}

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                roots[y] = x
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()}
    assert got == {d: root(d) for d in sets}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_lines(docs, none):
    done = lines.drop_repeated_lines(docs)
    assert done.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    texts = {r["doc_id"]: r["text"] for r in done.collect()}
    assert texts[0] == TEXTS[0][1] and texts[1] == texts[2] == "" and texts[3] is None
    assert texts[8] == " ".join(prose(4, 12)) + "\n" and texts[9] == TEXTS[9][1]
    assert lines.drop_repeated_lines(none).count() == 0


def test_passages(docs, none):
    got = {(r["doc_id"], r["other_id"]): r for r in passages.repeated_passages(docs).collect()}
    assert set(got) == {(1, 0), (2, 0), (7, 0)}
    assert (got[7, 0]["start"], got[7, 0]["end"], got[7, 0]["other_start"]) == (60, 125, 5)
    assert passages.repeated_passages(none).count() == 0


def test_chains_follow_both_texts():
    assert passages.chains([(0, 10), (5, 15), (9, 2), (12, 22)])[0] == (0, 12, 10, 22)


def test_token_counts(docs, none):
    library = Tokenizer.from_file(TOKENIZER)
    got = by_id(token_counts.count_tokens(docs, TOKENIZER), "doc_id", "n_bytes", "n_tokens")
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in TEXTS]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(none, TOKENIZER).count() == 0


def test_packing(docs, none):
    library = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(docs, TOKENIZER).collect()
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in TEXTS}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    total = sum(len(ids[d]) for d, _ in TEXTS)
    assert sum(r["length"] for r in rows) == total
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
    assert packing.pack(none, TOKENIZER).count() == 0


def test_swaps_empty_a_sequence():
    lengths = np.array([6, 4, 5, 5, 3, 3, 4])
    bins = packing.improve([[0, 4], [1, 5], [2, 6], [3]], lengths, 10)
    assert sorted(x for b in bins for x in b) == list(range(7)) and len(bins) == 3
    assert all(lengths[b].sum() <= 10 for b in bins)


def test_toxicity(spark, docs, none, labels):
    got = toxicity.toxicity(docs, labels)
    assert got.count() == len(TEXTS) and not got.filter("score is null or score < 0 or score > 1").count()
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_learns():
    texts = [" ".join([*prose(i, 40), "vile" + VOCABULARY[i % 9]] if i % 4 == 0 else prose(i, 41)) for i in range(600)]
    marks = np.array([i % 4 == 0 for i in range(600)], float)
    at, weights = toxicity.train(texts[:500], marks[:500])
    dense = dict(zip(at.tolist(), weights.tolist(), strict=True))
    for text, mark in zip(texts[500:], marks[500:], strict=True):
        _, places = toxicity.features([text] if False else __import__("pyarrow").array([text]))
        total = dense[toxicity.BIAS] + sum(dense.get(p, 0.0) for p in set(places.tolist()))
        assert (total > 0) == (mark > 0)


def test_pages(spark):
    head = "<div>Open menu<br>here</div><p>Site name</p>"
    rows = [
        (1, "http://a.example/x/1", f"{head}<p>First &amp; only</p><p>Same end</p>"),
        (2, "http://a.example/x/2?q=1", f"{head}<p>Second <b>te</b>xt<p>Same end"),
        (3, "http://b.example/", "<nav>Menu</nav><article><h1>T</h1><p>Same end</p></article><p>Site name</p>"),
        (4, None, None),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows + rows[:1]], "page_id long, url string, html string, path string")
    got = by_id(pages.extract_main_text(frame), "page_id", "text", "n_chars")
    assert got == [
        (1, "First & only", 12), (1, "First & only", 12), (2, "Second text", 11), (3, "T\n\nSame end", 11), (4, "", 0),
    ]
    assert pages.extract_main_text(frame.limit(0)).count() == 0


def test_common_lines():
    assert pages.common_lines([1, 2, 3, 4, 2], [2, 4, 3, 2]) in ([1, 2, 4], [1, 3, 4])


def test_bpe_agrees_with_the_library():
    tokens, library = bpe.PreTokens(open(TOKENIZER).read()), Tokenizer.from_file(TOKENIZER)
    for text in ["", " ", "a  b　\xa0c", "it's <|endoftext|> x<|endoftext|>", "\x1c\x1d a\x85b", "日本 ١٢ ½²", "'ll''ll \t x"]:
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert re.fullmatch("[0-9]+", str(zlib.crc32(b"")))
