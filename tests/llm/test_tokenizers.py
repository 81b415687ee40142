"""Word BPE and the alignment of two tokenizers against the libraries and brute force."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomcat.llm import alignment, word_bpe
from loomcat.llm.byte_bpe import ByteBpe, vocabulary
from loomcat.llm.queries import PIECES, QUERIES, TOKENIZER, WORDS

# Extra columns bear names that the operators use themselves.
SCHEMA = "doc_id long, text string, key string, copies int, ids string, n long, code int, often int"
TEXTS = [
    (0, "The quick brown fox doesn't jump over 12 lazy dogs."),
    (1, "The quick brown fox doesn't jump over 12 lazy dogs."),
    (2, "the quick  brown\n\tfox, naïve CAFÉ İstanbul, 日本語 😀 3½² <|endoftext|> <s> <unk>"),
    (3, None),
    (4, ""),
    (5, "x"),
    (6, "a marked▁space is not given back"),
    (7, "  leading and trailing  "),
    (8, "word" * 4000 + " " + "é" * 700 + " <|startoftext|>"),
    (9, "The quick brown dog"),
    (9, "The quick brown dog"),
    (None, "No id, but a text."),
    (10, " ".join(f"fox{i % 97} quick" for i in range(4000))),
]


def odd_texts():
    draw = random.Random(12)
    alphabet = "abcdeé'’ \n1٣²<|>ñßÅΩÅ▁日"
    made = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(400)]
    return made + [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}'s" for c in range(1, 0x250)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "k", 3, "i", 4, 5, 6) for d, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.mark.parametrize("scanned", [word_bpe.SCANNED, 0])
def test_word_ids_are_the_librarys(monkeypatch, scanned):
    monkeypatch.setattr(word_bpe, "SCANNED", scanned)
    with open(WORDS, encoding="utf-8") as file:
        ours = word_bpe.WordBpe(file.read())
    known = library(WORDS)
    for text in odd_texts() + [t or "" for _, t in TEXTS]:
        ids = known.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == known.decode(ids, skip_special_tokens=False), text


def test_words_forgotten_are_encoded_again(monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHED", 2)
    with open(WORDS, encoding="utf-8") as file:
        ours = word_bpe.WordBpe(file.read())
    text = "one two three four two one " * 3
    assert ours.encode(text) == library(WORDS).encode(text, add_special_tokens=False).ids


def test_encode(docs, none):
    known = library(WORDS)
    expected = []
    for doc_id, text in TEXTS:
        ids = known.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, ids, known.decode(ids, skip_special_tokens=False)))
    got = [(r["doc_id"], r["ids"], r["decoded"]) for r in word_bpe.encode(docs, WORDS, decoded=True).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert word_bpe.encode(docs, WORDS).columns == ["doc_id", "ids"]
    assert word_bpe.encode(none, WORDS, decoded=True).collect() == []


def test_other_kinds_are_refused():
    with open(TOKENIZER, encoding="utf-8") as file, pytest.raises(ValueError, match="byte-pair"):
        word_bpe.WordBpe(file.read())


@pytest.mark.parametrize("special", [True, False])
def test_byte_ids_are_the_librarys(special):
    with open(TOKENIZER, encoding="utf-8") as file:
        ours = ByteBpe(file.read(), special=special)
    known = library(TOKENIZER)
    known.encode_special_tokens = not special
    for text in odd_texts() + [t or "" for _, t in TEXTS]:
        assert ours.encode(text) == known.encode(text, add_special_tokens=False).ids, text


def brute_force(texts):
    """Rows of the alignment by comparing all tokens of a text with each other."""
    with open(TOKENIZER, encoding="utf-8") as file:
        of_a = {i: b for b, i in vocabulary(file.read()).items()}
    first, second = library(TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True

    def of_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(tokens):
        out, at = [], 0
        for token in tokens:
            out.append((at, at + len(token)))
            at += len(token)
        return out

    found = []
    for _, text in texts:
        if not text:
            found.append(None)
            continue
        whole = f" {text}".encode()
        a, b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)
        raw_a, raw_b = [of_a[i] for i in a], [of_b(i) for i in b]
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            found.append(None)
            continue
        at_a, at_b = spans(raw_a), spans(raw_b)
        links = Counter()
        low = 0
        for i, (s, e) in enumerate(at_a):
            while at_b[low][1] <= s:
                low += 1
            for j in range(low, len(b)):
                if at_b[j][0] >= e:
                    break
                links[a[i], b[j]] += 1
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, begin = [], 0
        parts_a, parts_b = defaultdict(list), defaultdict(list)
        ends = {c: n for n, c in enumerate(cuts)}
        for ids, places, parts in ((a, at_a, parts_a), (b, at_b, parts_b)):
            n = 0
            for i, (_, e) in zip(ids, places, strict=True):
                parts[n].append(str(i))
                n += e in ends
        for n in range(len(cuts)):
            groups.append(",".join(parts_a[n]) + "|" + ",".join(parts_b[n]))
        found.append((len(a), len(b), len(cuts), links, ";".join(groups)))
        assert begin == 0
    counts = Counter()
    for row in found:
        if row:
            counts.update(row[3].keys())
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, _), row in zip(texts, found, strict=True):
        if row is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = row[3]
        best = sum(t for p, t in links.items() if counts[p] == most[p[0]])
        out.append((doc_id, *row[:3], sum(links.values()), best, sum(t * counts[p] for p, t in links.items()), row[4]))
    return sorted(out, key=str)


# All pairs in the workers; some joined; all joined. Hot texts by broadcast, or none.
@pytest.mark.parametrize("frequent,shares", [(1 << 19, 1000), (40, 8), (0, 1)])
def test_align(docs, frequent, shares):
    rows = alignment.align(docs, TOKENIZER, PIECES, frequent=frequent, shares=shares).collect()
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == brute_force(TEXTS)


def test_align_nothing(none, spark):
    assert alignment.align(none, TOKENIZER, PIECES).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    rows = alignment.align(blank, TOKENIZER, PIECES).collect()
    assert sorted((r["doc_id"], r["n_a"], r["groups"]) for r in rows) == [(1, 0, ""), (2, 0, ""), (2, 0, "")]


def test_queries_give_digests(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    aligned = QUERIES["op11_cross_tokenizer_alignment"](spark, path)
    full = spark.createDataFrame(
        brute_force(TEXTS), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, g string"
    ).select("*", F.when(F.col("g") == "", "").otherwise(F.sha2("g", 256)).alias("groups_sha256")).drop("g")
    assert sorted(map(str, aligned.collect())) == sorted(map(str, full.collect()))
    encoded = QUERIES["op12_word_bpe"](spark, path).filter("doc_id = 4").first()
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing
    assert tuple(encoded) == (4, 0, empty, empty)


def test_tokenizer_paths_come_from_the_package():
    assert public_tokenizers.path("word_bpe_49k.json") == WORDS
