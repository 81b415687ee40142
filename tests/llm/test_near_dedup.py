"""What is left of a bucket of near copies is not compared in full, and no link is lost."""

import numpy as np

from loomcat.llm import common, near_dedup


def test_strays_of_a_large_group(spark, monkeypatch):
    base = [f"b{i}" for i in range(300)]
    texts = [base]
    for i in range(90):
        words = list(base)
        # Two thirds stay near the base; the others are beyond the threshold of it and of each other.
        for j in np.random.default_rng(i).choice(300, 22 if i % 3 == 0 else 10, replace=False):
            words[j] = f"w{i}x{j}"
        texts.append(words)
    stray = list(texts[1])
    stray[7] = "again"  # linked with a stray only
    rows = [(i, " ".join(x)) for i, x in enumerate([*texts, stray])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    counts, rest = [], near_dedup._rest

    def counted(*args):
        pairs = rest(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_rest", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()}
    strays = [i for i in range(1, 91) if (i - 1) % 3 == 0]
    want = {i: 0 for i in range(91)} | {i: i for i in strays} | {91: 1}
    assert got == want
    assert counts[0] < 0.1 * len(strays) * len(rows)


def rest_counts(monkeypatch):
    counts, rest = [], near_dedup._rest

    def counted(*args):
        pairs = rest(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_rest", counted)
    return counts


def test_what_is_left_to_compare_grows_with_the_documents(spark, monkeypatch):
    counts = rest_counts(monkeypatch)
    rng = np.random.default_rng(3)
    rows = []
    for group in range(120):  # of a few words, so that unrelated groups have shingles in common
        base = rng.integers(0, 30, 60)
        for stray in range(4):
            words = np.where(np.isin(np.arange(60), rng.choice(60, 8 * (stray > 0), replace=False)), 30 + stray, base)
            rows.append((4 * group + stray, " ".join(f"w{x}" for x in words)))
    for n in (120, 480):
        frame = spark.createDataFrame(rows[:n], "doc_id long, text string")
        near_dedup.near_duplicates(frame).collect()
    assert counts[1] < 6 * counts[0] + 100


def test_groups_at_the_threshold_equal_brute_force(spark, monkeypatch):
    counts = rest_counts(monkeypatch)
    rng = np.random.default_rng(4)
    texts = []
    for group in range(12):
        base = [f"g{group}b{i}" for i in range(80)]
        pool = [f"g{group}p{i}" for i in range(4)]
        for _ in range(14):
            words = list(base)
            for j in rng.choice(80, int(rng.integers(1, 14)), replace=False):
                words[j] = str(rng.choice([*pool, ""]))  # replaced by one of a few words, or left out
            texts.append(" ".join(words + base[: int(rng.integers(0, 3))]))
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        before = list(want)
        for i, x in enumerate(sets):
            near = [j for j, y in enumerate(sets[: i + 1]) if 100 * len(x & y) >= 80 * len(x | y)]
            least = min(want[j] for j in near)
            want = [least if w in {want[j] for j in near} else w for w in want]
        if want == before:
            break
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()}
    assert got == dict(enumerate(want))
    assert 12 < len(set(want)) < len(texts) and counts[0] > 0


def test_texts_without_a_bucket_are_not_shuffled(spark, monkeypatch):
    rows = [(i, " ".join(f"t{i}w{j}" for j in range(30))) for i in range(400)]
    rows += [(400 + i, rows[i][1] + " more") for i in range(5)]
    written, write = {}, near_dedup.materialize

    def recorded(table, label):
        written.setdefault(label, table)
        return write(table, label)

    monkeypatch.setattr(near_dedup, "materialize", recorded)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with very many documents
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()}
        plan = written["sets"]._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: i - 400 if i >= 400 else i for i in range(405)}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_rows_among_ids(spark):
    rows = spark.createDataFrame([(i, "x") for i in [*range(-3000, 3000), None]], "k long, v string")
    ids = spark.range(-9000, 9000, 3).unionAll(spark.range(-9, 9, 3))
    want = [(i, "x") for i in range(-3000, 3000, 3)]
    assert sorted(map(tuple, common.among(rows, "k", ids, "ids").collect())) == want
    passed = {r["k"] for r in common.perhaps(rows, "k", ids.distinct()).collect()}
    assert passed >= {k for k, _ in want} and len(passed) < 2000 + 0.15 * 4000
    assert common.among(rows, "k", ids.limit(0), "none").count() == 0
