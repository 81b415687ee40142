"""Places of spans against Python's patterns, and many spans in one text."""

import re
import time

from loomcat.llm import pii

# The base patterns as the contract states them.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": "[0-9]([\\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _right(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def _stated(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in STATED.items()
        for m in re.finditer(pattern, text)
        if _right(kind, m[0])
    ]


def _base(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find_personal_data(frame).collect()
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in rows}


def test_base_spans(spark):
    texts = [
        "a@b.c, x.y+z@q-r.s.t..u@v.w @@ a@b @c.d é😀 m@n.o",
        "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.0004 1.2.3.300 9.9.9.9",
        "4111 1111 1111 1111, 4111-1111-1111-1111; 4111111111111112. 4111  1111 1111 1111 1234567",
        "+1 (555) 123-4567 +12 +1234567 ++49 30 901820 +1-2-3-4-5-6-7-8-9 x+44",
        "\n\t", "", "plain words only",
    ]
    got = _base(spark, texts)
    assert got == {i: _stated(t) for i, t in enumerate(texts)}
    assert [len(got[i]) for i in range(4)] == [4, 4, 2, 3]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{k}@é.x m{k}@n.org" for k in range(40_000))
    begin = time.time()
    assert _base(spark, [text]) == {0: _stated(text)}
    assert time.time() - begin < 60  # adding to an array match by match took 22 s for 32,000
