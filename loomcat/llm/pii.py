"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Base kinds are e-mail and network addresses, payment cards (Luhn) and international phone numbers;
they are always reported. Two more kinds are added by the method: account numbers (``iban``,
mod-97) and national phone numbers (``local_phone``), which have no checksum and are reported only
if a context word stands close before them and no base span overlaps them.

Native throughout. A pattern is run over ``gap, match, gap, match ...``; the lengths of these pieces
give the places, in code points. Runs of equal characters are entered at their start only and never
given back, so that searching a text takes linear time; n matches take n log n for their places. NULL and empty texts have no spans; equal
rows are treated alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcat.llm.common import let

NEAR = 40  # characters before a span in which a context word counts
PART = 512  # characters of the parts from which context is taken; more than NEAR
ACCEPT = 0.6  # score from which a span without a checksum is reported

# What precedes personal data, by kind.
CONTEXT = {
    "email": "e-?mail|mailto|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse|dirección",
    "card": r"card|visa|credit|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|fax|mobile|handy|teléfono|téléphone",
    "iban": r"iban|account|konto|cuenta|compte",
    "local_phone": r"phone|\btel|call|fax|mobile|handy|teléfono|téléphone",
}
# Score without a context word.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "local_phone": 0.4}
RAISE = 0.3

_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: By kind: a quick test for texts worth a full search, and the pattern.
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (
        r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    ),
    # A chain of digits has one separator at most between two of them; it is taken whole.
    "card": (
        "[0-9](?:[ -]?[0-9]){15}",
        "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+",
    ),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (
        "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
        "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    ),
    "local_phone": (
        r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
        r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    ),
}
KINDS = ["email", "ip", "card", "phone"]
ADDED = ["iban", "local_phone"]
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    odd = F.length(digits) % 2
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a
        + let(
            F.substring(digits, i, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == odd, d).otherwise(
                F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            ),
        ),
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (letters and digits only) leaves 1 when divided by 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c == "", a)
        .when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97)
        .otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        return F.when(size.between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return size.between(8, 15)
    if kind == "iban":
        plain = F.regexp_replace(value, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _running(sizes: Column) -> Column:
    """Running totals of an array, by adding over distances of 1, 2, 4 ... places."""
    rounds = F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(1)))).cast("int")
    steps = F.slice(F.array(*[F.lit(2**k) for k in range(31)]), F.lit(1), rounds)
    return F.aggregate(
        steps, sizes, lambda a, step: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - step), F.lit(0)))
    )


def _find(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind, in order."""
    test, pattern = PATTERNS[kind]
    worth = F.contains(text, F.lit(test)) if test == "@" else text.rlike(test)
    whole = F.lit(rf"(?s)(.*?)({pattern}|\z)")

    def placed(gaps: Column, values: Column) -> Column:
        ends = _running(F.zip_with(gaps, values, lambda g, v: F.length(g) + F.length(v)))
        spans = F.zip_with(
            values,
            ends,
            lambda v, e: F.struct(
                F.lit(kind).alias("kind"), (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")
            ),
        )
        return F.filter(
            spans,
            lambda s: F.when(F.length(s["value"]) > 0, _confirmed(kind, s["value"])).otherwise(False),
        )

    found = let(
        F.regexp_extract_all(text, whole, F.lit(1)),
        lambda gaps: let(
            F.regexp_extract_all(text, whole, F.lit(2)), lambda values: placed(gaps, values)
        ),
    )
    return F.when(worth, found).otherwise(F.array().cast(_SPANS))


def _score(parts: Column, span: Column, kinds: list[str]) -> Column:
    start = span["start"]
    begin = F.greatest(start - NEAR, F.lit(0))
    n = F.floor(begin / PART).cast("int")
    both = F.concat(F.coalesce(F.get(parts, n), F.lit("")), F.coalesce(F.get(parts, n + 1), F.lit("")))
    before = F.lower(F.substring(both, begin - n * PART + 1, start - begin))

    def scored(context: Column) -> Column:
        score = F.lit(None).cast("double")
        for kind in kinds:
            raised = F.when(context.rlike(CONTEXT[kind]), min(1.0, PRIOR[kind] + RAISE))
            score = F.when(span["kind"] == kind, raised.otherwise(PRIOR[kind])).otherwise(score)
        return score

    return let(before, scored)


def _scored(text: Column, spans: Column, kinds: list[str]) -> Column:
    # Parts, because a place in a text is found by counting its characters from the front.
    whole = F.when(F.size(spans) > 0, text).otherwise("")
    return let(
        F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)),
        lambda parts: F.transform(
            spans,
            lambda s: F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                s["value"].alias("value"), _score(parts, s, kinds).alias("score"),
            ),
        ),
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: ``base`` spans and all ``spans`` (kind, start, end, value, score).

    Spans of one kind do not overlap, and are ordered by kind, then start.
    """
    text = F.col("_text")
    base = F.concat(*[_find(k, text) for k in KINDS])
    added = F.concat(*[_find(k, text) for k in ADDED])

    def apart(span: Column, others: Column) -> Column:
        return ~F.exists(others, lambda o: (span["start"] < o["end"]) & (o["start"] < span["end"]))

    return (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
        .withColumns({"_base": base, "_added": added})
        .withColumns(
            {
                "base": _scored(text, F.col("_base"), KINDS),
                "_added": F.filter(
                    _scored(text, F.col("_added"), ADDED),
                    lambda s: (s["score"] >= ACCEPT) & apart(s, F.col("_base")),
                ),
            }
        )
        .select("doc_id", "base", F.concat("base", "_added").alias("spans"))
    )


def digest(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
