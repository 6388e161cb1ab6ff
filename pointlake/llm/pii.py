"""Personal data by regular expressions, checksums and context, from Spark expressions only.

A kind's expression proposes spans (leftmost, not overlapping).  A validator confirms them: Luhn for
cards, mod-97 for IBANs, value ranges for addresses, digit counts for phones.  Words near a span raise
its score.  Spans of the base kinds (email, ip, card, phone) stay whatever their score; other kinds
(iban, local phone, ssn) need ``min_score`` and must not touch a base span.

Positions come without a search per match: the text is split at the matches, and the lengths of
the pieces add up (in blocks, so that a text with very many matches stays linear).  The expressions
are written so that no token is scanned once per start position (possessive runs, a match begins where
a run begins or the last match ended), which keeps very long tokens linear as well.  Everything is
a narrow projection; no row meets another.

Defined results: a NULL text counts as empty and has no spans; positions count code points; repeated
rows and other columns play no part; outputs replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.vectors import let

MIN_SCORE = 0.6
BLOCK = 256
NEAR = 40


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Checksum of card numbers: every second digit from the right is doubled, its digits added."""
    def weigh(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: weigh(F.ascii(c) - 48, i))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97(hit: Column) -> Column:
    """Checksum of IBANs: the first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(hit, F.lit(" "))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97
    return F.aggregate(turned, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    base: bool
    pattern: str
    gate: str  # a text without a match of this has no span
    score: float
    context: str
    sign: str

    def valid(self, hit: Column) -> Column:
        if self.name == "ip":
            return hit.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
        if self.name == "card":
            return F.length(_digits(hit)).between(14, 19) & luhn(_digits(hit))
        if self.name == "phone":
            return F.length(_digits(hit)).between(10, 15)
        if self.name == "iban":
            return F.length(F.replace(hit, F.lit(" "))).between(15, 34) & mod97(hit)
        return F.lit(True)


#: Fixed order: base kinds as listed in the results, then the added ones.
KINDS = (
    Kind("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write", "[EMAIL]"),
    Kind("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.7, "ip|host|server|address|login", "[IP]"),
    Kind("card", True, r"[0-9](?:[ -]?[0-9]){13,}+", r"[0-9](?:[ -]?[0-9]){13}", 0.9, "card|visa|credit|payment", "[CARD]"),
    Kind("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|tel|mobile|fax", "[PHONE]"),
    Kind("iban", False, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.8, "iban|account|bank", "[IBAN]"),
    Kind("local_phone", False, r"(?<![0-9+().-])(?<![0-9+][ -])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])", r"[0-9]{3}[-. ][0-9]{4}", 0.4, "phone|call|tel|mobile|fax", "[PHONE]"),
    Kind("ssn", False, r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, "ssn|social security", "[SSN]"),
)
CONTEXT_GAIN = 0.3


def _empty(ddl: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<struct<{ddl}>>")


def _in_blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


SPAN = "start: int, rank: int, end: int, score: double"


def _locate(kind: Kind, rank: int, zipped: Column) -> Column:
    """Spans of the confirmed matches in one block of ``(before, hit, after)``, from a given position."""
    def length(z: Column) -> Column:
        return F.length(z["before"]) + F.length(z["hit"])

    def fold(block: Column, offset: Column) -> Column:
        def step(acc: Column, z: Column) -> Column:
            near = F.lower(F.concat_ws(" ", F.right(z["before"], F.lit(NEAR)), F.left(z["after"], F.lit(NEAR))))
            gain = F.when(near.rlike(kind.context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
            span = F.struct((acc["at"] + F.length(z["before"])).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + length(z)).alias("end"),
                            F.least(F.lit(kind.score) + gain, F.lit(1.0)).alias("score"))
            return F.struct((acc["at"] + length(z)).alias("at"), F.when(kind.valid(z["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(block, F.struct(offset.alias("at"), _empty(SPAN).alias("out")), step, lambda acc: acc["out"])

    def place(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, z: s + length(z)))
        return let(sizes, lambda own: F.flatten(F.transform(parts, lambda p, i: fold(p, F.aggregate(F.slice(own, F.lit(1), i), F.lit(0), lambda s, n: s + n)))))
    return F.when(F.size(zipped) > 0, let(_in_blocks(zipped), place)).otherwise(_empty(SPAN))


def find_spans(df: DataFrame, text: str = "text", out: str = "spans", min_score: float = MIN_SCORE) -> DataFrame:
    """Add the sorted spans: ``array<struct<kind, start, end, score, base>>``."""
    rest = [c for c in df.columns if c != out]
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    cut = held.select("*", *[F.when(F.col("t").rlike(k.gate), F.struct(F.split("t", k.pattern, -1).alias("gaps"), F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0)).alias("hits")))
                             .otherwise(F.struct(none.alias("gaps"), none.alias("hits"))).alias(k.name) for k in KINDS])
    zipped = cut.select("rest", *[F.arrays_zip(F.slice(f"{k.name}.gaps", F.lit(1), F.size(f"{k.name}.hits")).alias("before"), F.col(f"{k.name}.hits").alias("hit"),
                                               F.slice(f"{k.name}.gaps", F.lit(2), F.size(f"{k.name}.hits")).alias("after")).alias(k.name) for k in KINDS])
    found = zipped.select("rest", *[_locate(k, r, F.col(k.name)).alias(k.name) for r, k in enumerate(KINDS)])
    base = [k.name for k in KINDS if k.base]
    more = [k.name for k in KINDS if not k.base]
    both = found.select("rest", F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.filter(F.concat(*more), lambda s: s["score"] >= min_score)).alias("more"))
    free = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    spans = F.transform(F.array_sort(F.concat("base", free)), lambda s: F.struct(
        F.element_at(names, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), (s["rank"] < len(base)).alias("base")))
    return both.select("rest", spans.alias(out)).select("rest.*", out)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind's sign; of overlapping spans the first stands for all.
    A span that begins at or after the furthest end so far (``from``) opens a run; the text between runs is cut out
    of the piece of text that its block of runs covers, so time stays linear in very long texts."""
    def opening(part: Column, furthest: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            run = F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), acc["at"].alias("from")))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], run)).otherwise(acc["out"]).alias("out"))
        return F.aggregate(part, F.struct(furthest.alias("at"), _empty("kind: string, start: int, from: int").alias("out")), step, lambda acc: acc["out"])

    def runs(parts: Column) -> Column:
        ends = F.transform(parts, lambda p: F.array_max(F.transform(p, lambda s: s["end"])))
        return let(ends, lambda own: F.flatten(F.transform(parts, lambda p, i: opening(p, F.coalesce(F.array_max(F.slice(own, F.lit(1), i)), F.lit(0))))))

    signs = F.create_map(*[F.lit(x) for k in KINDS for x in (k.name, k.sign)])

    def replaced(part: Column) -> Column:
        base = F.get(part, F.lit(0))["from"]
        piece = F.substring(text, base + 1, F.element_at(part, -1)["start"] - base)
        return let(piece, lambda held: F.array_join(F.transform(part, lambda r: F.concat(F.substring(held, r["from"] - base + 1, r["start"] - r["from"]), signs[r["kind"]])), ""))

    front = let(let(_in_blocks(spans), runs), lambda r: F.array_join(F.transform(_in_blocks(r), replaced), ""))
    tail = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(front, tail)).otherwise(text)
