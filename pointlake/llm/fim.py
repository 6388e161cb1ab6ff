"""Fill-in-middle transformation by one counted-quantifier regular expression per document.

A unit is a word with the white space before it, or white space at the end of a text.  ``regexp_count``
gives the number of units; the cuts a <= b are drawn from a digest of the document's key; the pattern
``\\A(unit{a}+)(unit{b-a}+)(rest)\\z`` of that row captures prefix, middle and suffix in one match, whose
replacement text already is the output.  Quantifiers are possessive: white space and words cannot trade
characters, so a match never goes back and takes time and stack in proportion to the text.  Everything
is Spark expressions over a row; nothing is shuffled.

Units are counted a thousand to a match (``\\G`` chains the matches), the rest one by one, so counting never
lists the words of a very long text.

Defined results: a NULL text counts as empty; a NULL key draws like an empty one; rows with equal key and
text get equal results; an empty text, or one that holds a sentinel, stays plain; other columns are kept and
outputs replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: Units that one match counts.
STRIDE = 1000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that are transformed, and percent of those that put the suffix first.
RATE, SPM_RATE = 50, 80
SEED = 42


def n_units(text: Column) -> Column:
    """Number of units of a text that is not NULL."""
    many = rf"\G(?:{UNIT}){{{STRIDE}}}+"
    rest = F.regexp_replace(text, many, "")
    return F.regexp_count(text, F.lit(many)).cast("bigint") * STRIDE + F.regexp_count(rest, F.lit(UNIT))


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws of a key, from the digest of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Every row with ``n``, ``form`` (plain, psm or spm), ``output``, and ``prefix_chars`` and
    ``middle_chars`` (NULL if plain); ``text`` stays."""
    outputs = ("n", "form", "output", "prefix_chars", "middle_chars")
    kept = [c for c in df.columns if c not in (*outputs, text)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest"), F.col(f"`{text}`").alias("given"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
                     F.array(*draws(F.col(f"`{key}`"), seed)).alias("h"))
    h = F.col("h")
    held = F.contains("t", F.lit(PREFIX)) | F.contains("t", F.lit(SUFFIX)) | F.contains("t", F.lit(MIDDLE))
    form = F.when((F.col("t") == "") | held | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumn("n", n_units(F.col("t"))).withColumn("form", form)
    cuts = [h[k] % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.withColumn("a", F.least(*cuts)).withColumn("b", F.greatest(*cuts))
    pattern = F.concat(F.lit(rf"(?s)\A((?:{UNIT}){{"), F.col("a"), F.lit(rf"}}+)((?:{UNIT}){{"), F.col("b") - F.col("a"), F.lit(r"}+)(.*)\z"))
    made = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    plain = F.col("form") == "plain"
    rows = rows.withColumn("output", F.when(plain, F.col("t")).otherwise(F.regexp_replace("t", pattern, made)))
    # sentinels occur once, so their places give the lengths
    p, s, m = (F.instr("output", mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    prefix = F.when(F.col("form") == "psm", s - p - 3).when(F.col("form") == "spm", m - p - 3)
    middle = F.when(~plain, F.length("output") - m - 2)
    back = [F.col("given").alias(text)] if text not in outputs else []
    return rows.select("rest.*", *back, "n", "form", "output", prefix.cast("bigint").alias("prefix_chars"), middle.cast("bigint").alias("middle_chars"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
