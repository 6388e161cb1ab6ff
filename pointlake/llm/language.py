"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 (drawn from its code point).  The vector of a letter
n-gram is the product of its letters' vectors, each rotated by its place; the vector of a text is the
sum over its n-grams, and a language's prototype is the sum over training texts.  A text gets the
language whose prototype has the largest cosine with it (the first by name on a tie).

Learning reads a sample of at most about ``sample`` training rows per language, chosen by a hash of
text and key, so its cost does not grow with the corpus; prediction reads every whole text once and
shuffles nothing.  n-grams are counted per slice of a batch, so each distinct one is expanded once.

Defined results: a text that is NULL or has no letter is ``und`` with score 0; a language without
letters in its training texts is never predicted; without any training rows every text is ``und``;
repeated rows and other columns play no part; outputs replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.llm.common import map_column, slices, text_slices

UNKNOWN = "und"
ORDER = 3
DIM = 512
SAMPLE = 4000
MAX_LANGUAGES = 1000
PIECE = 250_000
_BITS = 21


def letter_table() -> np.ndarray:
    """Lower-case code point of every letter, 0 for anything else."""
    out = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        char = chr(cp)
        if char.isalpha():
            low = char.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def letter_vectors(letters: np.ndarray, dim: int) -> np.ndarray:
    """Random signs per letter: bits of a mixed counter, a function of code point and place only."""
    x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dim // 64, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(letters), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray, order: int, dim: int) -> np.ndarray:
    """Bound vectors of packed n-grams: the product of rotated letter vectors."""
    out = None
    for place in range(order):
        letters, at = np.unique((grams >> (_BITS * place)) & ((1 << _BITS) - 1), return_inverse=True)
        rotated = np.roll(letter_vectors(letters, dim), place, axis=1)[at]
        out = rotated if out is None else out * rotated
    return out


def packed_grams(letters: np.ndarray, order: int) -> np.ndarray:
    """n-grams of a run of letters (0 between words), words framed by one blank; grams that are all
    blank inside are dropped."""
    n = len(letters) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for place in range(order):
        out |= letters[place:place + n] << (_BITS * place)
    middle = letters[order // 2: order // 2 + n]
    return out[middle > 0]


class Profiles:
    """Vectors of texts; made once per task."""

    def __init__(self, order: int = ORDER, dim: int = DIM):
        self.order, self.dim, self.table = order, dim, letter_table()

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        for lo in range(0, len(text), PIECE):
            part = text[max(0, lo - self.order + 1): lo + PIECE]
            if lo == 0:
                part = " " * (self.order // 2) + part
            if lo + PIECE >= len(text):
                part += " " * (self.order // 2)
            yield packed_grams(self.table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")], self.order)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One row per text."""
        out = np.zeros((len(texts), self.dim), np.float32)
        for lo, hi in slices([len(t) for t in texts], PIECE):
            parts = [(i, g) for i in range(lo, hi) for g in self.pieces(texts[i])]
            for plo, phi in slices([len(g) for _, g in parts], PIECE):
                self._add(out, parts[plo:phi])
        return out

    def _add(self, out: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> None:
        sizes = [len(g) for _, g in parts]
        if not sum(sizes):
            return
        grams, at = np.unique(np.concatenate([g for _, g in parts]), return_inverse=True)
        table = gram_vectors(grams, self.order, self.dim)
        row = np.repeat(np.arange(len(parts)), sizes)
        for lo in range(0, len(parts), 64):
            hi = min(lo + 64, len(parts))
            here = (row >= lo) & (row < hi)
            counts = np.bincount((row[here] - lo) * len(grams) + at[here], minlength=(hi - lo) * len(grams))
            counts = counts.reshape(hi - lo, len(grams)).astype(np.float32)
            np.add.at(out, [i for i, _ in parts[lo:hi]], counts @ table)


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", key: Sequence[str] = ("doc_id",), order: int = ORDER, dim: int = DIM, sample: int = SAMPLE) -> dict[str, list[float]]:
    """Unit prototype per language.  ``key`` tells rows with equal texts apart in the sampling.  About ``sample`` rows of each are bundled by the tasks, which
    send one partial sum per language; languages must number at most ``MAX_LANGUAGES``."""
    draw = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (text, *key)]), F.lit(1 << 30))
    rows = rows.select(F.col(f"`{text}`").alias("_text"), draw.alias("_draw"), F.col(f"`{lang}`").cast("string").alias("_lang")).filter("_lang IS NOT NULL AND _text IS NOT NULL")
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    span = 1 << 30
    bounds = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(span, span * sample // n))])
    chosen = rows.filter(F.col("_draw") < bounds[F.col("_lang")]).select("_text", "_lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, sums = Profiles(order, dim), {}
        for batch, texts in text_slices(batches, "_text"):
            langs = batch.column(1).to_pylist()
            vectors = maker.vectors(texts).astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = np.rint(vectors / np.maximum(norms, 1e-9) * 1e6)  # whole numbers: sums do not depend on their order
            for name in set(langs):
                sums[name] = sums.get(name, 0) + vectors[[x == name for x in langs]].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = chosen.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    total: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        total.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["x"]
    return {k: (v / np.linalg.norm(v)).tolist() for k, v in sorted(total.items()) if v.any()}


def predict(df: DataFrame, prototypes: dict[str, list[float]], text: str = "text", order: int = ORDER, dim: int = DIM, keep: bool = True) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the cosine, at least 0); ``keep=False`` leaves the text out."""
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), dim).T

    def start():
        maker = Profiles(order, dim)

        def apply(texts: list[str | None]) -> list[pa.Array]:
            if not names:
                return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
            vectors = maker.vectors([t or "" for t in texts])
            norms = np.linalg.norm(vectors, axis=1)
            cosines = vectors @ matrix / np.maximum(norms, 1e-9)[:, None]
            langs = [names[b] if n > 0 else UNKNOWN for b, n in zip(cosines.argmax(1), norms, strict=True)]
            return [pa.array(langs, pa.string()), pa.array(np.where(norms > 0, np.clip(cosines.max(1), 0, 1), 0.0).astype(np.float64))]
        return apply

    return map_column(df, text, [("lang_pred", T.StringType()), ("score", T.DoubleType())], start, keep)


def held_out(doc_id: Column) -> Column:
    """Rows kept away from learning: a quarter by checksum of the id (NULL ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
