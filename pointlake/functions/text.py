"""Caption and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY_WORDS = 75
# fixed values: classes without a prompt, and the first template of each family
BACKGROUND = ("wall", "floor", "ceiling", "otherfurniture")
TEMPLATES = {
    "full": "a bad photo of a {}.",
    "subset": "itap of a {}.",
    "simple": "a photo of a {}.",
    "identity": "{}",
    "lseg": "a {} in a scene",
}


def word_count(text: Column) -> Column:
    """pieces of the text at single spaces."""
    return F.size(F.split(text, " "))


def needs_summary(text: Column, limit: int = SUMMARY_WORDS) -> Column:
    """long texts go to the summariser."""
    return word_count(text) > limit


def drop_first(words: Column, word: str) -> Column:
    """remove the first occurrence of a word."""
    at = F.array_position(words, word).cast("int")
    return F.when(at > 0, F.concat(F.slice(words, 1, at - 1), F.slice(words, at + 1, F.size(words)))).otherwise(words)


def words_of(text: Column) -> Column:
    """Words at single spaces, empty ones left out."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def prompt(name: Column, family: str) -> Column:
    """class name in its prompt; the ``lseg`` family leaves background classes bare."""
    template = TEMPLATES.get(family, family)
    text = F.replace(F.lit(template), F.lit("{}"), name)
    return F.when(F.lower(name).isin(*BACKGROUND), name).otherwise(text) if family == "lseg" else text


def room_id(path: Column) -> Column:
    """``Area_a/room_n/Annotations`` -> ``Area_a_room_n``."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.concat_ws("_", F.element_at(parts, -3), F.element_at(parts, -2))


def area_of(name: Column) -> Column:
    """area number in a room name."""
    return F.regexp_extract(name, r"Area_(\d+)", 1).try_cast("int")


def room_of(name: Column) -> Column:
    """room part of a room name."""
    return F.regexp_extract(name, r"Area_\d+_(.+)$", 1)


def file_stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def image_key(name: Column) -> Column:
    """image names are compared in lower case."""
    return F.lower(name)


def epoch_of(name: Column) -> Column:
    """epoch number in a checkpoint file name."""
    return F.regexp_extract(name, r"epoch_(\d+)", 1).try_cast("int")


def best_of_name(name: Column) -> tuple[Column, Column]:
    """metric (third part) and epoch (last part) of a record file name."""
    parts = F.split(file_stem(name), "_")
    return F.get(parts, F.lit(2)).try_cast("double"), F.element_at(parts, -1).try_cast("int")
