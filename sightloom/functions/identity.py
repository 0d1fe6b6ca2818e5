"""Names of one video: paths, stems and ordinals, as arrays of variants that can be matched by overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\\", "/")))


def variants(value: Column) -> Column:
    """The distinct, not empty forms of a name: as it is, its base name, stem, first part, and these without an ordinal."""
    v = normalized(value)
    base = F.regexp_extract(v, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    first = F.regexp_extract(base, r"^([^.]*)", 1)
    plain = lambda x: F.regexp_replace(x, r"^[0-9]+[-_. ]+", "")
    return F.filter(F.array_distinct(F.array(v, base, stem, first, plain(base), plain(stem), plain(first))), lambda x: x != "")


def same_video(a: Column, b: Column) -> Column:
    """Whether two rows' variants meet; a row without any meets all."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def video_id(source: Column, uploaded: Column, name: Column, path: Column) -> Column:
    """The first of source id, stem of the uploaded file, name and stem of the path; else a short hash."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    some = lambda c: F.when(F.trim(c) != "", c)
    digest = F.substring(F.sha1(F.concat_ws("|", source, uploaded, name, path)), 1, 12)
    return F.coalesce(some(source), some(stem(uploaded)), some(name), some(stem(path)), digest)


def segment_parts(segment_id: Column) -> Column:
    """struct<prefix, index> of an id: what stands before its last underscore, and the number after it."""
    n = F.regexp_extract(segment_id, r"^.*_([0-9]+)$", 1)
    return F.struct(F.regexp_extract(segment_id, r"^(.*)_[^_]*$", 1).alias("prefix"), F.when(n != "", n.cast("long")).alias("index"))
