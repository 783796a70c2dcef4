"""Names, tags, lists and answers in strings.

The patterns of names, tags, data addresses and answers are fixed values: they are the forms that the data have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def table_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9_]", "_")


def slug(x: Column) -> Column:
    return F.translate(x, " /\\", "_--")


def file_name(x: Column) -> Column:
    """Safe characters only, ending in .json."""
    safe = F.regexp_replace(F.regexp_replace(x, r"\.json$", ""), r"[^a-zA-Z0-9_\-]", "_")
    return F.concat(safe, F.lit(".json"))


def instance_parts(x: Column) -> Column:
    """struct(slug, seq, obj) of slug_seq_<n>_<m>; null if it has another form."""
    parts = [F.regexp_extract(x, r"^(.+)_seq_(\d+)_(\d+)$", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.struct(parts[0].alias("slug"), parts[1].cast("int").alias("seq"), parts[2].cast("int").alias("obj")))


def mask_parts(x: Column) -> Column:
    """struct(stem, mask) of <stem>_mask_<i>, cut at the last such mark; null if it has another form."""
    stem, mask = (F.regexp_extract(x, r"^(.*)_mask_(\d+)$", i) for i in (1, 2))
    return F.when(mask != "", F.struct(stem.alias("stem"), mask.cast("int").alias("mask")))


def mask_id(stem: Column, i: Column) -> Column:
    return F.format_string("%s_mask_%d", stem, i)


def frame_number(x: Column) -> Column:
    """The number a name ends in; null if there is none (``assert_true`` on it makes that an error)."""
    return F.nullif(F.regexp_extract(x, r"(\d+)$", 1), F.lit("")).cast("int")


def tagged(x: Column) -> Column:
    """Numbers of all component tags, in order."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"<component_(\d+)>"), F.lit(1)), lambda n: n.cast("long"))


def untagged(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", "")


def rendered(x: Column) -> Column:
    """The text between an opening tag and its closing twin as [text](#id)."""
    return F.regexp_replace(x, r"<component_(\d+)>(.*?)</component_\1>", r"[$2](#$1)")


def plain(x: Column) -> Column:
    """Lower case without punctuation."""
    return F.translate(F.lower(x), PUNCTUATION, "")


def object_name(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(x), "[.,;:!?]+$", ""))


def label(x: Column) -> Column:
    """A label before lemmas: trimmed, without final dots, lower case."""
    return F.lower(F.regexp_replace(F.trim(x), r"\.+$", ""))


def comma_list(x: Column) -> Column:
    """Distinct items in order of first occurrence, trimmed, lower case, none empty."""
    return F.array_distinct(F.filter(F.transform(F.split(x, ","), lambda i: F.lower(F.trim(i))), lambda i: i != ""))


def valid_ids(found: Column, valid: Column) -> Column:
    """The valid ones of the ids found, in order; the least valid id if there is none."""
    kept = F.filter(found, lambda i: F.array_contains(valid, i))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.array_min(valid)))


_ANSWER = "component_ids ARRAY<INT>, reason STRING"


def final_answer(x: Column) -> Column:
    """The answer object of a reply: the whole reply, else its first braces without inner ones; null if neither parses."""
    whole, inner = F.from_json(x, _ANSWER), F.from_json(F.regexp_extract(x, r"(\{[^{}]*\})", 1), _ANSWER)
    return F.coalesce(F.when(whole["component_ids"].isNotNull(), whole), F.when(inner["component_ids"].isNotNull(), inner))


def clean_caption(x: Column) -> Column:
    """Without a known artefact of a captioning model and what follows it, and without quotes around it."""
    return F.regexp_replace(F.trim(F.regexp_replace(x, "addCriterion.*", "")), "^[\"']+|[\"']+$", "")


def crop_object(x: Column) -> Column:
    """The object that a crop's file name tells."""
    return F.translate(F.regexp_extract(x, r"frame_\d+_(.+?)_seq_", 1), "_", " ")


def judge_score(x: Column) -> Column:
    """The first whole number from 1 to 10, else 0."""
    found = F.regexp_extract(x, r"\b(10|[1-9])\b", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("double"), F.lit(0.0))


def mime(x: Column) -> Column:
    end = F.lower(F.regexp_extract(x, r"\.([^.]+)$", 1))
    return F.when(end.isin("jpg", "jpeg"), "image/jpeg").when(end == "webp", "image/webp").when(end == "gif", "image/gif").otherwise("image/png")


def data_uri(name: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime(name), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def data_uri_parts(x: Column) -> Column:
    """struct(mime, content)"""
    return F.struct(F.regexp_extract(x, "^data:([^;,]+)", 1).alias("mime"), F.unbase64(F.regexp_extract(x, ",(.*)$", 1)).alias("content"))


def prompt_line(component_id: Column, caption: Column) -> Column:
    return F.format_string("Component %d: %s\n\n", component_id, F.coalesce(caption, F.lit("")))


def contains_folded(x: Column, part: Column) -> Column:
    """Whether ``part`` occurs in ``x``, capital or not."""
    return F.contains(F.lower(x), F.lower(part))
