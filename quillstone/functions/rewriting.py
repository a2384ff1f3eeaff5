"""Boxes within texts and lists, rewritten as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.responses import let, list_items, tag_block, trimmed

NUMBERS = r"\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]"


def _block(text: Column, tag: str, content: Column) -> Column:
    """text with the content of its tags replaced, on lines of its own."""
    block = F.concat(F.lit(f"<{tag}>\n"), content, F.lit(f"\n</{tag}>"))
    safe = F.regexp_replace(block, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, F.lit(rf"(?s)<{tag}>.*?</{tag}>"), safe)


def swap_in_text(text: Column) -> Column:
    """Every list of four whole numbers (y, x, y, x) in the text as [x, y, x, y]."""
    return F.regexp_replace(text, NUMBERS, "[$2, $1, $4, $3]")


def swap_in_think(text: Column) -> Column:
    """swap_in_text within the think block; a text without one, or with an empty one, is left as it is."""
    inside = tag_block(text, "think")
    return F.when(F.coalesce(inside, F.lit("")) == "", text).otherwise(_block(text, "think", swap_in_text(inside)))


def swap_in_answer(text: Column) -> Column:
    """Boxes of the answer block from (y, x, y, x) to (x, y, x, y), written again as JSON; unread or empty answers are left as they are."""
    items = list_items(tag_block(text, "answer"))
    turned = F.transform(items, lambda i: F.regexp_replace(i, r'("box_2d"\s*:\s*)\[\s*([^,\[\]]+?)\s*,\s*([^,\[\]]+?)\s*,\s*([^,\[\]]+?)\s*,\s*([^,\[\]]+?)\s*\]', "$1[$3,$2,$5,$4]"))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, text).otherwise(_block(text, "answer", F.concat(F.lit("["), F.array_join(turned, ", "), F.lit("]"))))


def feedback_text(reply: Column) -> Column:
    """The reply without think and answer tags, trimmed; where nothing is left, its first 2000 characters."""
    plain = trimmed(F.regexp_replace(reply, r"</?(?:think|answer)>", ""))
    return let(plain, lambda t: F.when(t != "", t).otherwise(F.substring(reply, 1, 2000)))


def repaired_numbers(tokens: Column) -> Column:
    """Coordinates from number tokens: those with a point or exponent are scaled by 1000 if at most 1, then rounded half to even; others are kept."""
    value = lambda t: t.cast("double")
    mend = lambda t: F.when(t.rlike(r"[.eE]"), F.bround(F.when(value(t) <= 1, value(t) * 1000).otherwise(value(t)))).otherwise(value(t)).cast("long")
    return F.transform(tokens, mend)


def needs_repair(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: t.rlike(r"[.eE]"))


def boxes_by_label(boxes: Column, label: str) -> Column:
    """The boxes of a label, whatever its case."""
    return F.filter(boxes, lambda b: F.lower(b["label"]) == label)


def merged_boxes(misalignment: Column, artifact: Column) -> Column:
    """One list of two class lists: labels are set, corners swapped to (x, y, x, y), importance is 50 where it is missing."""
    one = lambda boxes, label: F.transform(F.coalesce(boxes, F.array().cast("array<struct<box_2d:array<double>,label:string,description:string,importance:double>>")), lambda b: F.struct(
        F.array(b["box_2d"][1], b["box_2d"][0], b["box_2d"][3], b["box_2d"][2]).alias("box_2d"), F.lit(label).alias("label"), F.coalesce(b["description"], F.lit("")).alias("description"), F.coalesce(b["importance"], F.lit(50.0)).alias("importance")))
    return F.concat(one(misalignment, "misalignment"), one(artifact, "artifact"))


def same_boxes(a: Column, b: Column) -> Column:
    """Whether two lists hold the same labels and corners, as multisets."""
    plain = lambda boxes: F.array_sort(F.transform(boxes, lambda x: F.struct(F.coalesce(x["label"], F.lit("")).alias("label"), x["box_2d"].alias("box_2d"))))
    return plain(a) == plain(b)


def distillation_reason(reply: Column, parsed: Column, expected: Column) -> Column:
    """Why a distilled reply is refused, null where it is not: empty, no think block, nothing in it, other boxes than expected."""
    think = tag_block(reply, "think")
    return (
        F.when(F.coalesce(reply, F.lit("")) == "", "empty").when(~(reply.contains("<think>") & reply.contains("</think>")), "missing_think_block")
        .when(F.coalesce(think, F.lit("")) == "", "empty_think_block").when(~same_boxes(parsed, expected), "bbox_mismatch")
    )
