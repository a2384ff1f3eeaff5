"""Training records and prompts as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(template: str, caption: Column) -> Column:
    """The template with its caption; doubled braces become single ones."""
    plain = F.replace(F.replace(F.lit(template), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    return F.replace(plain, F.lit("{caption}"), F.coalesce(caption, F.lit("")))


def box_text(boxes: Column) -> Column:
    """A list of boxes as JSON, None where it is empty or null."""
    return F.when(F.coalesce(F.size(boxes), F.lit(0)) <= 0, "None").otherwise(F.to_json(boxes))


def sft_reason(caption: Column, reply: Column, valid: Column) -> Column:
    """Why a record is left out, null where it is not: a missing field, a missing think block, a bad box, in this order."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(empty(caption) | empty(reply), "missing_field").when(~reply.rlike(r"(?s)<think>.*?</think>"), "missing_think_block").when(~F.coalesce(valid, F.lit(False)), "invalid_bbox")


def sft_messages(prompt: Column, reply: Column) -> Column:
    """The user's message, with a mark for the image, and the assistant's reply."""
    return F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("<image>"), prompt).alias("content")), F.struct(F.lit("assistant").alias("role"), reply.alias("content")))


def valid_boxes(boxes: Column, labels: tuple[str, ...] | None = ("artifact", "misalignment")) -> Column:
    """Whether all boxes have a known label, whatever its case (any, where labels is None) and four ordered numbers within 0..1000; an empty list is valid, null is not."""
    def fits(b: Column) -> Column:
        c = b["box_2d"]
        return (F.size(c) == 4) & F.forall(c, lambda v: (v >= 0) & (v <= 1000)) & (F.get(c, F.lit(0)) < F.get(c, F.lit(2))) & (F.get(c, F.lit(1)) < F.get(c, F.lit(3))) & (F.lower(b["label"]).isin(*labels) if labels else F.lit(True))

    return F.coalesce(F.forall(boxes, lambda b: F.coalesce(fits(b), F.lit(False))), F.lit(False))


def strict_boxes(text: Column, labels: tuple[str, ...] = ("artifact", "misalignment")) -> Column:
    """Whether a JSON text is a list of boxes that each have a known label, whatever its case, and four whole numbers in 0..1000 in order.

    The types are those of the text: 2.0, 2.5 and "2" are no whole numbers; true and false count as 1 and 0. An empty list is valid; null, other JSON
    and what is no JSON are not, nor is a list with anything but objects.
    """
    whole = lambda v: F.coalesce(F.try_variant_get(v, "$", "long"), F.try_variant_get(v, "$", "boolean").cast("long"))
    kind = lambda v: F.schema_of_variant(v)

    def fits(b: Column) -> Column:
        c = F.try_variant_get(b, "$.box_2d", "array<variant>")
        at = lambda i: whole(F.get(c, F.lit(i)))
        label = F.try_variant_get(b, "$.label", "variant")
        known = (kind(label) == "STRING") & F.lower(F.try_variant_get(label, "$", "string")).isin(*labels)
        return kind(b).startswith("OBJECT") & known & (F.size(c) == 4) & F.forall(c, lambda v: kind(v).isin("BIGINT", "BOOLEAN") & whole(v).between(0, 1000)) & (at(0) < at(2)) & (at(1) < at(3))

    boxes = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return F.coalesce(F.forall(boxes, lambda b: F.coalesce(fits(b), F.lit(False))), F.lit(False))


def degenerate(text: Column) -> Column:
    """A text of over 100 characters of which more than half are one digit, if that is the commonest, or over 0.3 are U+FFFD."""
    n = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    # a character with over half of a text is its commonest
    digit = F.greatest(*[n(str(d)) for d in range(10)])
    return (F.length(text) > 100) & ((digit / F.length(text) > 0.5) | (n("�") / F.length(text) > 0.3))


#: Fixed texts of edit prompts.
FIXED_EDIT = "Improve the image quality, fix any visual artifacts, distortions, and ensure the image accurately matches the following description: "
FEEDBACK_EDIT = "Based on feedback from an external evaluation model, improve the qualityof this image, fix any visual artifacts, distortions, and ensure the image accurately matches the following description: "
ACCOMPANIED = {
    "plain": "Below is the textual feedback from the external model:\n\n",
    "heatmap": "Below is the textual feedback from the external model, along with the corresponding artifact and misalignment heatmaps (highlighting the problematic regions):\n\n",
    "boxes": "Below is the textual feedback from the external model, along with the bounding box annotations on the second image (highlighting the defect regions):\n\n",
}


def edit_prompt(caption: Column, feedback: Column, style: Column) -> Column:
    """A prompt to edit an image, with the feedback and what accompanies it (a key of ACCOMPANIED); without feedback the fixed one."""
    said = F.lit(ACCOMPANIED["plain"])
    for name, text in ACCOMPANIED.items():
        said = F.when(style == name, F.lit(text)).otherwise(said)
    fixed, base = F.concat(F.lit(FIXED_EDIT), caption), F.concat(F.lit(FEEDBACK_EDIT), caption, F.lit("\n\n"))
    return F.when(F.coalesce(feedback, F.lit("")) == "", fixed).otherwise(F.concat(base, said, feedback))


#: What batch prompts add for a style, and the rule against text on an image; callers put their own texts here.
BATCH_EDIT = "Make a better version of the image, which was made from this description: {caption}\n\n{guide}What an evaluation says:\n{feedback}\n{rule}\nKeep composition and style, and match the description: {caption}"
BATCH_PLAIN = "Make a better version of the image, which was made from this description: {caption}\n\nMatch the description: {caption}"
GUIDES = {"boxes": "A second image has boxes around its defects.\n", "heatmap": "A second and a third image show where artifacts and misalignments are.\n"}
NO_TEXT = "\nAdd no text of any kind to the image.\n"


def batch_edit_prompt(caption: Column, feedback: Column, style: Column, no_text: bool = False, texts: dict[str, str] | None = None) -> Column:
    """A prompt of an edit batch: with feedback the text ``edit`` with the guide of its style (a key of GUIDES) and, with no_text, the rule; without feedback the text ``plain``.

    texts replaces edit, plain or rule by templates of the caller, with the places {caption}, {guide}, {feedback} and {rule}.
    """
    own = {"edit": BATCH_EDIT, "plain": BATCH_PLAIN, "rule": NO_TEXT} | (texts or {})
    guide = F.lit("")
    for name, text in GUIDES.items():
        guide = F.when(style == name, F.lit(text)).otherwise(guide)
    said = {"{caption}": F.coalesce(caption, F.lit("")), "{guide}": guide, "{rule}": F.lit(own["rule"] if no_text else ""), "{feedback}": F.coalesce(feedback, F.lit(""))}

    def put(template: str) -> Column:
        out = F.lit(template)
        for mark, value in said.items():  # the feedback last, as what it says is no template
            out = F.replace(out, F.lit(mark), value)
        return out

    return F.when(F.coalesce(F.trim(feedback), F.lit("")) == "", put(own["plain"])).otherwise(put(own["edit"]))


def grpo_record(path: Column, prompt: Column, boxes: Column) -> Column:
    """struct(reason, messages, gt_misalignment, gt_artifact): a prompt with its image, and the true boxes by label, whatever its case.

    reason is null, missing_image_path, or invalid_bbox where a box of the two classes leaves 0..1000 or is out of order.
    """
    of = lambda label: F.coalesce(F.filter(boxes, lambda b: F.lower(b["label"]) == label), F.array().cast("array<struct<box_2d:array<double>,label:string>>"))
    c = lambda b, i: b["box_2d"][i]
    wrong = lambda b: F.exists(b["box_2d"], lambda v: (v < 0) | (v > 1000)) | (c(b, 0) >= c(b, 2)) | (c(b, 1) >= c(b, 3))
    reason = F.when(F.coalesce(path, F.lit("")) == "", "missing_image_path").when(F.exists(F.concat(of("misalignment"), of("artifact")), wrong), "invalid_bbox")
    part = lambda kind, image, text: F.struct(F.lit(kind).alias("type"), image.alias("image"), text.alias("text"))
    none = F.lit(None).cast("string")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.array(part("image", path, none), part("text", none, prompt)).alias("content")))
    return F.struct(reason.alias("reason"), messages.alias("messages"), of("misalignment").alias("gt_misalignment"), of("artifact").alias("gt_artifact"))


#: Named prompt templates.
TEMPLATES: dict[str, str] = {}


def template(name: str) -> str:
    """The text of a named template; an unknown name raises with the names there are."""
    if name not in TEMPLATES:
        raise KeyError(f"no template {name!r}; there are {sorted(TEMPLATES)}")
    return TEMPLATES[name]
