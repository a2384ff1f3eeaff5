"""Boxes from free-text replies, as Column functions.

A reply may hold its boxes in an answer tag, in a code fence or as a bare array, in JSON or as a Python literal.
Each policy returns an array of boxes, or null where nothing can be parsed. Python literals are read as JSON after
their None, True and False are renamed and trailing commas cut; quotes may be single and signs escaped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOXES = "array<struct<box_2d:array<double>,label:string,description:string,importance:double>>"
FENCE = r"(?s)```(?:json)?(.*?)```"
#: What a pattern calls white space, and the line ends that $ stands before but that are none.
BLANKS, LINE_ENDS = " \t\n\x0b\f\r", ("\x85", "\u2028", "\u2029")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    """The first group of the pattern, trimmed; null where it is not met (an empty group is empty)."""
    return trimmed(F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0)))


def _enclosed(text: Column, pattern: str) -> Column:
    """As _found, for a group with an end mark of its own. Blanks go after the search: a pattern that looks for them tries at every character."""
    return trimmed(F.btrim(F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0)), F.lit(BLANKS)))


def trimmed(text: Column) -> Column:
    """Without the blanks at both ends; before a last line end that is none of them as well."""
    odd = lambda t: t.endswith(LINE_ENDS[0]) | t.endswith(LINE_ENDS[1]) | t.endswith(LINE_ENDS[2])
    return let(text, lambda t: F.when(odd(t), F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(F.btrim(t, F.lit(BLANKS))))


def tag_block(text: Column, tag: str) -> Column:
    """The trimmed content of the first closed tag, or null."""
    return _enclosed(text, rf"(?s)<{tag}>(.*?)</{tag}>")


def _unfenced(text: Column) -> Column:
    return let(text, lambda t: F.coalesce(_enclosed(t, FENCE), t))


def _none() -> Column:
    return F.array().cast(BOXES)


def _strict(text: Column) -> Column:
    return let(text, lambda t: F.when(t.startswith("["), F.from_json(t, BOXES, {"allowSingleQuotes": "false"})))


LENIENT = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def _renamed(text: Column, name: str, value: str) -> Column:
    """text with a literal's name as JSON's value; texts that do not hold the name are not searched."""
    return let(text, lambda t: F.when(t.contains(name), F.regexp_replace(t, rf"([\[:,]\s*){name}(?=\s*[,\]}}])", f"$1{value}")).otherwise(t))


def _as_json(text: Column) -> Column:
    """A Python literal in JSON's words: None, True and False as values, no trailing commas."""
    out = F.regexp_replace(text, r",\s*([\]}])", "$1")
    for name, value in (("None", "null"), ("True", "true"), ("False", "false")):
        out = _renamed(out, name, value)
    return out


def _literal(text: Column) -> Column:
    return let(text, lambda t: F.when(t.startswith("["), F.coalesce(F.from_json(t, BOXES), F.from_json(_as_json(t), BOXES, LENIENT))))


def _elements(text: Column, options: dict[str, str]) -> Column:
    """The elements of text if it is one list and nothing else: a list around it must have one element."""
    wrapped = F.when(text.startswith("[") & text.endswith("]"), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<array<string>>", options))
    return let(wrapped, lambda w: F.when(F.size(w) == 1, F.get(w, F.lit(0))))


def strict_items(text: Column) -> Column:
    """The elements of a JSON list, each as JSON text; null where text is no JSON list."""
    return let(text, lambda t: _elements(t, {"allowSingleQuotes": "false"}))


def list_items(text: Column) -> Column:
    """The elements of a list in JSON or as a Python literal, each as JSON text; null where text is neither."""
    return let(text, lambda t: F.coalesce(strict_items(t), let(_as_json(t), lambda j: _elements(j, LENIENT))))


def boxes_of_items(items: Column, cut: bool = False) -> Column:
    """Boxes of list elements: objects with box_2d, ``desc`` standing in for description, or bare lists of numbers (no label).

    A box has four numbers; with cut it may have more, of which the first four stay, as whole numbers. Other elements go.
    """

    def box(item: Column, o: Column) -> Column:
        plain = item.startswith("[")
        c = F.when(plain, F.from_json(item, "array<double>")).otherwise(o["box_2d"])
        whole = lambda c: F.transform(F.slice(c, 1, 4), lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"))
        c = let(c, lambda c: F.when(F.size(c) >= 4, whole(c)) if cut else F.when(F.size(c) == 4, c))
        told = F.coalesce(F.nullif(o["description"], F.lit("")), o["desc"], F.lit(""))
        return F.struct(c.alias("box_2d"), F.when(plain, "").otherwise(F.coalesce(o["label"], F.lit(""))).alias("label"), F.when(plain, "").otherwise(told).alias("description"), F.when(~plain, o["importance"]).alias("importance"))

    fields = "box_2d array<double>, label string, description string, desc string, importance double"
    each = F.transform(items, lambda i: let(F.from_json(i, fields), lambda o: box(i, o)))
    return F.filter(each, lambda b: b["box_2d"].isNotNull() & ~F.exists(b["box_2d"], lambda v: v.isNull()))


def _between_brackets(text: Column) -> Column:
    """From the first [ to the last ], null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def parse_distill(text: Column) -> Column:
    """First answer tag, a fence around it cut; JSON, literal, else the stretch between the outer brackets; failures are empty."""
    answer = F.regexp_replace(F.coalesce(tag_block(text, "answer"), F.lit("")), r"^```(?:json)?", "")
    answer = trimmed(F.regexp_replace(answer, r"```$", ""))
    items = let(answer, lambda t: F.coalesce(list_items(t), list_items(_between_brackets(t))))
    return F.coalesce(boxes_of_items(items), _none())


def parse_harvest(text: Column) -> Column:
    """Answer tag or the whole text; a JSON list between the outer brackets, else every object with box_2d and label that a pattern finds.

    Boxes of four numbers whose label, in lower case, is one of the two classes stay.
    """
    return let(F.coalesce(tag_block(text, "answer"), text), _harvested)


def _harvested(inside: Column) -> Column:
    items = strict_items(_between_brackets(inside))
    number = r"\d+(?:\.\d+)?"
    pattern = r'(?s)\{[^}]*"box_2d"\s*:\s*\[\s*' + rf"{number}(?:\s*,\s*{number}){{3}}" + r'\][^}]*"label"\s*:\s*"[^"]+"[^}]*\}'
    each = F.transform(F.regexp_extract_all(inside, F.lit(pattern), F.lit(0)), lambda o: F.struct(
        F.split(F.regexp_extract(o, r'"box_2d"\s*:\s*\[([^\]]*)\]', 1), ",").cast("array<double>").alias("box_2d"),
        F.regexp_extract(o, r'"label"\s*:\s*"([^"]+)"', 1).alias("label"), F.lit("").alias("description"), F.lit(None).cast("double").alias("importance")))
    return F.filter(F.when(F.size(items) > 0, boxes_of_items(items)).otherwise(each), lambda b: F.lower(b["label"]).isin("misalignment", "artifact"))


def parse_yxyx(text: Column) -> Column:
    """Answer tag, else a fence, else the stretch between the outer brackets; JSON or literal; boxes (y, x, y, x) become (x, y, x, y). Failures are empty."""
    answer = F.coalesce(tag_block(text, "answer"), _enclosed(text, FENCE), _between_brackets(text))
    kept = F.filter(list_items(trimmed(answer)), lambda i: ~i.startswith("["))
    turned = lambda b: F.struct(swapped(b["box_2d"]).alias("box_2d"), b["label"], b["description"], b["importance"])
    return F.coalesce(F.transform(boxes_of_items(kept), turned), _none())


def array_items(text: Column) -> Column:
    """Elements, as JSON text, of the list between the outer brackets of the answer tag; bad JSON and no tag give none."""
    return F.coalesce(strict_items(_between_brackets(tag_block(text, "answer"))), F.array().cast("array<string>"))


def swapped(c: Column) -> Column:
    """(y, x, y, x) as (x, y, x, y) and back."""
    return F.array(c[1], c[0], c[3], c[2])


def think_text(text: Column) -> Column:
    """The content of the think tag, else the trimmed text."""
    return F.coalesce(tag_block(text, "think"), trimmed(text))


def completion_text(payload: Column, depth: int = 3) -> Column:
    """The text of a completion given as JSON text: a string, a list whose parts are joined by line ends, or an object by text, content, message, choices.

    Nested to ``depth`` levels; other shapes and null are empty. A payload that is no JSON is itself the text.
    """

    def flat(j: Column, left: int) -> Column:
        """Text of a variant; transform over one element binds it, so that the expression stays small."""
        return F.get(F.transform(F.array(j), lambda v: body(v, left)), F.lit(0))

    def body(v: Column, left: int) -> Column:
        kind = F.schema_of_variant(v)
        string = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        if not left:
            return F.coalesce(string, F.lit(""))
        key = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
        child = F.coalesce(F.when(F.schema_of_variant(key("text")) == "STRING", key("text")), key("content"), key("message"), key("choices"))
        parts = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda i: flat(i, left - 1)), lambda t: t != "")
        return F.coalesce(string, F.when(kind.startswith("ARRAY"), F.array_join(parts, "\n")).when(kind.startswith("OBJECT"), flat(child, left - 1)), F.lit(""))

    json = F.try_parse_json(payload)
    return F.when(payload.isNull(), "").when(json.isNull(), payload).otherwise(flat(json, depth))


def text_lists(text: Column) -> Column:
    """Boxes of a column that holds a list as text, JSON or a Python literal; failures and null are empty."""
    return F.coalesce(boxes_of_items(list_items(trimmed(text))), _none())


def _complete(boxes: Column) -> Column:
    return F.filter(boxes, lambda b: b["box_2d"].isNotNull() & b["label"].isNotNull())


def _lenient(text: Column) -> Column:
    """Empty text and JSON that is no list give no boxes; what is neither JSON nor a literal gives null."""
    return let(text, lambda t: F.when(t == "", _none()).otherwise(F.coalesce(_complete(_literal(t)), F.when(~t.startswith("[") & F.try_parse_json(t).isNotNull(), _none()))))


def parse_eval(text: Column) -> Column:
    """Answer tag (a fence within it allowed), else a fence, else a text that is an array."""
    whole = let(trimmed(text), lambda t: F.when(t.startswith("["), _lenient(t)))
    return F.coalesce(_lenient(_unfenced(tag_block(text, "answer"))), _lenient(_enclosed(text, FENCE)), whole)


def parse_reward(text: Column) -> Column:
    """Answer tag and strict JSON only; anything but a list is null."""
    return let(_unfenced(tag_block(text, "answer")), lambda t: F.when(t == "", _none()).otherwise(_complete(_strict(t))))


def parse_labels(text: Column) -> Column:
    """Answer tag without a fence; failures are empty, never null. Boxes may lack fields."""
    return F.coalesce(_literal(tag_block(text, "answer")), _none())


def parse_repair(text: Column) -> Column:
    """As labels, but an answer tag may stay open, and failures are null."""
    answer = F.coalesce(tag_block(text, "answer"), _found(text, r"(?s)<answer>\s*(.*)"))
    return let(answer, lambda t: F.when(t == "", _none()).otherwise(_literal(t)))


def parse_snippet(text: Column) -> Column:
    """From the first [ to the last ] in the answer tag, strict JSON; boxes of four numbers; failures are empty."""
    snippet = F.regexp_extract(tag_block(text, "answer"), r"(?s)\[.*\]", 0)
    return F.coalesce(F.filter(_strict(snippet), lambda b: F.size(b["box_2d"]) == 4), _none())


POLICIES = {"eval": parse_eval, "reward": parse_reward, "labels": parse_labels, "repair": parse_repair, "snippet": parse_snippet, "distill": parse_distill, "harvest": parse_harvest, "yxyx": parse_yxyx}


def format_gate(text: Column) -> Column:
    """Whether a reply has a think block and an answer whose boxes are four ordered numbers with a description."""
    def fits(b: Column) -> Column:
        c = b["box_2d"]
        return (F.size(c) == 4) & (F.get(c, F.lit(0)) < F.get(c, F.lit(2))) & (F.get(c, F.lit(1)) < F.get(c, F.lit(3))) & b["description"].isNotNull()

    boxes = F.forall(parse_reward(text), lambda b: F.coalesce(fits(b), F.lit(False)))
    return F.coalesce(text.contains("<think>") & boxes, F.lit(False))
