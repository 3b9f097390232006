"""Text expressions: white space, HTML documents and ground-truth scripts, inline styles, word splitting, labels in text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One HTML document of a response, the ground-truth script of a page, and print rules; fixed patterns.
DOCUMENT = r"(?is)<!DOCTYPE html>.*?</html>"
GT_SCRIPT = r"(?is)<script[^>]*id=[\"']GT[\"'][^>]*>(.*?)</script>"
PAGE_RULE = r"@page\s*\{[^}]*\}"
RTL = r"[\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"


def collapse_spaces(s: Column) -> Column:
    """STR1: white space at the ends goes, each run within becomes one space."""
    return F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\s+", " ")


def html_documents(s: Column) -> Column:
    """STR4: all documents in a response, shortest matches in order."""
    return F.regexp_extract_all(s, F.lit(DOCUMENT), F.lit(0))


def gt_script(html: Column) -> Column:
    """STR5: the content of the ground-truth script without surrounding white space, or null."""
    inner = F.regexp_extract(html, GT_SCRIPT, 1)
    return F.when(F.regexp_like(html, F.lit(GT_SCRIPT)), F.regexp_replace(inner, r"^\s+|\s+$", ""))


def without_gt_script(html: Column) -> Column:
    return F.regexp_replace(html, GT_SCRIPT, "")


def print_ready(html: Column, style: str) -> Column:
    """STR6: print rules go; a style is put before the first end of head."""
    return F.regexp_replace(F.regexp_replace(html, PAGE_RULE, ""), r"(?is)^(.*?)</head>", f"$1<style>{style}</style></head>")


def element_text(tag: Column, value: Column, text: Column) -> Column:
    """STR9: an input's value, any other element's text, stripped."""
    return F.regexp_replace(F.when(tag == "input", value).otherwise(text), r"^\s+|\s+$", "")


def style_millimetres(style: Column, name: str) -> Column:
    """STR10: a length of an inline style in whole millimetres; null for units other than mm and cm."""
    number = F.regexp_extract(style, rf"(?:^|;)\s*{name}\s*:\s*([0-9.]+)(mm|cm)", 1)
    unit = F.regexp_extract(style, rf"(?:^|;)\s*{name}\s*:\s*([0-9.]+)(mm|cm)", 2)
    return F.when(unit == "mm", number.try_cast("double").cast("int")).when(unit == "cm", (number.try_cast("double") * 10).cast("int"))


def rotation_degrees(style: Column) -> Column:
    """STR11: the angle of a rotate() in degrees, or null."""
    return F.nullif(F.regexp_extract(style, r"rotate\(\s*([-+]?\d*\.?\d+)\s*deg\s*\)", 1), F.lit("")).try_cast("double")


def is_right_to_left(s: Column) -> Column:
    """STR12."""
    return s.rlike(RTL)


def balanced_parts(word: Column, longest: int) -> Column:
    """STR13: a word in as few parts of at most ``longest`` as possible, near-equal, longer parts first."""
    n = F.length(word)
    k = F.ceil(n / longest).cast("int")
    size, extra = F.floor(n / k).cast("int"), (n % k).cast("int")
    start = lambda i: i * size + F.least(i, extra) + 1
    parts = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substring(word, start(i), start(i + 1) - start(i)))
    return F.when(n <= longest, F.array(word)).otherwise(parts)


def digit_aware_parts(word: Column, longest: int, digits: int) -> Column:
    """STR14: runs of digits in chunks of at most min(digits, longest), other runs by balanced_parts; the empty word is its own part."""
    most = min(digits, longest)
    chunks = lambda run: F.transform(F.sequence(F.lit(0), F.floor((F.length(run) - 1) / most).cast("int")), lambda i: F.substring(run, i * most + 1, F.lit(most)))
    runs = F.regexp_extract_all(word, F.lit(r"\d+|\D+"), F.lit(0))
    return F.when(F.length(word) == 0, F.array(word)).otherwise(F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), chunks(r)).otherwise(balanced_parts(r, longest)))))


def spaced_parts(text: Column) -> Column:
    """STR15: parts of a text at single spaces, empty ones left out, each with whether a space came before it."""
    indexed = F.transform(F.split(text, " "), lambda p, i: F.struct(p.alias("part"), (i > 0).alias("space_before")))
    return F.filter(indexed, lambda x: x["part"] != "")


def padded(tokens: Column) -> Column:
    """STR17: tokens padded on the right to the longest."""
    most = F.array_max(F.transform(tokens, F.length))
    return F.transform(tokens, lambda t: F.concat(t, F.repeat(F.lit(" "), most - F.length(t))))


def entity_items(s: Column) -> Column:
    """STR19: ``k=v`` items of a piped string; items without exactly one ``=`` are left out."""
    good = F.filter(F.split(s, r"\|"), lambda x: F.size(F.split(x, "=")) == 2)
    return F.transform(good, lambda x: F.struct(F.split(x, "=")[0].alias("key"), F.split(x, "=")[1].alias("value")))


def labelled_text(words: Column, labels: Column) -> Column:
    """STR21: word and label in turn."""
    return F.array_join(F.transform(F.arrays_zip(words.alias("w"), labels.alias("l")), lambda x: F.concat_ws(" ", x["w"], x["l"])), " ")


def labelled_words(s: Column, tags: list[str]) -> Column:
    """STR20: (word, label) pairs of a labelled text; only O and B-/I- with a known tag count as labels."""
    pattern = r"(\S+?)\s((?:B-|I-)(?:" + "|".join(tags) + r")|O)(?:\s|$)"
    return F.arrays_zip(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)).alias("word"), F.regexp_extract_all(s, F.lit(pattern), F.lit(2)).alias("label"))


def base_id(sample_id: Column) -> Column:
    """STR24: an id without its page or subsample suffix."""
    return F.when(F.contains(sample_id, F.lit("_page_")), F.split_part(sample_id, F.lit("_page_"), F.lit(1))).otherwise(F.split_part(sample_id, F.lit("_subsample_"), F.lit(1)))


def qa_text(question: Column, answer: Column) -> Column:
    """STR25."""
    return F.concat(F.lit("Question: "), question, F.lit(" Answer: "), answer)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """PRJ24: a prompt template with its {placeholders} filled in."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def uniform(*key: Column | str, salt: str, seed: int = 42) -> Column:
    """A reproducible number in [0, 1) from a key: 13 hex digits of an MD5, the same in any SQL engine."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key], F.lit(salt), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


#: Writes the places of all elements of some classes to a hidden element when a page is loaded.
POSITION_SCRIPT = """<script>
window.addEventListener('load', function() {
    const positionsByClass = {};
    %s.forEach(className => {
        positionsByClass[className] = Array.from(document.querySelectorAll('.' + className)).map((element, index) => {
            const rect = element.getBoundingClientRect();
            return {index: index, className: className, text: element.textContent.trim(), x: rect.x, y: rect.y, width: rect.width, height: rect.height};
        });
    });
    const dataDiv = document.createElement('div');
    dataDiv.id = '__positions_data__';
    dataDiv.style.display = 'none';
    dataDiv.textContent = JSON.stringify(positionsByClass);
    document.body.appendChild(dataDiv);
});
</script>
"""


def with_position_script(html: Column, classes: tuple[str, ...] = ("handwritten",)) -> Column:
    """STR8: the script before each ``</body>``, or at the end of a page without one."""
    script = POSITION_SCRIPT % json.dumps(list(classes))
    return F.when(F.contains(html, F.lit("</body>")), F.replace(html, F.lit("</body>"), F.lit(script + "</body>"))).otherwise(F.concat(html, F.lit(script)))


def dumped_positions(dump: Column, return_code: Column) -> Column:
    """STR8: class to its elements in pixels and points (96 pixels an inch) from a DOM dump; empty after a failure, without the element or without JSON."""
    kind = "map<string,array<struct<index:int,text:string,x:double,y:double,width:double,height:double>>>"
    data = F.regexp_extract(dump, r'<div id="__positions_data__"[^>]*>([^<]+)</div>', 1)
    names = ("x", "y", "width", "height")
    place = lambda p: F.struct(p["index"].alias("index"), p["text"].alias("text"), *[(p[k] / 96 * 72).alias(f"{k}_points") for k in names], *[p[k].alias(f"{k}_pixels") for k in names])
    parsed = F.coalesce(F.from_json(F.when(return_code == 0, data), kind), F.create_map().cast(kind))
    return F.transform_values(parsed, lambda _, v: F.transform(v, place))


#: Names that encoders have in reports; fixed values.
DISPLAY_NAMES = {"layout": "layoutlm", "image": "clip", "text": "sentence", "paper_kernel=4": "pooled", "combined": "combined"}


def display_name(name: Column) -> Column:
    """STR27: the name of an embedding in reports, null if unknown."""
    return F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])[name]


def word_image_name(owner: Column, block_no: Column, line_no: Column, word_no: Column) -> Column:
    """STR18: the file name of a word's image; X stands for a block or line that isn't known."""
    part = lambda letter, n: F.concat(F.lit(letter), F.coalesce(n.cast("string"), F.lit("X")))
    return F.concat(F.concat_ws("_", owner, part("b", block_no), part("l", line_no), part("w", word_no)), F.lit(".png"))


def as_words(text: Column) -> Column:
    """STR29: the words of a text between white space; none of an empty one, null of null."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")
