"""Text functions as column expressions: words, slugs, keys, estimates, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words and is stripped (Unicode white space and 1C-1F).
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Fixed value: estimated tokens per word.
TOKENS_PER_WORD = 1.333
#: Line ends.
LINE_END = r"\R|[\x1c-\x1e]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(F.coalesce(text, F.lit("")))), F.lit(0)).cast("long")


def est_tokens(n_words: Column) -> Column:
    return F.floor(n_words * F.lit(TOKENS_PER_WORD)).cast("long")


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.array_join(words(text), " ")


def lines(text: Column) -> Column:
    """Lines of a text; a final line end begins no further line."""
    parts = F.split(text, LINE_END)
    return F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def clean_lines(text: Column) -> Column:
    """Each line collapsed, empty lines dropped."""
    return F.array_join(F.filter(F.transform(lines(text), collapse), lambda x: x != ""), "\n")


def tidy(text: Column) -> Column:
    """Each line stripped, three line ends or more become two, stripped as a whole."""
    return strip(F.regexp_replace(F.array_join(F.transform(lines(text), strip), "\n"), r"\n{3,}", "\n\n"))


def slugify(title: Column) -> Column:
    """At most 60 of a-z, 0-9 and single dashes; ``untitled`` if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(dashed, 1, 60), "-+$", ""), F.lit("")), F.lit("untitled"))


def snippet(text: Column, most: int = 60) -> Column:
    """The beginning of a longer text, cut at its last space, with three dots."""
    flat = collapse(text)
    head = F.substring(flat, 1, most)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("...")))


def author_label(name: Column, score: Column) -> Column:
    return F.when(score.isNull(), name).otherwise(F.format_string("%s (%+d)", name, score))


def stem_title(path: Column) -> Column:
    """A file's name without extension; dashes and underscores as spaces."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(strip(F.regexp_replace(stem, "[_-]+", " ")), F.lit("")), stem)


def segment_key(url: Column, key: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.nullif(key, F.lit("")), title)


def defragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def markdown_twins(url: Column) -> Column:
    """Addresses to try for a linked page: its Markdown twin first, then the page; Markdown is its own twin."""
    plain, stem = defragment(url), without_query(url)
    twin = F.concat(stem, F.when(stem.endswith("/"), F.lit("index.html.md")).otherwise(F.lit(".md")))
    return F.when(F.lower(stem).rlike(r"\.(md|mdx|markdown|txt)$"), F.array(plain)).otherwise(F.array(twin, plain))


def deep_link_template(origin: Column) -> Column:
    """Address of a moment {s} (seconds) of a recording; null where the host has none."""
    base = defragment(origin)
    tube = F.concat(base, F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("t={s}s"))
    media = F.lower(without_query(origin)).rlike(r"\.(mp3|m4a|m4b|aac|wav|flac|ogg|oga|opus|webm|mp4|m4v|mov|mkv)$")
    return (
        F.when(base.rlike(r"^https?://([\w-]+\.)?(youtube\.com|youtu\.be)/"), tube)
        .when(base.rlike(r"^https?://(www\.|player\.)?vimeo\.com/"), F.concat(base, F.lit("#t={s}s")))
        .when(base.rlike("^https?://") & media, F.concat(base, F.lit("#t={s}")))
    )


def at_second(template: Column, second: Column) -> Column:
    return F.replace(template, F.lit("{s}"), second.cast("string"))


def iso_date(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))


def clock(second: Column) -> Column:
    """[hh:mm:ss]"""
    return F.format_string("[%02d:%02d:%02d]", F.floor(second / 3600), F.floor(second % 3600 / 60), F.floor(second % 60))
