"""Headed text to chunks: front matter, sections, packing of paragraphs, features, search text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import with_stems
from ..functions.strings import fold_accents

TARGET = 1400
LEAST = 60
PAGE = 256
HEADER = r"(?s)^---\n(.*?)\n---\n"


def front_matter(text: Column, field: str) -> Column:
    """A scalar field of the header between ``---`` lines; '' if absent."""
    head = F.regexp_extract(text, HEADER, 1)
    return F.trim(F.regexp_extract(head, rf"(?m)^{field}:[ ]*([^\n]*)$", 1))


def front_fields(text: Column) -> Column:
    """The header's fields as a map of ``struct<kind, items>``; kind is ``null``, ``scalar`` or ``list``.

    A field begins at the start of a line, ``name: value``; a list is ``[a, b]`` on that line,
    or lines ``- a`` after a name without a value. An empty value, ``null`` and ``~`` are null
    and have no items, an empty list has none either. Quotes around an item go. Other lines are
    passed over; of a name given twice the last counts. Without a header the map is empty.
    """
    entries = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_extract(F.coalesce(text, F.lit("")), HEADER, 1)), r"\n(?=[A-Za-z_][A-Za-z0-9_]*:)"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:"))
    bare = lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2")

    def parsed(entry: Column) -> Column:
        name, value = F.regexp_extract(entry, r"^([A-Za-z_][A-Za-z0-9_]*):", 1), F.trim(F.regexp_extract(entry, r"^[A-Za-z_][A-Za-z0-9_]*:([^\n]*)", 1))
        inline = F.filter(F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), bare), lambda x: x != "")
        block = F.transform(F.regexp_extract_all(entry, F.lit(r"\n[ ]*-[ ]+([^\n]*)"), 1), bare)
        nothing = F.array().cast("array<string>")
        kind = F.when(value.rlike(r"^\[.*\]$"), "list").when(~value.isin("", "null", "~"), "scalar").when((value == "") & (F.size(block) > 0), "list").otherwise("null")
        items = F.when(kind == "scalar", F.array(bare(value))).when(kind == "null", nothing).when(value == "", block).otherwise(inline)
        return F.named_struct(F.lit("name"), name, F.lit("value"), F.named_struct(F.lit("kind"), kind, F.lit("items"), items))

    rows = F.transform(entries, parsed)
    last = F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda y: y["name"] == x["name"]))
    return F.map_from_entries(last)


def front_list(text: Column, field: str) -> Column:
    """A field of the header as an array: a list's items, or those of a scalar that commas part; none if null or absent."""
    found = F.try_element_at(front_fields(text), F.lit(field))
    split = F.filter(F.transform(F.split(F.array_join(found["items"], ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(found["kind"] == "list", found["items"]).otherwise(split), F.array().cast("array<string>"))


def body(text: Column) -> Column:
    """What follows the header."""
    return F.regexp_replace(text, HEADER, "")


def sections(text: Column) -> Column:
    """The parts at level-2 headings, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n(?=## )"), lambda x: F.btrim(x, F.lit(" \n\r\t"))), lambda x: x != "")


def title(section: Column) -> Column:
    """The heading's text; ``intro`` for a part without one."""
    found = F.trim(F.regexp_extract(section, r"^## ([^\n]+)", 1))
    return F.when(section.startswith("## "), found).otherwise("intro")


def pack_paragraphs(text: Column, target: int = TARGET, separator: str = "\n\n") -> Column:
    """Paragraphs put together greedily: a new block starts where the next one would pass ``target``.

    Each paragraph counts with two characters of separator, the last one too.
    """
    none = F.array().cast("array<string>")
    # blocks are put together by the page, so that no long array is copied for each of them
    start = F.struct(F.array().cast("array<array<string>>").alias("pages"), none.alias("page"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["n"] + F.length(p) + 2 > target) & acc["cur"].isNotNull()
        turned = full & (F.size(acc["page"]) >= PAGE)
        return F.struct(
            F.when(turned, F.concat(acc["pages"], F.array(acc["page"]))).otherwise(acc["pages"]).alias("pages"),
            F.when(turned, F.array(acc["cur"])).when(full, F.concat(acc["page"], F.array(acc["cur"]))).otherwise(acc["page"]).alias("page"),
            F.when(full | acc["cur"].isNull(), p).otherwise(F.concat(acc["cur"], F.lit(separator), p)).alias("cur"),
            (F.when(full, 0).otherwise(acc["n"]) + F.length(p) + 2).alias("n"),
        )

    return F.aggregate(F.split(text, r"\n{2,}"), start, step, lambda acc: F.concat(F.flatten(acc["pages"]), acc["page"], F.array(acc["cur"])))


def chunks(files: DataFrame, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """``files(path, text)`` as chunks: ``(chunk_id, path, section, ordinal, text, priority, tags, content_hash)``.

    Sections over ``target`` characters are split at rule lines and then packed; what has
    fewer than ``least`` characters beside its heading is dropped. Ids hash path, section and
    ordinal, so that equal titles stay apart; no two chunks of a file have one ordinal.
    """
    # a section has no more blocks than the file has breaks
    step = F.when(F.size(F.split("text", r"\n{2,}|\n---")) < 1000, 1000).otherwise(1 << 32).alias("step")
    parts = files.select(
        "path", step, front_matter(F.col("text"), "priority").alias("priority"), front_list(F.col("text"), "tags").alias("tags"),
        F.posexplode(sections(body(F.col("text")))).alias("s", "section_text"),
    )
    long = F.length("section_text") > target
    blocks = F.flatten(F.transform(F.filter(F.transform(F.split("section_text", r"\n---+\n"), lambda x: F.btrim(x, F.lit(" \n\r\t"))), lambda x: x != ""), lambda x: F.when(F.length(x) <= target, F.array(x)).otherwise(pack_paragraphs(x, target))))
    cut = parts.select("path", "step", "priority", "tags", "s", title(F.col("section_text")).alias("section"), F.posexplode(F.when(long, blocks).otherwise(F.array("section_text"))).alias("b", "text"))
    kept = cut.filter(F.length(F.trim(F.regexp_replace("text", r"^## [^\n]*", ""))) >= least)
    ordinal = F.col("s").cast("long") * F.col("step") + F.col("b")
    return kept.select(
        F.concat(F.lit("kb_"), F.substring(F.md5(F.concat_ws("::", "path", "section", ordinal.cast("string")).cast("binary")), 1, 16)).alias("chunk_id"),
        "path", F.left("section", F.lit(80)).alias("section"), ordinal.cast("long").alias("ordinal"), "text",
        F.when(F.col("priority") == "", "medium").otherwise(F.col("priority")).alias("priority"), F.array_join("tags", " ").alias("tags"),
        F.sha2("text", 256).alias("content_hash"),
    )


def features(chunk: DataFrame, stop_words: list[str], types: list[str], signature: str, name: str, marker: str = "Signature") -> DataFrame:
    """``has_code``, ``has_signature``, ``function_name``, ``signature``, ``return_type`` of ``chunk(section, text)``.

    What a function looks like is the caller's to say: ``signature`` is a pattern whose first
    group is one, ``types`` are the words one can begin with, ``marker`` announces one, in bold
    or near the top. A function's name is the title's first word if it is an identifier with
    a capital, no stop word, and the section has a signature or the word fits ``name``.
    """
    word = F.regexp_replace(F.element_at(F.split(F.trim("section"), " "), 1), r"[()]+$", "")
    signed = F.contains("text", F.lit(f"**{marker}**")) | F.contains(F.left("text", F.lit(80)), F.lit(marker))
    named = word.rlike("^[A-Z][A-Za-z0-9_]*$") & ~word.isin(*stop_words) & (signed | word.rlike(name))
    found = F.trim(F.regexp_extract("text", signature, 1))
    kind = F.regexp_extract(found, r"^(\w*)", 1)
    return chunk.select(
        "*", F.contains("text", F.lit("```")).alias("has_code"), signed.alias("has_signature"), F.when(named, word).otherwise("").alias("function_name"),
        F.left(found, F.lit(200)).alias("signature"), F.when(kind.isin(*types), kind).otherwise("").alias("return_type"),
    )


def search_text(text: Column, name: Column, signature: Column, tags: Column, repeats: int = 3) -> Column:
    """The text a lexical index sees: the name repeated and split at capitals; tags only where there is no name."""
    parts = F.array_join(F.regexp_extract_all(name, F.lit("[A-Z][a-z0-9]+"), 0), " ")
    named = F.concat_ws(" ", F.array_join(F.array_repeat(name, repeats), " "), parts)
    return F.trim(F.concat_ws(" ", text, F.when(name != "", named).otherwise(tags), F.nullif(signature, F.lit(""))))


# What a word and a part of a word is to the index; questions and texts must be cut alike.
WORD = "[A-Za-z0-9À-ɏ_\\-]+"
PART = "[A-Z][a-z0-9]+|[a-zÀ-ɏ]+|[0-9]+"


def terms(text: Column) -> Column:
    """Search terms: each word in lower case, without accents if it has any, and its parts if Pascal-cased."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)

    def folded(x: Column) -> Column:
        return F.when(F.octet_length(x) == F.length(x), x).otherwise(fold_accents(x))  # most words are ASCII

    def of(w: Column) -> Column:
        low, none = F.lower(w), F.array().cast("array<string>")
        parts = F.regexp_extract_all(w, F.lit(PART), 0)
        split = F.flatten(F.transform(parts, lambda p: F.array(F.lower(p), folded(F.lower(p)))))
        plain = F.when(F.octet_length(low) == F.length(low), none).otherwise(F.array_compact(F.array(F.nullif(fold_accents(low), low))))
        every = F.concat(F.array(low), plain, F.when(F.size(parts) > 1, split).otherwise(none))
        return F.when(w.rlike("^[a-z]+$"), F.array(w)).otherwise(every)  # most words are one part, as they are

    return F.flatten(F.transform(words, of))


def stemmed_terms(text: Column) -> Column:
    """``terms``, and after them, once each, the stems that are not among these of plain words: four small letters or more."""
    return with_stems(terms(text), "[a-zà-ÿœæ]{4,}")


def html_text(html: Column) -> Column:
    """A page's text: scripts, styles and tags out, white space joined."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(plain, "[ \\n\\r\\t]+", " "))
