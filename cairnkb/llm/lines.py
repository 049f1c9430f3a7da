"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines within one edit of each other share a variant with one character deleted. All variants
of all lines would be as many as the corpus has characters, so two exact filters come first:
an edit leaves one half of a line as it is, and all but one of its blocks of 64 characters.
Lines that share a half, and then all but a block, with another one emit the variants of that
block, keyed by a hash of the rest, the block's place and the variant. A rest's hash is put
together from running ones over the blocks, so that a line costs as much as it has characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, save, scratch

#: In shorter lines an edit is over a tenth of the line, so they go only if they are the same as an earlier one.
EDIT_CHARS = 10
BLOCK = 64
_LAST = 9223372036854775807


def _line_keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def row_key() -> list[Column]:
    """``(doc, k1, k2)``: orders rows by doc_id (nulls last), and by 120 bits of their text's MD5 where they share it."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    half = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("long")
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), half(1).alias("k1"), half(16).alias("k2")]


def occurrences(docs: DataFrame) -> DataFrame:
    """``(at, h1, h2, line)``: each line that is not blank; ``at`` orders lines by their row's key and their number."""
    keyed = docs.select("text", *row_key())
    rows = keyed.select("doc", "k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(F.struct("doc", "k1", "k2", "no").alias("at"), *_line_keys(F.col("line")), "line")


def _halves(line: Column) -> list[Column]:
    """Hashes of the halves that a line shares with one of its own length or a longer one, and with a shorter one."""
    n = F.length(line)
    keys = []
    for shorter in (n, n - 1):
        front = (shorter / 2).cast("int")
        keys.append(F.xxhash64(F.lit("front"), shorter, F.left(line, front)))
        keys.append(F.xxhash64(F.lit("back"), shorter, F.right(line, shorter - front)))
    return [key.alias(f"half{i}") for i, key in enumerate(keys)]


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)


def _blocks(texts: DataFrame) -> DataFrame:
    """``(h1, h2, first, block, role, inner, rest)``: each block of each line, and a hash of all else that the line holds.

    In the role ``long`` a block may lose a character, or have one changed; in ``short`` it
    has lost one, so its text ends a character earlier and the blocks after it are one off.
    """
    n = F.length("line")
    off = F.concat(F.array(F.left("line", F.lit(BLOCK - 1))), F.regexp_extract_all(F.substring("line", F.lit(BLOCK), n), F.lit(f"(?s).{{1,{BLOCK}}}"), 0))
    even = F.regexp_extract_all("line", F.lit(f"(?s).{{1,{BLOCK}}}"), 0)
    one = F.arrays_zip(even.alias("even"), off.alias("off"))
    rows = texts.select("h1", "h2", "first", n.alias("n"), F.posexplode(one).alias("block", "x"))
    rows = rows.select("h1", "h2", "first", "n", "block", F.coalesce("x.even", F.lit("")).alias("even"), F.coalesce("x.off", F.lit("")).alias("off"))
    own = lambda x: F.when(F.col(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64("block", x))
    rows = rows.withColumns({"e": own("even"), "o": own("off")})
    line = Window.partitionBy("h1", "h2")
    before, all_of = line.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow), line.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "h1", "h2", "first", "n", "block", "even", F.bit_xor("e").over(before).bitwiseXOR(F.col("e")).alias("front"),
        F.bit_xor("e").over(before).bitwiseXOR(F.bit_xor("e").over(all_of)).alias("back"),
        F.bit_xor("o").over(before).bitwiseXOR(F.bit_xor("o").over(all_of)).alias("back_off"),
    )
    long = F.struct(F.lit("long").alias("role"), F.col("even").alias("inner"), F.xxhash64("n", "block", "front", "back").alias("rest"))
    short = F.struct(F.lit("short").alias("role"), F.left("even", F.lit(BLOCK - 1)).alias("inner"), F.xxhash64(F.col("n") + 1, "block", "front", "back_off").alias("rest"))
    return rows.select("h1", "h2", "first", "block", F.explode(F.array(long, short)).alias("x")).select("h1", "h2", "first", "block", "x.*")


def near_lines(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(h1, h2)`` of the distinct lines that have an earlier line within one edit.

    Within a key of substitutions all lines are one edit apart, so the earliest is the
    witness of the rest; a key of insertions has one shorter line, the witness of, or
    witnessed by, the earliest longer one. No pairs within a group are formed. One edit apart
    is then checked in full: what is left without the variants' characters must be the same.
    """
    halves = firsts.select("h1", "h2", F.explode(F.array("half0", "half1", "half2", "half3")).alias("half"))
    some = halves.join(_repeated(halves, "half"), "half", "left_semi").select("h1", "h2").distinct()
    some = save(some.join(firsts.select("h1", "h2", "first"), ["h1", "h2"]), "half_sharing")
    # by place, as one line may be everywhere; and a sort-merge join at every size, as what shares a half grows with the corpus
    placed = lines.select(F.col("at").alias("first"), "h1", "h2", "line").join(some.hint("merge"), ["first", "h1", "h2"])
    texts = save(placed.dropDuplicates(["h1", "h2"]), "half_sharing_lines")

    cut = save(_blocks(texts), "blocks")
    alike = cut.join(_repeated(cut, "rest"), "rest", "left_semi")
    long = alike.filter("role = 'long' and inner <> ''").select("*", F.explode(F.sequence(F.lit(1), F.length("inner"))).alias("i"))
    less = F.concat(F.left("inner", F.col("i") - 1), F.substring("inner", F.col("i") + 1, F.lit(BLOCK)))
    long = long.withColumn("less", less)
    who = lambda place: F.struct("first", "h1", "h2", place.alias("place"))
    place = F.col("block") * BLOCK + F.col("i")
    variants = save(
        long.select(F.xxhash64("rest", "less", "i").alias("key"), F.lit("swap").alias("role"), who(place).alias("who"))
        .unionByName(long.groupBy(F.xxhash64("rest", "less").alias("key"), F.lit("long").alias("role"), "first", "h1", "h2").agg(F.min(place).alias("place")).select("key", "role", who(F.col("place")).alias("who")))
        .unionByName(alike.filter("role = 'short'").select(F.xxhash64("rest", "inner").alias("key"), F.lit("short").alias("role"), who(F.lit(0)).alias("who"))),
        "variants",
    )
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("who")))
    groups = variants.groupBy("key").agg(of("swap").alias("swap"), of("long").alias("long"), of("short").alias("short"), F.count("*").alias("n")).filter("n > 1")
    met = variants.join(groups, "key")
    witness = (
        F.when(F.col("role") == "swap", F.col("swap")).when(F.col("role") == "long", F.col("short")).otherwise(F.col("long"))
    )
    pairs = met.select("who", witness.alias("witness")).filter("witness.first < who.first").select(
        F.col("who.h1").alias("h1"), F.col("who.h2").alias("h2"), F.col("who.place").alias("place"),
        F.col("witness.h1").alias("w1"), F.col("witness.h2").alias("w2"), F.col("witness.place").alias("w_place"),
    ).distinct()
    seen = texts.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("line").alias("other"))
    checked = pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(seen, ["w1", "w2"])
    return checked.filter(_without("line", "place") == _without("other", "w_place")).select("h1", "h2").distinct()


def _without(line: str, place: str) -> Column:
    """A line without its character at a place from 1; whole at 0."""
    at = F.col(place).cast("int")
    return F.when(at == 0, F.col(line)).otherwise(F.concat(F.left(line, at - 1), F.substring(line, at + 1, F.length(line))))


def removed_lines(docs: DataFrame, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``(doc, k1, k2, removed)``: by ``row_key`` the numbers, from 0, of the lines that go."""
    lines = occurrences(docs)
    with scratch() as keep:
        firsts = lines.select("at", "h1", "h2", F.length("line").alias("size"), *_halves(F.col("line"))).groupBy("h1", "h2")
        halves = [F.min(f"half{i}").alias(f"half{i}") for i in range(4)]
        firsts = save(firsts.agg(F.min("at").alias("first"), F.count("*").alias("n"), F.min("size").alias("size"), *halves), "lines")
        long = F.length("line") >= edit_chars
        near = near_lines(lines.filter(long), firsts.filter(F.col("size") >= edit_chars)).withColumn("near", F.lit(True))
        fate = keep(save(firsts.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").filter("near or n > 1"), "fate"))
    gone = lines.select("at", "h1", "h2").join(fate.hint("merge"), ["h1", "h2"]).filter("near or at <> first")
    return gone.groupBy("at.doc", "at.k1", "at.k2").agg(F.collect_set("at.no").alias("removed"))


def dedup_lines(docs: DataFrame, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, or are within one edit of it.

    Lines end at '\\n'; an edit is one character put in, left out or changed. Rows come in the
    order of doc_id (nulls last) and, where they share it, of their text's MD5; lines in that
    order and by place, and the earliest stays. A line goes whether or not its earlier
    neighbour goes too. Blank lines (ASCII space alone) always stay, and lines under
    ``edit_chars`` characters neither go nor make others go for an edit. Adds
    ``n_lines`` and ``n_removed`` (long; replacing columns of these names); other columns stay,
    whatever their names. A null text stays null with 0 lines; an empty one is one empty line.
    Rows of one doc_id and one text are one row repeated: they get the same result, and none
    makes another's lines go. A document's removed line numbers are the largest group gathered.
    """
    doc, k1, k2, removed, lines = fresh(docs, "_doc", "_k1", "_k2", "_removed", "_lines")
    gone = removed_lines(docs.select("doc_id", "text"), edit_chars).withColumnRenamed("removed", removed)
    own = dict(zip((doc, k1, k2), row_key(), strict=True))
    joined = docs.withColumns(own).join(gone, (F.col(doc) == gone["doc"]) & (F.col(k1) == gone["k1"]) & (F.col(k2) == gone["k2"]), "left")
    # the lines are read more than once below, so that Spark splits each text once and not inside the lambda
    text, at = docs["text"], F.col(lines)
    n = F.when(text.isNull(), 0).otherwise(F.size(at))
    numbers = F.array_except(F.sequence(F.lit(0), F.size(at) - 1), removed)
    kept = F.array_join(F.transform(numbers, lambda i: F.get(at, i)), "\n")
    changed = text.isNotNull() & F.col(removed).isNotNull()
    n_gone = F.when(changed, F.size(F.filter(removed, lambda i: i < F.size(at)))).otherwise(0)
    split = joined.select(*[docs[c] for c in docs.columns], removed, F.split(text, "\n", -1).alias(lines))
    new = {"text": F.when(changed, kept).otherwise(text), "n_lines": n.cast("long"), "n_removed": n_gone.cast("long")}
    return split.withColumns(new).drop(removed, lines)
