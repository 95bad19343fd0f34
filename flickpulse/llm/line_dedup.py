"""Line dedup across documents by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line, by (document, place), is equal or one word edit away (a word put in, taken out or
exchanged). Lines are compared as lower-cased words; below ``FUZZY_WORDS`` words the edit bound is 0.

1. Equal lines are grouped by a 128-bit hash; each distinct line goes on once, so frequent lines weigh nothing.
2. One edit leaves the first or the second half of a line as it is. Lines without any partner that shares a half (halves of
   both possible lengths are keyed) emit no variants; nothing is lost by that, and most lines end here.
3. The others emit all variants of the edit bound: the line without its i-th word, for every i, as a hash that running
   exclusive-ors of (word, place) hashes give in one pass. Lines with equal variants at the same place differ by one
   exchanged word; a variant equal to a whole line tells of a word put in. Every variant keeps only its earliest line, an
   aggregate, so a variant that very many lines share makes no pairs.
4. The edit distance to that earliest line is verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flickpulse.llm.frames import own, without
from flickpulse.operators.scale import stage, value_ranks

FUZZY_WORDS = 8
_AT = ["doc_", "print_", "line_no"]


def _spaced(line: Column) -> Column:
    """The lower-cased words of a line with one space between them."""
    low = F.lower(line)
    uneven = F.lit(False)
    for c in ("  ", "\t", "\x0b", "\f", "\r"):
        uneven = uneven | F.contains(low, F.lit(c))
    return F.btrim(F.when(uneven, F.regexp_replace(low, r"[\x20\x09-\x0D]+", " ")).otherwise(low))


def _halves(s: Column, n: Column) -> list[Column]:
    """Hashes of the first and second half, as the longer (or equally long) and as the shorter line of a pair."""
    out = []
    for more in (0, 1):
        longer = n + more
        first = F.floor(longer / 2).cast("int")
        out += [F.xxhash64(F.lit("first"), longer, F.call_function("substring_index", s, F.lit(" "), first)),
                F.xxhash64(F.lit("second"), longer, F.call_function("substring_index", s, F.lit(" "), first - longer))]
    return [F.when(n >= FUZZY_WORDS, c) for c in out]


def _lines(docs: DataFrame) -> DataFrame:
    """Every line of every document with the hashes it is compared by; lines without words have none."""
    split = docs.select("doc_", "print_", F.posexplode(F.split("text_", "\n")).alias("line_no", "line"))
    worded = split.select(*_AT, _spaced(F.col("line")).alias("s")).withColumn(
        "n", F.when(F.col("s") == "", 0).otherwise(F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "), F.lit(""))) + 1))
    return worded.select(*_AT, "n", F.when(F.col("n") > 0, F.xxhash64("s")).alias("h1"),
                         F.when(F.col("n") > 0, F.xxhash64(F.lit(7), "s")).alias("h2"),
                         *[c.alias(f"half{i}") for i, c in enumerate(_halves(F.col("s"), F.col("n")))])


def _partnered(lines: DataFrame) -> DataFrame:
    """``h1, h2`` of lines that share a half with another distinct line."""
    halves = lines.filter(F.col("n") >= FUZZY_WORDS).select(
        "h1", "h2", F.explode(F.array(*[f"half{i}" for i in range(4)])).alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi")
    return halves.join(shared.select("half"), "half").select("h1", "h2").distinct()


def _with_words(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The words of distinct lines, from their earliest places."""
    at = distinct.select("h1", "h2", "n", "at", F.col("at.doc_").alias("doc_"), F.col("at.print_").alias("print_"),
                         F.col("at.line_no").alias("line_no"))
    texts = docs.join(at.select("doc_", "print_").distinct(), ["doc_", "print_"], "left_semi").dropDuplicates(["doc_", "print_"])
    lines = texts.select("doc_", "print_", F.posexplode(F.split("text_", "\n")).alias("line_no", "line"))
    return lines.join(at, _AT).select("h1", "h2", "n", "at", F.split(_spaced(F.col("line")), " ").alias("w"))


def _variants(lines: DataFrame) -> DataFrame:
    """``id, n, i, v1, v2``: hashes of every line without its i-th word; rows of the first word also have the hashes of
    the whole line, ``whole1, whole2``."""
    words = lines.select("id", "n", F.posexplode("w").alias("i", "word"))
    for s in (1, 2):  # two independent 64-bit hashes; a word after the deleted one moves one place down
        words = words.withColumns({f"f{s}": F.xxhash64(F.lit(s), "word", "i"), f"g{s}": F.xxhash64(F.lit(s), "word", F.col("i") - 1)})
    line = W.partitionBy("id")
    before = line.orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    through = line.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    keys = []
    for s in (1, 2):
        left = F.coalesce(F.bit_xor(f"f{s}").over(before), F.lit(0).cast("long"))
        right = F.bit_xor(f"g{s}").over(line).bitwiseXOR(F.bit_xor(f"g{s}").over(through))
        whole = F.when(F.col("i") == 0, F.bit_xor(f"f{s}").over(line))
        keys += [left.bitwiseXOR(right).alias(f"v{s}"), whole.alias(f"whole{s}")]
    return words.select("id", "n", "i", *keys)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one word edit apart."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differs = F.zip_with(longer, shorter, lambda x, y: ~x.eqNullSafe(y))
    first = F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)), F.size(longer)).cast("int")
    rest = lambda x, start: F.slice(x, start, F.greatest(F.lit(0), F.size(x) - start + 1))
    same_size = F.size(F.filter(differs, lambda d: d)) <= 1
    one_more = rest(longer, first + 1) == rest(shorter, first)
    return F.when(F.size(a) == F.size(b), same_size).otherwise(F.when(F.size(longer) == F.size(shorter) + 1, one_more)
                                                               .otherwise(False))


def _near(docs: DataFrame, lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """``h1, h2`` of distinct lines that have an earlier line one word edit away."""
    chosen = stage(distinct.join(_partnered(lines), ["h1", "h2"], "left_semi"))
    worded = stage(_with_words(docs, chosen))
    # numbers in the order of the places stand for the lines from here on
    order = value_ranks(worded, "at").select("at", F.col("n_before").alias("id"))
    worded = stage(worded.join(order, "at").select("id", "h1", "h2", "n", "w"))
    variants = stage(_variants(worded))
    by_place = ["v1", "v2", "n", "i"]
    several = variants.groupBy(*by_place).agg(F.min("id").alias("p"), F.max("id").alias("last")).filter("p < last")
    exchanged = variants.select("id", *by_place).join(several, by_place).filter("p < id").select("id", "p")
    whole = variants.filter("i = 0").select(F.col("id").alias("shorter"), (F.col("n") + 1).alias("n"),
                                            F.col("whole1").alias("v1"), F.col("whole2").alias("v2"))
    one_more = stage(variants.select("id", "v1", "v2", "n").join(whole, ["v1", "v2", "n"]).select("id", "shorter"))
    pairs = (exchanged.unionByName(one_more.filter("shorter < id").select("id", F.col("shorter").alias("p")))
             .unionByName(one_more.filter("id < shorter").groupBy(F.col("shorter").alias("id2")).agg(F.min("id").alias("p"))
                          .select(F.col("id2").alias("id"), "p")).distinct())
    own_words, other = worded.select("id", "h1", "h2", F.col("w").alias("a")), worded.select(F.col("id").alias("p"), F.col("w").alias("b"))
    return (pairs.join(own_words, "id").join(other, "p").filter(_one_edit(F.col("a"), F.col("b")))
            .select("h1", "h2").distinct())


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_lines_``, ``n_removed_`` and ``kept_text_`` (kept lines as they were).

    Lines are split at line feeds. Defined cases: lines without words are never removed; null text gives null
    ``kept_text_`` and no lines; a row with null id is left whole and takes nothing from others; rows that repeat an id and
    a text share their decisions, and rows that repeat only the id come in the order of their texts' hashes. Further
    columns are kept, but replaced where they have the name of a result or of ``doc_ print_ text_ gone_``. An empty
    table gives an empty result.
    """
    docs = without(docs, "n_lines_ n_removed_ kept_text_ doc_ print_ text_ gone_")
    keyed = docs.withColumns({"doc_": F.col(id_col).cast("long"), "print_": F.xxhash64(text_col), "text_": F.col(text_col)})
    slim = keyed.select("doc_", "print_", "text_").filter("doc_ is not null and text_ is not null")
    lines = stage(_lines(slim))
    distinct = stage(lines.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.min(F.struct(*_AT)).alias("at"), F.first("n").alias("n")))
    near = _near(slim, lines, distinct).withColumn("near", F.lit(True))
    judged = distinct.select("h1", "h2", "at").join(near, ["h1", "h2"], "left")
    gone = F.coalesce((F.struct(*_AT) != F.col("at")) | F.col("near"), F.struct(*_AT) != F.col("at"), F.lit(False))
    marks = stage(lines.select(*_AT, "h1", "h2").join(judged, ["h1", "h2"], "left").select(*_AT, gone.alias("gone"))
                  .groupBy("doc_", "print_").agg(F.sort_array(F.collect_set(F.struct("line_no", "gone"))).alias("marks"))
                  .select("doc_", "print_", F.transform("marks", lambda x: x["gone"]).alias("gone_")))
    removed = F.coalesce(F.size(F.filter("gone_", lambda g: g)), F.lit(0))
    kept = F.filter(F.split("text_", "\n"), lambda line, i: ~F.get("gone_", i))
    return (keyed.join(marks, ["doc_", "print_"], "left")
            .select(*own(docs), F.coalesce(F.size("gone_"), F.when(F.col("text_").isNull(), 0).otherwise(F.size(F.split("text_", "\n"))))
                    .cast("long").alias("n_lines_"), removed.cast("long").alias("n_removed_"),
                    F.when(removed > 0, F.array_join(kept, "\n")).otherwise(F.col("text_")).alias("kept_text_")))
