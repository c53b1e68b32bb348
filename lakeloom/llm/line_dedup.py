"""Line deduplication by a deletion-neighbourhood join, in DataFrame expressions only.

Lines are compared in lower case without punctuation. A line is dropped if an earlier one (smaller doc_id, then smaller line
number) has the same words, or, from `near_words` words on, words that differ by one edit: a word replaced, added or left
out. Two lines are within one edit if one equals the other without a word, or both are equal without their i-th word, so
every line gives its deletion neighbourhood, itself and each variant with one word left out, as hashed keys, and equal keys meet.

Most lines have no near copy, and for them the neighbourhood need not be made: an edit leaves either the first or the last half of
a line as it is. Only lines that share a half with a different line take part in the join.

Nothing gathers a group. Groups are aggregated before they are shuffled and joined back, which splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.shared import carried, may_hold, restored
from lakeloom.sources.lake import committed

LINE_END = "\n"
# Runs of anything but letters and digits become one space. A run that is one space already is not matched, as most are, and the
# commonest letters are named first, which spares their look-up.
OTHER = r"[^a-z0-9\p{L}\p{N} ][^a-z0-9\p{L}\p{N}]*| [^a-z0-9\p{L}\p{N}]+"
OTHER_BUT_LINE_END = r"[^a-z0-9\p{L}\p{N}\n ][^a-z0-9\p{L}\p{N}\n]*| [^a-z0-9\p{L}\p{N}\n]+"
# Lines of one document have places below each other; a document without an id comes last.
PER_DOCUMENT = 1 << 31
LAST = 1 << 63


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), OTHER, " "))


def place(doc_id: Column, line_no: Column) -> Column:
    """The order of lines as one number."""
    doc = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(LAST)).cast("decimal(20,0)"))
    return (doc * F.lit(PER_DOCUMENT).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")).cast("decimal(32,0)")


def half(n: Column) -> Column:
    """How many words of either end an edit may leave alone: at most half, in coarse steps, so that most lines of n and of
    n - 1 words have the same."""
    most = F.floor(n / 2)
    power = F.pow(F.lit(2), F.floor(F.log2(most)))
    return F.when(most >= power * 1.5, power * 1.5).otherwise(power).cast("int")


def halves(words: Column, own: Column, shorter: Column) -> Column:
    """The hashed ends of `own` words, and those of `shorter` words, if that differs. Both are columns, not expressions, which each
    branch would work out anew."""
    def ends(size: Column) -> list[Column]:
        return [F.xxhash64(F.lit("first"), size, F.call_function("substring_index", words, F.lit(" "), size)),
                F.xxhash64(F.lit("last"), size, F.call_function("substring_index", words, F.lit(" "), -size))]
    return F.when(own == shorter, F.array(*ends(own))).otherwise(F.array(*ends(own), *ends(shorter)))


def lines_of(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """(doc_id, text_hash, line_no, h1, h2, halves) of each line of at least `min_words` words; halves is null for short ones."""
    # A whole text is normalised at once, and behind the generator no filter repeats that work.
    whole = F.regexp_replace(F.lower("text"), OTHER_BUT_LINE_END, " ")
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(whole, LINE_END, -1)).alias("line_no", "line"))
    words = split.withColumn("words", F.trim("line"))
    enough = F.lit(True) if min_words < 2 else F.substring_index("words", " ", min_words - 1) != F.col("words")
    counted = words.filter((F.col("words") != "") & enough).select(
        "doc_id", "text_hash", "line_no", "words",
        (F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) + 1).alias("n"))
    sized = counted.withColumns({"own": half(F.col("n")), "shorter": half(F.col("n") - 1)})
    return sized.select("doc_id", "text_hash", "line_no", *identity(F.col("words")),
                        F.when(F.col("n") >= near_words, halves(F.col("words"), F.col("own"), F.col("shorter"))).alias("halves"))


def identity(words: Column) -> tuple[Column, Column]:
    """128 bits that stand for the words of a line."""
    return F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("line"), words).alias("h2")


def near_candidates(lines: DataFrame) -> DataFrame:
    """(h1,) of the lines that share half of their words with a different line."""
    keys = lines.filter("halves IS NOT NULL").select("h1", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high")
    return keys.join(shared.select("half"), "half", "left_semi").select("h1").distinct()


def spot(place: Column, h1: Column) -> Column:
    """A number for the line at a place. Only lines of rows that share an id, or have none, share a place; those are in the order of
    their hashes."""
    low = h1.bitwiseAND(F.lit((1 << 32) - 1)).cast("decimal(10,0)")
    return (place.cast("decimal(29,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(38,0)")


def candidate_words(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(spot, place, words) of each candidate line (doc_id, text_hash, line_no, place, spot, h1, h2)."""
    line = F.struct("line_no", "place", "spot", "h1", "h2")
    wanted = candidates.groupBy("doc_id", "text_hash").agg(F.collect_list(line).alias("wanted"))  # the lines of one text
    held, _ = may_hold(docs.select("doc_id", "text"), wanted)
    wanted = wanted.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    joined = held.withColumn("_text", F.xxhash64("text")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash")))
    lines = joined.select(F.split("text", LINE_END, -1).alias("lines"), F.explode("wanted").alias("w"))
    words = lines.select("w.*", normalised(F.get("lines", F.col("w.line_no"))).alias("words"))
    # Rows may repeat.
    h1, h2 = identity(F.col("words"))
    same = words.filter((h1 == F.col("h1")) & (h2 == F.col("h2"))).dropDuplicates(["spot"])
    return same.select("spot", "place", "words")


def neighbourhood(lines: DataFrame) -> DataFrame:
    """(spot, key, removed): the line itself (removed = -1) and the line without each of its words.

    The hash of a line combines, bit by bit, a hash of each word with its position. Without word i the words after it move down by
    one, so a variant's hash is what has run up of the words before i, and of the moved words after it.
    """
    split = lines.select("spot", F.split("words", " ").alias("_words"))
    words = split.select("spot", F.size("_words").cast("bigint").alias("n"), F.posexplode("_words").alias("i", "word"))
    own = F.xxhash64("word", F.col("i").cast("int"))
    moved = F.xxhash64("word", (F.col("i") - 1).cast("int"))
    up_to = Window.partitionBy("spot").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("spot")
    sums = words.select("spot", "n", "i", own.alias("own"), moved.alias("moved")).select(
        "spot", "n", "i", F.bit_xor("own").over(up_to).bitwiseXOR(F.col("own")).alias("before"),
        F.bit_xor("own").over(whole).alias("all"),
        F.bit_xor("moved").over(whole).bitwiseXOR(F.bit_xor("moved").over(up_to)).alias("after"))
    variants = F.array(
        F.struct(F.xxhash64(F.col("n") - 1, F.col("before").bitwiseXOR(F.col("after"))).alias("key"), F.col("i").alias("removed")),
        F.when(F.col("i") == 0, F.struct(F.xxhash64("n", "all").alias("key"), F.lit(-1).alias("removed"))))
    return sums.select("spot", F.explode(F.array_compact(variants)).alias("v")).select("spot", "v.key", "v.removed")


def earliest_near(lines: DataFrame, label: str) -> DataFrame:
    """(spot, near): for each line (spot, place, words) with an earlier one within one edit, the place of the earliest such."""
    variants = committed(neighbourhood(lines), label)
    by_variant = variants.groupBy("key", "removed").agg(F.min("spot").alias("first"))
    by_key = by_variant.groupBy("key").agg(
        F.min("first").alias("any"), F.min(F.when(F.col("removed") == -1, F.col("first"))).alias("whole"))
    # A whole line is one edit from every variant it equals; a variant from the whole line, and from variants without the same word.
    met = variants.join(by_key.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (
        (F.col("any") < F.col("spot"))), "inner").drop("_key")
    same = by_variant.withColumnRenamed("first", "same")
    met = met.join(same, ["key", "removed"])
    near = F.when(F.col("removed") == -1, F.col("any")).otherwise(
        F.least(F.col("same"), F.coalesce(F.col("whole"), F.col("same"))))
    found = met.select("spot", near.alias("near")).filter("near < spot")
    pairs = found.groupBy("spot").agg(F.min("near").alias("near"))
    named = lines.select("spot", F.split("words", " ").alias("a"))
    other = lines.select(F.col("spot").alias("near"), F.col("place").alias("near_place"), F.split("words", " ").alias("b"))
    return pairs.join(named, "spot").join(other, "near").filter(within_one_edit(F.col("a"), F.col("b"))).select(
        "spot", F.col("near_place").alias("near"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists differ by at most one word replaced, added or left out."""
    def common(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(at > 0, at - 1).otherwise(F.least(F.size(x), F.size(y)))
    shared = common(a, b) + common(F.reverse(a), F.reverse(b))
    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (shared >= longer - 1)


def repeated_lines(docs: DataFrame, min_words: int = 1, near_words: int = 8) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no): each line that an earlier one repeats, with the earliest such.

    Lines are numbered from 0. `docs` needs doc_id and text. Lines of fewer than `min_words` words, so always those without a
    word and null texts, are never dropped; lines of fewer than `near_words` words only if all words are equal. For a line that
    is equal to an earlier one its near copies count from the first place of its words. Rows with the same doc_id stand at
    the same place, so a repeated row drops no line of its twin; rows without a doc_id come last, at one place.
    """
    return repeats(docs, min_words, near_words).drop("text_hash")


def repeats(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """`repeated_lines`, with a hash of the text that holds the line."""
    lines = committed(lines_of(docs, min_words, near_words), "lines")
    lines = lines.withColumn("place", place(F.col("doc_id"), F.col("line_no")))
    first = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("place").alias("first"),
                                          F.min_by("text_hash", "place").alias("text_hash"))
    first = committed(first.withColumn("spot", spot(F.col("first"), F.col("h1"))), "first-lines")
    near = first.join(near_candidates(lines), "h1", "left_semi").withColumnRenamed("first", "place")
    line_no = F.pmod(F.col("place"), F.lit(PER_DOCUMENT).cast("decimal(32,0)"))
    doc = (F.col("place") - line_no) / F.lit(PER_DOCUMENT).cast("decimal(32,0)")
    near = near.select("place", "spot", "h1", "h2", "text_hash", line_no.cast("int").alias("line_no"), id_of(doc).alias("doc_id"))
    words = committed(candidate_words(docs, near), "near-lines")
    edits = earliest_near(words, "line-variants")
    kept = first.join(edits, "spot", "left").filter("n > 1 OR near IS NOT NULL").select(
        "h1", "h2", F.coalesce("near", "first").alias("kept"))
    dropped = lines.join(kept, ["h1", "h2"]).filter("kept < place")
    kept_no = F.pmod(F.col("kept"), F.lit(PER_DOCUMENT).cast("decimal(32,0)"))
    kept_doc = (F.col("kept") - kept_no) / F.lit(PER_DOCUMENT).cast("decimal(32,0)")
    return dropped.select("doc_id", "text_hash", "line_no", id_of(kept_doc).alias("kept_doc_id"), kept_no.cast("int").alias("kept_line_no"))


def id_of(doc: Column) -> Column:
    """The doc_id of a place; null for the last."""
    return F.when(doc < F.lit(str(LAST)).cast("decimal(20,0)"), doc.cast("bigint"))


def without_repeated_lines(docs: DataFrame, min_words: int = 1, near_words: int = 8) -> DataFrame:
    """The rows of `docs`, in their columns, without the lines that repeat; rows of which nothing is left go.

    Lines of any length count, so that of a copy no short or unspaced line stays. A row keeps its text as it is if no line of it
    repeats. n_chars, if there, is set for rows that changed. Rows are told apart by doc_id and text: a line goes from the row
    that holds it, not from others with the same id, or also without one.
    """
    dropped = committed(repeats(docs, min_words, near_words), "repeated-lines")
    by_row = dropped.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set("line_no").alias("_drop"))
    changed, same = may_hold(carried(docs), dropped.select("doc_id"))
    lines = F.split("text", LINE_END, -1)
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("_drop"), i)), LINE_END)
    joined = changed.withColumn("_text", F.xxhash64("text")).join(
        by_row, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash")), "left")
    joined = joined.withColumn("_left", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(left))
    joined = joined.filter(F.col("_drop").isNull() | (normalised(F.col("_left")) != ""))
    out = [F.col("_left").alias(c) if c == "text" else
           F.when(F.col("_drop").isNull(), F.col("_row.n_chars")).otherwise(
               F.length("_left").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else
           F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*out).unionByName(restored(same, docs.columns))


ORACLE = r"""
WITH occ AS (
  SELECT doc_id, pos - 1 AS line_no, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents)),
lines AS (SELECT *, string_split(words, ' ') AS w FROM occ WHERE words <> ''),
first AS (SELECT words, any_value(w) AS w, min((doc_id, line_no)) AS place FROM lines GROUP BY words),
long AS (SELECT * FROM first WHERE len(w) >= 8),
variants AS (
  SELECT words, place, i, array_to_string(list_concat(w[1:i-1], w[i+1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM long)),
links AS (
  SELECT a.words, b.place FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND b.place < a.place
  UNION ALL SELECT a.words, b.place FROM variants a JOIN long b ON a.v = b.words AND b.place < a.place
  UNION ALL SELECT a.words, b.place FROM long a JOIN variants b ON a.words = b.v AND b.place < a.place),
near AS (SELECT words, min(place) AS place FROM links GROUP BY words),
kept AS (SELECT f.words, coalesce(n.place, f.place) AS place FROM first f LEFT JOIN near n ON n.words = f.words)
SELECT l.doc_id, l.line_no::INTEGER AS line_no, k.place[1]::BIGINT AS kept_doc_id, k.place[2]::INTEGER AS kept_line_no
FROM lines l JOIN kept k ON k.words = l.words WHERE k.place < (l.doc_id, l.line_no)
"""
