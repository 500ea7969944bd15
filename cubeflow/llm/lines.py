"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is its sequence of words; two lines are near if one edit (a word put in, taken out or
replaced) turns one into the other.  Each line emits itself and itself less each one word as hashed
keys; lines within one edit share a key:

* one word replaced: both, less that word, at the same place;
* one word more: the shorter itself is the longer less a word.

Every (key, position) class of the first kind is near in itself, and in the second kind a whole
line is near all that shrink to it; so a class needs only its earliest line, and no pairs are made
within it.  The earliest candidate's distance is then verified on the words.

Before that, lines that cannot have a neighbour are set aside, without loss: an edit lies in one
half of a line, so near lines agree exactly in a first or last half (cut where the shorter one's
middle is), and a line whose halves nobody shares has none.  A line whose shared half is known
emits only the variants that lack a word of the other half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeflow.llm.common import broadcast_if_small, cut, fresh

#: Shorter lines have no near ones: one edit in five words is a similarity of 0.8.
NEAR_WORDS = 5
#: Scripts without spaces: in a line of these that has none, characters are the words.
UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"

#: What makes a document, and with ``at``, the line number, a place; both are ordered by these in turn.
DOCUMENT = ["no_id", "id", "text_hash"]


def _spaced(text):
    """The text with single spaces between words; line feeds stay."""
    odd = F.contains(text, F.lit("  ")) | text.rlike("[\\x09\\x0B-\\x0D]")
    return F.when(odd, F.regexp_replace(text, "[\\x20\\x09\\x0B-\\x0D]+", " ")).otherwise(text)


def _by_words(line):
    """A trimmed line of ``_spaced`` text with a space after each word, also where the script has none."""
    bare = ~F.contains(line, F.lit(" ")) & line.rlike(UNSPACED)
    return F.when(bare, F.rtrim(F.regexp_replace(line, "(.)", "$1 "))).otherwise(line)


def _n_words(line):
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _document():
    """A document: by id (null after all others) and, for rows that share one, a hash of the text."""
    parts = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.coalesce("text", F.lit("")))
    return F.named_struct(*[x for k, part in zip(DOCUMENT, parts) for x in (F.lit(k), part)])  # names given by alias get lost beside explode


def _document_of(place: str):
    """The document in a place."""
    return F.struct(*[F.col(f"{place}.{k}").alias(k) for k in DOCUMENT])


def numbered_lines(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """(place, line, n) of every line of at least ``least_words`` words; ``n`` counts them, place is document and line number."""
    lines = F.posexplode(F.split(_spaced(F.coalesce("text", F.lit(""))), "\n")).alias("at", "line")
    lines = docs.select(_document().alias("doc"), lines).select("doc", "at", F.trim("line").alias("line")).where(F.length("line") >= least_words)
    place = F.struct(*[F.col(f"doc.{k}").alias(k) for k in DOCUMENT], "at")
    lines = lines.select(place.alias("place"), _by_words(F.col("line")).alias("line"))
    return lines.select("place", "line", _n_words(F.col("line")).alias("n")).where(F.col("n") >= least_words)


def _head(line, n):
    return F.substring_index(line, " ", n) if isinstance(n, int) else F.call_function("substring_index", line, F.lit(" "), n)


def first_lines(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """(h1, h2, place, front, front1, back, back1): each distinct line, a 128-bit hash, with its earliest place.

    The others are keys of the halves that an edit can leave alone, with the line as the shorter
    or (1) the longer of two; lines of fewer than NEAR_WORDS words have none (null).
    """
    line, n = F.col("line"), F.col("n")

    def half(tag, short, count):
        return F.when(n >= NEAR_WORDS, F.xxhash64(F.lit(tag), short, _head(line, count)))

    m, m1 = F.shiftright(n, 1), F.shiftright(n - 1, 1)
    keys = [half(3, n, m).alias("front"), half(3, n - 1, m1).alias("front1"), half(4, n, m - n).alias("back"), half(4, n - 1, m1 - n + 1).alias("back1")]
    hashed = numbered_lines(docs, least_words).select(F.xxhash64(F.lit(1), line).alias("h1"), F.xxhash64(F.lit(2), line).alias("h2"), "place", *keys)
    return hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), *[F.first(k).alias(k) for k in ("front", "front1", "back", "back1")])


def superseded(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(place) of the distinct lines that have a near line at an earlier place."""
    front = F.array(*[F.struct(F.lit(side).alias("side"), F.col(k).alias("half")) for side, k in ((1, "front"), (1, "front1"), (2, "back"), (2, "back1"))])
    keyed = firsts.where("front is not null").select("place", F.explode(front).alias("k")).select("place", "k.side", "k.half")
    shared = cut(keyed.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half"), "line-halves")
    may = keyed.join(broadcast_if_small(shared, 16), "half", "left_semi").groupBy("place").agg(F.bit_or("side").alias("sides"))
    may = cut(may, "line-candidates")

    # the candidates' words, read again from the texts of the documents that have any
    own = may.select(_document_of("place").alias("_own")).distinct()
    mine, theirs = fresh(docs, "_doc", "_own")
    own = broadcast_if_small(own, 40).withColumnRenamed("_own", theirs)
    some = docs.withColumn(mine, _document()).join(own, F.col(mine) == F.col(theirs), "left_semi").drop(mine)
    lines = cut(numbered_lines(some, NEAR_WORDS).join(broadcast_if_small(may, 64), "place").groupBy("place").agg(F.first("sides").alias("sides"), F.first("n").alias("n"), F.first("line").alias("line")), "line-words")
    line, n, at = F.col("line"), F.col("n"), F.col("at")
    # with the front half alike the edit lies behind it, with the back half alike before it
    low = F.when(F.col("sides") == 1, F.shiftright(n - 1, 1) + 1).otherwise(1)
    high = F.when(F.col("sides") == 2, F.greatest(F.shiftright(n, 1), F.shiftright(n - 1, 1) + 1)).otherwise(n)
    rest = F.concat_ws(" ", F.nullif(_head(line, at - 1), F.lit("")), F.nullif(_head(line, at - n), F.lit("")))
    spots = lines.select("place", "line", "n", F.explode(F.concat(F.array(F.lit(0)), F.sequence(low, high))).alias("at"))
    spots = spots.select("place", "at", F.when(at == 0, line).otherwise(rest).alias("rest"))
    variants = cut(spots.select("place", "at", F.xxhash64(F.lit(1), "rest").alias("v1"), F.xxhash64(F.lit(2), "rest").alias("v2")), "line-variants")

    low = F.min("place").alias("low")
    less, whole = variants.where("at > 0"), variants.where("at = 0").groupBy("v1", "v2").agg(low)
    replaced = less.groupBy("v1", "v2", "at").agg(low, F.count("*").alias("c")).where("c > 1").drop("c")
    shrunk = cut(less.join(whole.select("v1", "v2", F.col("low").alias("whole")), ["v1", "v2"]), "line-shrunk")
    candidates = less.join(replaced, ["v1", "v2", "at"]).select("place", "low")
    candidates = candidates.unionByName(shrunk.select("place", F.col("whole").alias("low")))
    candidates = candidates.unionByName(shrunk.groupBy("whole").agg(low).select(F.col("whole").alias("place"), "low"))
    candidates = candidates.where("low < place").distinct()
    words = lines.select("place", F.split("line", " ").alias("words"))
    mine = candidates.join(words, "place")
    return mine.join(words.select(F.col("place").alias("low"), F.col("words").alias("other")), "low").where(one_edit("words", "other")).select("place").distinct()


def one_edit(a: str, b: str):
    """Column: the word arrays ``a`` and ``b`` are at most one word edit apart."""
    n, m = F.size(a), F.size(b)

    def common(x, y):
        at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(at == 0, n).otherwise(at - 1)

    return (F.abs(n - m) <= 1) & (common(F.col(a), F.col(b)) + common(F.reverse(a), F.reverse(b)) >= F.greatest(n, m) - 1)


def kept_lines(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """(doc, kept): the numbers of the lines of at least ``least_words`` words that stay, of documents that keep any."""
    firsts = cut(first_lines(docs, least_words), "line-firsts")
    stay = firsts.join(superseded(docs, firsts), "place", "left_anti")
    return stay.select(_document_of("place").alias("doc"), F.col("place.at").alias("at")).groupBy("doc").agg(F.sort_array(F.collect_list("at")).alias("kept"))


def deduplicated(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """``docs`` without the lines that an earlier near or equal line makes superfluous.

    Lines are separated by line feeds and compared by their words, or by their characters if they
    have no spaces and are of a script without.  Lines of fewer than ``least_words`` words and blank
    ones stay.  Of others, one stays if no earlier line (by doc_id, then line number; null ids last)
    is equal or, from NEAR_WORDS words on, within one word edit, whether that one stays or not.  A document left without text
    goes; one that had none (null or empty) stays.  n_chars, if there, is counted anew.  The result
    has n_lines and n_dropped beside the columns of ``docs``, whose own of these names it replaces.
    Rows that share an id are documents in the order of a hash of their texts; rows that repeat
    id and text are one document and get the same result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    doc, kept_doc, kept_name, lines_name, stays_name = fresh(docs, "_doc", "_kept_doc", "_kept", "_lines", "_stays")
    kept = kept_lines(docs, least_words).withColumnRenamed("doc", kept_doc).withColumnRenamed("kept", kept_name)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    joined = docs.withColumn(doc, _document()).join(kept, F.col(doc) == F.col(kept_doc), "left").withColumn(lines_name, lines)
    plain = lambda x: F.trim(_spaced(x))
    long = lambda x: (F.length(x) >= least_words) & (F.length(plain(x)) >= least_words) & (_n_words(_by_words(plain(x))) >= least_words)
    stays = F.filter(lines_name, lambda x, i: F.coalesce(F.array_contains(kept_name, i), F.lit(False)) | ~long(x))
    out = joined.withColumn(stays_name, stays).withColumn("n_lines", F.size(lines_name).cast("long")).withColumn("n_dropped", (F.size(lines_name) - F.size(stays_name)).cast("long"))
    out = out.where((F.col("n_dropped") == 0) | (F.length(F.btrim(F.array_join(stays_name, ""))) > 0))
    out = out.withColumn("text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join(stays_name, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, "n_lines", "n_dropped")


def op9_lines(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, text_sha256 of the documents that keep text."""
    from cubeflow.llm.common import table

    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
