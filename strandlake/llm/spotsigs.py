"""SpotSigs fingerprints with DataFrame functions alone.

Common words are anchors, and so are the bars of a table and a word that is said again at once. The
chain of the next two content words after an anchor, other anchors skipped, is a signature; the set of
a text's signatures is its fingerprint. Of several anchors in a row the last one counts. Sets are compared by Jaccard, pruned by their lengths: two sets whose
lengths alone keep the likeness under the least one of interest are not intersected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The commonest words of English, German, French and Spanish that serve as anchors.
ANCHORS = """
the of and to in a is that it was for on are with as be this by not or
der die das und ist von mit den ein eine zu sich auf im nicht
le la les de des un une et est que qui dans pour pas en du au sur
el los las y del al con por para no se lo es su
""".split()

#: Rows of one bucket of neighbouring ids, and the most buckets there are.
BUCKET_ROWS, MOST_BUCKETS = 4000, 65_536


#: Stands before every anchor of a text in the form of ``marked``.
MARK = "\u0001"
#: A letter that stands for the bar of a table.
BAR = "\u01c0"


def marked(text: Column) -> Column:
    """Lower-case words between single spaces, with a space at both ends and a mark before anchors.

    The list of common words is tried once for each word, by first letters; whatever follows only
    looks for the mark.
    """
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.translate(text, "|", BAR)), r"[^\p{L}]+", " "), F.lit(" "))
    by_letter: dict[str, list[str]] = {}
    for word in sorted({*ANCHORS, BAR}):
        by_letter.setdefault(word[0], []).append(word[1:])
    common = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    words = F.regexp_replace(spaced, f" ({common})(?= )", f" {MARK}$1")
    # of a word said again and again only the last is content
    return F.regexp_replace(words, rf" ([^ {MARK}][^ ]*+)(?= \1 )", f" {MARK}$1")


def signature_set(words: Column) -> Column:
    """Sorted distinct 32-bit signatures of a text in the form of ``marked``.

    A text without a whole chain has every word for an anchor: its signatures are the pairs of
    neighbouring words, or its single word; texts without a letter have the empty set.
    """
    # of anchors in a row only the last stays, so that nothing below has to step over a run of them
    spots = F.regexp_replace(words, rf"{MARK}[^ ]++ (?={MARK})", "")
    chain = rf"(?= ({MARK}[^ ]++ [^ {MARK}][^ ]*+ (?:{MARK}[^ ]++ )?+[^ {MARK}][^ ]*+) )"

    def codes(found: Column) -> Column:
        return F.sort_array(F.array_distinct(F.transform(found, lambda x: F.hash(x))))

    # the anchor of a chain stays, the one between its content words goes
    own = codes(F.transform(F.regexp_extract_all(spots, F.lit(chain), F.lit(1)), lambda x: F.regexp_replace(x, rf" {MARK}[^ ]++(?= )", "")))
    every = F.regexp_extract_all(words, F.lit("(?= ([^ ]++ [^ ]++) )"), F.lit(1))
    word = F.trim(words)
    fallback = F.when(F.size(every) > 0, codes(every)).when(word != "", F.array(F.hash(word))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(own) > 0, own).otherwise(fallback)


def with_signatures(docs: DataFrame, text: Column, out: str) -> DataFrame:
    """``docs`` with the signature set of ``text`` as ``out``."""
    return docs.withColumn("_words", marked(text)).withColumn(out, signature_set(F.col("_words"))).drop("_words")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without intersecting where the lengths keep it under ``least``; 1 for two empty sets."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), 1.0).when((F.least(n, m) == 0) | (F.least(n, m) < F.greatest(n, m) * least), 0.0).otherwise(both / (n + m - both))


def fingerprint(signatures: Column) -> Column:
    return F.array_join(signatures.cast("array<string>"), ",")


def bucket_of(key: Column, edges: list[int]) -> Column:
    """How many of the sorted edges lie below a key, by binary search; -1 for null."""
    if not edges:
        return F.when(key.isNull(), -1).otherwise(0)
    table = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    # get() is null beyond the last edge
    search = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) < key, low + step).otherwise(low))
    return F.when(key.isNull(), -1).otherwise(search)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and how alike they are.

    The edited text has its last third replaced by the beginning of the next document in descending
    order of ids; after the last comes the first. Null text is empty.

    Rows meet their neighbours in buckets of ids between quantiles, so that a bucket has about
    ``BUCKET_ROWS`` rows however the ids lie, and each bucket also gets the first row of the one below.
    Only the bucket table, of bounded size, is sorted as a whole. Rows with one id follow each other by
    text and share a bucket, as do those with a null id, which come last. A single row is its own next one.
    """
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = min(MOST_BUCKETS, max(1, -(-rows.count() // BUCKET_ROWS)))
    found = rows.agg(F.percentile_approx(id_col, [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else None
    rows = rows.withColumn("_bucket", bucket_of(F.col(id_col), sorted(set(found or []))))
    heads = rows.groupBy("_bucket").agg(F.max(id_col).alias("_head"))
    every = Window.orderBy("_bucket")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the first row of a bucket also closes the bucket above it; that of the highest bucket closes the lowest
    goes = heads.select("_bucket", "_head", F.coalesce(F.lead("_bucket").over(every), F.min("_bucket").over(whole)).alias("_goes"))
    first = rows.join(F.broadcast(goes), "_bucket").where(F.col(id_col).eqNullSafe(F.col("_head")))
    closing = first.groupBy("_goes", id_col).agg(F.min("text").alias("text")).select(id_col, "text", F.col("_goes").alias("_bucket"), F.lit(1).alias("_closing"))
    both = with_signatures(rows.withColumn("_closing", F.lit(0)).unionByName(closing), F.col("text"), "signatures")
    after = Window.partitionBy("_bucket").orderBy("_closing", F.desc(id_col), "text")
    placed = both.withColumns({"next_text": F.lead("text").over(after), "next_signatures": F.lead("signatures").over(after)}).where("_closing = 0")
    size = F.length("text").cast("long")
    third = F.floor(size / 3).cast("int")
    edited = placed.withColumns({"n_chars": size, "edited": F.concat(F.substring(F.col("text"), F.lit(1), (size - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))})
    return with_signatures(edited, F.col("edited"), "edited_signatures").select(
        id_col,
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
