"""Document fingerprints by I-Match over randomised lexicon subsets.

Method: a term's document frequency decides whether it is in the lexicon: terms within a band of inverse document frequency stay,
very common and very rare ones go. A document's distinct lexicon terms are sorted and split by a hash into `SUBSETS`
randomised parts of the lexicon; the hash of each part is one component of the fingerprint. The parts are the same for every document and take all its
lexicon terms, however many. Two fingerprints are as like as the share of their components that agree, of those that either has.

Everything is DataFrame functions. Frequencies are counted over all documents with map-side combining; every term in the band is in the
lexicon and no other. It reaches the scan as a hash table of whole term hashes (by a scalar subquery), of `WORDS` rows or more as the band needs.
A term in the band is in a share of the documents, so the table has at most 1 / BAND[0] times the mean number of distinct terms of a document, however many documents there are.

Defined cases: null and empty texts have no terms and equal, empty fingerprints; a text without lexicon terms is fingerprinted by all its
terms; equal texts have equal fingerprints whatever their ids; a null doc_id comes before all others; rows that share a doc_id have the same next
document, and a doc_id with several texts passes on the least of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bunkerline.llm.common import stash, store

#: Share of the documents a lexicon term occurs in: from, below.
BAND = (0.0001, 0.02)
SUBSETS = 64
#: A part is named by twice three bits of a term's hash.
_SPLIT = 8
#: Characters of a component; one that has no term is dots.
DIGITS, NONE = 4, "...."
#: Rows of the least table, and the terms it is for; a larger lexicon has a table of twice the rows, and so on.
WORDS, LEXICON = 1 << 12, 1 << 15
#: The upper bits of a term's hash that name its row in the least table.
_SHIFT = 64 - WORDS.bit_length() + 1


class Lexicon(NamedTuple):
    table: DataFrame
    shift: int


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def lexicon(texts: DataFrame, band: tuple[float, float] = BAND) -> Lexicon:
    """All terms in the band, from a table with `text`: one row with their hashes, dealt out by their upper bits."""
    n = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    kept = store(counts.where((F.col("n") >= max(2.0, band[0] * n)) & (F.col("n") < max(3.0, band[1] * n))).select("t"))
    doublings = max(0, -(-kept.count() // LEXICON) - 1).bit_length()
    shift = _SHIFT - doublings
    rows = kept.groupBy(F.shiftrightunsigned("t", shift).alias("id")).agg(F.collect_list("t").alias("ts"))
    dense = texts.sparkSession.range(WORDS << doublings).join(rows, "id", "left").select("id", F.coalesce("ts", F.array().cast("array<long>")).alias("ts"))
    return Lexicon(store(dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "ts"))), lambda x: x["ts"]).alias("ts"))), shift)


def fingerprint(df: DataFrame, text: str, out: str, words: Lexicon) -> DataFrame:
    """Add an array of components, one for each subset of the lexicon, empty where the text has none of its terms."""
    df = df.withColumn(f"{out}_all", terms(F.col(text))).withColumn(f"{out}_table", words.table.scalar())

    def chosen(t: Column) -> Column:
        return F.array_contains(F.element_at(f"{out}_table", (F.shiftrightunsigned(t, words.shift) + 1).cast("int")), t)

    df = df.withColumn(f"{out}_in", F.filter(f"{out}_all", chosen)).drop(f"{out}_table")
    own = F.when(F.size(f"{out}_in") > 0, F.col(f"{out}_in")).otherwise(F.col(f"{out}_all"))
    df = df.withColumn(f"{out}_own", F.array_sort(own))
    of = lambda t, shift: F.shiftright(t, shift).bitwiseAND(F.lit(_SPLIT - 1))
    # in two steps, so that a long text is not read once for every part
    df = df.withColumns({f"{out}_own{i}": F.filter(f"{out}_own", lambda t: of(t, 6) == i) for i in range(_SPLIT)})  # noqa: B023

    def component(r: int) -> Column:
        part = F.filter(f"{out}_own{r % _SPLIT}", lambda t: of(t, 9) == r // _SPLIT)
        digest = lambda x: F.substring(F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(x), 48))), DIGITS, "0"), 1, DIGITS)
        return F.transform(F.array(part), lambda x: F.when(F.size(x) > 0, digest(x)).otherwise(F.lit(NONE)))[0]

    working = ("all", "in", "own", *(f"own{i}" for i in range(_SPLIT)))
    return df.withColumn(out, F.array(*(component(r) for r in range(SUBSETS)))).drop(*(f"{out}_{c}" for c in working))


def components(fingerprints: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda i: F.substring(fingerprints, i * DIGITS + 1, F.lit(DIGITS)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1."""
    both = F.zip_with(components(a), components(b), lambda x, y: F.when((x == NONE) & (y == NONE), -1).when(x == y, 1).otherwise(0))
    counts = F.aggregate(both, F.struct(F.lit(0).alias("same"), F.lit(0).alias("either")), lambda s, x: F.struct((s["same"] + (x == 1).cast("int")).alias("same"), (s["either"] + (x >= 0).cast("int")).alias("either")))
    return F.transform(F.array(counts), lambda c: F.when(c["either"] > 0, c["same"] / c["either"]).otherwise(F.lit(1.0)))[0]


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) in ascending order of distinct ids, the first after the last.

    Ids are dealt out by range; within a range the next one is the following row, at its end the first one of the next range.
    """
    dealt = store(ids.select("doc_id").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    wrapped = dealt.withColumn("id", F.struct("doc_id"))
    heads = wrapped.groupBy("part").agg(F.min("id").alias("head"))
    every = Window.orderBy("part")  # one row a partition
    heads = heads.select("part", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    following = F.lead("id").over(Window.partitionBy("part").orderBy("doc_id"))
    return wrapped.withColumn("following", following).join(heads, "part").select("doc_id", F.coalesce("following", "head")["doc_id"].alias("next_id"))


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_id, edited) of documents (doc_id, text): the last half of the characters gives way to the start of the next document."""
    following = next_ids(docs)
    half = docs.groupBy("doc_id").agg(F.max(F.floor(F.char_length("text") / 2)).cast("int").alias("half"))
    links = following.join(half, following["doc_id"].eqNullSafe(half["doc_id"])).select(F.struct(following["doc_id"]).alias("to"), F.struct(F.col("next_id").alias("doc_id")).alias("next"), "half")
    # a struct equals another whose field is null too; an id is the next one of one id only, so the join's own partitions hold the groups
    keyed = docs.select(F.struct("doc_id").alias("key"), "text")
    parts = keyed.join(links, keyed["key"] == links["next"]).select("to", "next", F.expr("left(text, half)").alias("part"))
    parts = parts.groupBy("next").agg(F.min("to").alias("to"), F.min("part").alias("part"))
    joined = keyed.join(parts, keyed["key"] == parts["to"]).select("key.doc_id", "text", F.col("next.doc_id").alias("next_id"), "part")
    kept = F.expr("concat(left(text, cast(char_length(text) - floor(char_length(text) / 2) as int)), left(part, cast(floor(char_length(text) / 2) as int)))")
    return joined.select("doc_id", "text", "next_id", kept.alias("edited"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against its edited one and the next."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = lexicon(plain, band)
    both = fingerprint(fingerprint(edited(plain), "text", "own", words), "edited", "other", words)
    told = stash(both.select(
        "doc_id", "next_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("own", "").alias("fingerprint"), F.array_join("other", "").alias("edited_fingerprint"),
    ))
    least = told.groupBy(F.col("doc_id").alias("id")).agg(F.min("fingerprint").alias("following"))
    return told.join(least, told["next_id"].eqNullSafe(least["id"])).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )
