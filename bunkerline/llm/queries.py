"""The registered queries: each applies its operator to whole tables and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bunkerline.llm import alignment, hashtree, imatch, line_crf, media, mixing, ngram_join, packing, reply_trees, suffix_dedup, toxicity, warc, whitening
from bunkerline.llm.common import read, store
from bunkerline.llm.labelled import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(read(spark, sf_dir, "documents"), word_vocabulary())
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(slim)


ORACLES["op6_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, 'null'))) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * n AS cap, 1.5::DOUBLE * sum(n) OVER () AS total,
    coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY 2.0::DOUBLE * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(w) OVER (ORDER BY 2.0::DOUBLE * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
  FROM s),
l AS (SELECT full_, open_ FROM r WHERE (total - full_) * w / open_ <= cap ORDER BY cap / w, source LIMIT 1),
q AS (
  SELECT source, n, CASE WHEN (total - l.full_) * w / l.open_ > cap THEN cap ELSE (total - l.full_) * w / l.open_ END::DOUBLE AS target
  FROM r, l),
c AS (
  SELECT source, 1 AS copy, least(n, floor(target)::BIGINT) AS quota FROM q
  UNION ALL SELECT source, 2, floor(target)::BIGINT - least(n, floor(target)::BIGINT) FROM q),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM d),
f AS (
  SELECT c.source, c.copy, c.quota, c.quota - coalesce(max(o.cum) FILTER (o.cum <= c.quota), 0) AS lack
  FROM c JOIN o ON o.source IS NOT DISTINCT FROM c.source GROUP BY c.source, c.copy, c.quota),
g AS (SELECT f.source, f.copy, f.lack, o.cum, o.size FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.cum > f.quota AND o.size > 0 AND f.quota > 0),
p1 AS (SELECT source, copy, max((size, -cum)) AS b, lack - max(size) AS lack FROM g WHERE size <= lack GROUP BY source, copy, lack),
p2 AS (
  SELECT g.source, g.copy, max((g.size, -g.cum)) AS b, p1.lack - max(g.size) AS lack
  FROM g JOIN p1 ON g.source IS NOT DISTINCT FROM p1.source AND g.copy = p1.copy AND g.cum <> -p1.b[2] AND g.size <= p1.lack GROUP BY g.source, g.copy, p1.lack),
p3 AS (
  SELECT g.source, g.copy, max((g.size, -g.cum)) AS b, p2.lack - max(g.size) AS lack
  FROM g JOIN p2 ON g.source IS NOT DISTINCT FROM p2.source AND g.copy = p2.copy AND g.size <= p2.lack
  JOIN p1 ON g.source IS NOT DISTINCT FROM p1.source AND g.copy = p1.copy
  WHERE g.cum NOT IN (-p1.b[2], -p2.b[2]) GROUP BY g.source, g.copy, p2.lack),
p4 AS (
  SELECT g.source, g.copy, max((g.size, -g.cum)) AS b
  FROM g JOIN p3 ON g.source IS NOT DISTINCT FROM p3.source AND g.copy = p3.copy AND g.size <= p3.lack
  JOIN p2 ON g.source IS NOT DISTINCT FROM p2.source AND g.copy = p2.copy JOIN p1 ON g.source IS NOT DISTINCT FROM p1.source AND g.copy = p1.copy
  WHERE g.cum NOT IN (-p1.b[2], -p2.b[2], -p3.b[2]) GROUP BY g.source, g.copy),
p AS (
  SELECT source, copy, -b[2] AS cum FROM p1 UNION ALL SELECT source, copy, -b[2] FROM p2
  UNION ALL SELECT source, copy, -b[2] FROM p3 UNION ALL SELECT source, copy, -b[2] FROM p4),
k AS (
  SELECT o.source, o.cum, f.copy FROM o JOIN f ON o.source IS NOT DISTINCT FROM f.source AND o.cum <= f.quota WHERE o.size > 0
  UNION ALL SELECT source, cum, copy FROM p),
t AS (SELECT source, cum, count(*) AS copies FROM k GROUP BY source, cum)
SELECT o.doc_id, o.size, q.n AS source_size, q.target, (coalesce(t.copies, 0) * o.size)::BIGINT AS taken
FROM o JOIN q ON q.source IS NOT DISTINCT FROM o.source
LEFT JOIN t ON t.source IS NOT DISTINCT FROM o.source AND t.cum = o.cum AND o.size > 0
"""


def mixture(sized: DataFrame) -> tuple[list[tuple[str | None, int]], dict[str | None, float]]:
    """Size and target of each source of a table that has `source` and `size`."""
    sizes = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    return sizes, mixing.targets(sizes)


#: A score from here on predicts label 1.
THRESHOLD = 0.7


def judged(scored: DataFrame, of: int, held: int) -> DataFrame:
    return scored.select("doc_id", (remainder(F.col("doc_id"), of) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return judged(toxicity.score(docs, lexicon), 3, 1)


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_texts(read(spark, sf_dir, "documents"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


@query
def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string"))
    read_again = reply_trees.read_back(reply_trees.format_paths(reply_trees.paths(reply_trees.chains(rows))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_again.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = store(read(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size")))
    sizes, targets = mixture(sized)
    mixed = mixing.mix(sized, F.col("size"), F.array("source"), targets)
    table = spark.createDataFrame([(s, n, float(targets[s])) for s, n in sizes], "source string, source_size long, target double")
    joined = mixed.join(F.broadcast(table), mixed["source"].eqNullSafe(table["source"]))
    return joined.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"))


@query
def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    files = media.store_media(docs.select("doc_id", n.alias("n_bytes"), "text")).select("doc_id", "n_bytes", "media")
    return media.read_media(files).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


@query
def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(read(spark, sf_dir, "documents"))


@query
def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    now = hashtree.assign(rows, hashtree.topology(24), "doc_id")
    return hashtree.number(hashtree.assign(now, hashtree.topology(25), "doc_id", "grown_shard"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> line_crf.Model | None:
    return line_crf.learn(docs, read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)


@query
def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judged(line_crf.score(docs, quality_model(spark, docs, sf_dir), lines=False), 4, 2)


ORACLES["op11_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p
"""


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(read(spark, sf_dir, "pages")))
    sound = F.when(F.col("fault").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.col("record_id"), F.lit(": "), F.col("fault"))))
    return found.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", sound.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.valid(read(spark, sf_dir, "embeddings"), "embedding").select("vec_id", F.transform("embedding", lambda v: F.floor(64 * v.cast("double")) + 1000000).alias("x"))
    out = whitening.whiten(rows, "x", components=32, keep=("vec_id",))
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))
