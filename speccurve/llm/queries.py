"""The queries of the operators, thin and over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speccurve.llm import (
    decontaminate, hard_negatives, html_text, language, line_index, near_dup, paragraphs, periodic,
    pieces, quality, sharding, token_counts, token_files,
)
from speccurve.llm.common import maybe_broadcast, shared_folder, stored

SHARDS = 40
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; ``TOKENIZERS`` where the package is not there."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 equal shards, and with one shard more."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def byte_pair_pattern() -> str:
    """How the public byte-pair vocabularies split a text."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in Arrow files, and what the files hold."""
    files = token_files.write_token_files(
        table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1
    )
    return token_files.read_documents(files)


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule votes weighed by EM over all documents; kept from a posterior of one half."""
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"),
        "quality",
    )


def op6_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of the texts made from them."""
    coded = pieces.encode_pieces(
        table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    )
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside windows of the benchmark."""
    found = decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
win AS (SELECT item_id, n, list_slice(w, s + 1, s + n) AS x
        FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM k)),
spots AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s
          FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n),
hits AS (SELECT doc_id, s, spots.n, item_id FROM spots
         JOIN win ON win.n = spots.n AND win.x = list_slice(spots.w, s + 1, s + spots.n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS name FROM hits)
          GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents with two-word sets of 80 % or more in common."""
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def op8_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines and the windows of words that an earlier one has."""
    cut = paragraphs.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_paragraphs", "n_shared",
        (F.size("removed") + F.size("spans")).cast("long").alias("n_removed"),
        "removed", "first_docs", "spans", "span_docs", "text",
    )


def op1_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_delta_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents: all are inserted, exact
    copies of an earlier one deleted, and counts revised where repeated lines
    are taken out.  Every batch is sent twice and counts once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")

    def counted(df: DataFrame) -> DataFrame:
        ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), byte_pair_pattern()
        return token_counts.count_tokens(df, "byte_bpe_50k", ranks, pattern)

    old = stored(counted(docs), "counts")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    marked = docs.select(
        "doc_id", digest.alias("digest"),
        F.array_join(F.array_distinct(F.split("text", "\n")), "\n").alias("revised"), "text",
        "source", "lang",
    )
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("first"))
    state = marked.select("doc_id", "digest", (F.col("revised") != F.col("text")).alias("changed"))
    state = stored(
        state.join(first, "digest").select(
            "doc_id", F.when(F.col("doc_id") > F.col("first"), "copy")
            .when(F.col("changed"), "revised").alias("state")
        ).where("state IS NOT NULL"),
        "states",
    )
    copies = old.join(state.where("state = 'copy'"), "doc_id", "left_semi")
    changed = state.where("state = 'revised'").select("doc_id")
    revised = marked.join(changed, "doc_id", "left_semi").select(
        "doc_id", "source", "lang", F.col("revised").alias("text")
    )
    totals = token_counts.TokenTotals(spark, shared_folder(spark, "totals"))
    batches = {
        "load": token_counts.signed(old, 1),
        "copies": token_counts.signed(copies, -1),
        "lines": token_counts.signed(old.join(changed, "doc_id", "left_semi"), -1).unionByName(
            token_counts.signed(counted(revised), 1)
        ),
    }
    for _ in range(2):
        for name, changes in batches.items():
            totals.commit(name, changes)
        totals.compact()
    return totals.totals()


def op9_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; their source stands for the host."""
    return language.identify(
        table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source")
    )


def op11_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that three or more of them hold.

    They come in two batches; toxic ones are then withdrawn and taken back, so
    that the index counts all of them again.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels")
    toxic = stored(labels.where("toxic = 1").select("doc_id").distinct(), "toxic")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    index = line_index.LineIndex(spark, shared_folder(spark, "lines"))
    index.commit("english", added=docs.where(english))
    index.commit("others", added=docs.where(~english))
    index.commit("withdrawn", removed=toxic)
    asked = maybe_broadcast(toxic, toxic.count(), 16)
    index.commit("back", added=docs.join(asked, "doc_id", "left_semi"))
    return index.without_repeats(docs, least_docs=3).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


_STRIPPED = "trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP11_SQL = f"""
WITH lines AS (SELECT doc_id, n, x, translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, n, parts[n] AS x FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))),
common AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k
           HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, n, x, coalesce(doc_id <> last, false) AS gone
           FROM lines LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op12_segment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector among all vectors."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    shifted = (F.col("label") + 1) % 10
    vectors = table(spark, sf_dir, "embeddings").where(finite).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, shifted).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"),
    )
    found = hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_inner_product(a.e, b.e) AS bigint) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
                               ORDER BY score DESC, other_id) AS integer) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: some documents end in a repetition that their key decides."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("w")

    def planted(words: Column) -> Column:
        a = (g % F.size(words)).cast("int")
        p = (1 + F.floor((F.size(words) - a) / (3 + g % 8))).cast("int")
        tail = F.transform(
            F.sequence(a, F.size(words) - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int"))
        )
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    asked = docs.select(
        "doc_id", "text", F.when(h % 10 == 0, words).otherwise(F.array().cast("array<string>"))
        .alias("w"),
    )
    # Words are bound to a lambda's name, so they are not split again for each word.
    made = F.get(F.transform(F.array("w"), planted), F.lit(0))
    return asked.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def op13_basic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, and what is left without them."""
    docs = _with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(docs)

    best = F.array_max(F.expr(
        "transform(runs, r -> struct(r.length div r.period AS whole,"
        " (r.length % r.period) / r.period AS rest, -r.start AS first, -r.period AS least,"
        " r.length AS length))"
    ))
    listed = F.array_join(F.transform(
        "runs", lambda r: F.concat_ws(",", r.start, r.length, F.concat(r.period, F.lit("\n")))
    ), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.first")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.least")).alias("period"),
        F.expr("1000 * best.length div -best.least").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256)
        .alias("collapsed_sha256"),
    )


QUERIES = {
    "op11_cuckoo_lines": op11_cuckoo_lines,
    "op12_segment_summaries": op12_segment_summaries,
    "op13_basic_factors": op13_basic_factors,
    "op3_delta_rollups": op3_delta_rollups,
    "op9_language_evidence": op9_language_evidence,
    "op1_host_suffix_array": op1_host_suffix_array,
    "op8_paragraph_banding": op8_paragraph_banding,
    "op5_chosen_path": op5_chosen_path,
    "op2_prefix_decontamination": op2_prefix_decontamination,
    "op6_prefix_table_pieces": op6_prefix_table_pieces,
    "op7_weak_supervision": op7_weak_supervision,
    "op10_token_files": op10_token_files,
    "op4_rendezvous_shards": op4_rendezvous_shards,
}

ORACLE: dict[str, str] = {
    "op2_prefix_decontamination": OP2_SQL,
    "op11_cuckoo_lines": OP11_SQL,
    "op12_segment_summaries": OP12_SQL,
}
