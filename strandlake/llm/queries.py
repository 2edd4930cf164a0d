"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, langid, neardup, negatives, packing, secrets, spotsigs, toxicity, treap, urltree, vectors, warc
from strandlake.session import Scratch, shared_folder, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


def remainder(divisor: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the rows whose remainder by 5 is not 0; every whole text is judged."""
    model = langid.train(documents(spark, sf_dir, "lang").where(remainder(5) != 0))
    found = langid.identify(documents(spark, sf_dir), model)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "saving", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows whose remainder by 3 is not 1; every whole text is scored."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    return toxicity.score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text, and their likeness."""
    return spotsigs.edited_pairs(documents(spark, sf_dir))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of at least 0.9 over every vector."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of at least 0.85, over every whole text."""
    return neardup.near_duplicates(documents(spark, sf_dir), neardup.JoinSettings(width=3, percent=85))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heap-and-linked-list merging over every whole text."""
    found = bpe.count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the archives and back; size and digest of a revisit are those its headers state."""
    folder = warc.archive_folder(shared_folder(spark))
    warc.write(warc.with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    captures = warc.assemble(warc.read(spark, folder)).select(
        F.coalesce("request.page_id", "metadata.page_id").alias("page_id"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to_page").alias("refers_to"),
        F.when(F.col("response.record_type") == "response", F.col("response.payload_bytes")).otherwise(F.col("response.http_length")).alias("payload_bytes"),
        F.when(F.col("response.record_type") == "response", F.col("response.payload_digest")).otherwise(F.substring_index("response.digest_header", ":", -1)).alias("payload_digest"),
    )
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and Markov models over every whole text."""
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.train(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct-word encoding and decoding of every whole text."""
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


#: The rules of op11, as dealt.
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and path templates over every url; what the rules say is what the templates learn from."""
    found = urltree.judge(table(spark, sf_dir, "pages").select("page_id", "url"), [urltree.Rule.parse(x) for x in URL_RULES])
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "blocked_share")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are ids divisible by 100; ids divisible by 7 move to the next label first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(moved, F.col("vec_id") % 100 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item, over every whole text."""
    scratch = Scratch()
    return treap.search(table(spark, sf_dir, "benchmark"), treap.index(documents(spark, sf_dir), scratch), scratch)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_toxicity, op3_spotsigs, op4_bpe_roundtrip, op5_minhash_near_dedup, op6_embedding_near_dedup, op7_token_counts, op8_warc_captures, op9_secret_scan, op10_packing, op11_url_filter, op12_hard_negatives, op13_ranked_search)
}
ORACLE_SQL: dict[str, str] = {
    "op12_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
            from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
            from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
        ), positives as (
            select anchor_id, other_id as positive_id, score as positive_score from scored
            where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
        )
        select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as rank,
               other_id as negative_id, positive_score, score as negative_score
        from positives join scored using (anchor_id)
        where not same and 80 * positive_score <= 100 * score and score <= positive_score
        qualify rank <= 5
    """,
    "op13_ranked_search": r"""
        with words as (
            select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
        ), asked as (
            select item_id, term, count(*) as times from (
                select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
            ) group by all
        ), postings as (
            select doc_id, term, count(*) as tf from words group by all
        ), lengths as (
            select doc_id, sum(tf)::bigint as n from postings group by all
        ), whole as (
            select count(*) as nn, sum(n)::bigint as ll from lengths
        ), weights as (
            select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as w
            from (select term, count(*) as df from postings group by all), whole
        ), norms as (
            select doc_id, 75 + (25 * n * nn) // ll as m from lengths, whole
        ), scored as (
            select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
            from asked join postings using (term) join weights using (term) join norms using (doc_id) group by all
        )
        select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
        from scored where score > 0 qualify rank <= 20
    """,
    "op8_warc_captures": """
        with p as (
            select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
        ), s as (
            select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as stored from p
        )
        select page_id, payload_bytes, payload_digest, case when stored = page_id then 'response' else 'revisit' end as record_type,
               case when stored = page_id then null else stored end as refers_to
        from s
    """,
}
