"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html, lines, minhash, mixing, pieces, quality, sql, toxicity, urls, vectors
from .common import table

#: Host and path rules of the URL filter.
URL_RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
PROBE = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted and read back; digests of turns and of the text under the loss mask."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    back = chat.read_back(chat.format_chats(rows.unionByName(probe)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document's whole text; a fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the rules, then by the language models."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the divergence verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality.quality_rules(docs, keep_text=False).drop("lang")
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """Token ids of every document's whole text, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_decode(docs, pieces.read_model(spark, model_path), keep_text=False)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9."""
    return vectors.similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.9)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block and slot in the mix; targets are the square roots of the sources' sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_main_text(pages)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are similar by 0.8 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, n=4)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the passages that an earlier document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_chat_format": op2_chat_format,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_minhash": op8_minhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_text": op10_html_text,
}
ORACLE = sql.oracle(URL_RULES)
