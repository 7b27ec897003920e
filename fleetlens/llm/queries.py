"""Queries over the corpus operators, and DuckDB statements where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.llm import (chat, decontaminate, hard_negatives, html_extract, kneser_ney, license_scan, line_dedup, ngram_join, packing,
                           pseudo_likelihood, quality_rules, suffix_dedup, turn_repair)
from fleetlens.llm.common import read
from fleetlens.llm.oracle import ORACLES  # noqa: F401


def op1_decontaminate(spark, sf_dir):
    found = decontaminate.find_contamination(
        read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


#: A conversation whose texts look like marks of chat templates.
MARKED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_format(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in MARKED)
    chats = chat.format_chats(turns.unionByName(
        spark.sql(f"SELECT * FROM VALUES {marked} AS t(conv_id, turn, role, text)")))
    back = chat.parse_chat(F.col("formatted"))
    learnt = chats.withColumn("learnt", chat.loss_text(F.col("segments"))).withColumn("back", back)
    return learnt.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
               .cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "is_valid")


def op3_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, short_lines=True).select("doc_id", "n_lines", "n_removed", "kept_text")


def op4_packing(spark, sf_dir, tokenizer=None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.link_documents(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op8_html_extract(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_text(pages, html_extract.fit_labeller(pages)).drop("html")


def op9_pseudo_likelihood(spark, sf_dir):
    return pseudo_likelihood.score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_classifier(spark, sf_dir):
    judged, _, _ = kneser_ney.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "n_words", "log_likelihood", "perplexity", "peak", "kept")


def op11_license_scan(spark, sf_dir):
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op12_turn_repair(spark, sf_dir):
    return turn_repair.repair_turns(turn_repair.damaged(read(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark, sf_dir):
    vec_id, label = F.col("vec_id"), F.col("label")
    return hard_negatives.mine(
        read(spark, sf_dir, "embeddings"), label=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label), anchor=vec_id % 100 == 0)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_format": op2_chat_format,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extract": op8_html_extract,
    "op9_pseudo_likelihood": op9_pseudo_likelihood,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_license_scan": op11_license_scan,
    "op12_turn_repair": op12_turn_repair,
    "op13_hard_negatives": op13_hard_negatives,
}
