"""Queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from revlens.llm import bpe, chat, decontam, embed, jaccard, lines, lm, shard, sortmeans, toxicity, whiten
from revlens.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark, sf_dir):
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_packed_ids(spark, sf_dir):
    return bpe.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op3_maxent_lm(spark, sf_dir):
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op4_spaced_seeds(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_itq_near_dup(spark, sf_dir):
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_fuzzy_lines(spark, sf_dir):
    return lines.decisions(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return bpe.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_tree(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(spark, chat.formatted(rows.unionByName(own)))


def op11_whitening(spark, sf_dir):
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


def op12_sort_means(spark, sf_dir):
    return sortmeans.clustered(table(spark, sf_dir, "embeddings"))


def op13_minimax_shards(spark, sf_dir):
    return shard.sharded(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_packed_ids": op2_packed_ids,
        "op3_maxent_lm": op3_maxent_lm,
        "op4_spaced_seeds": op4_spaced_seeds,
        "op5_itq_near_dup": op5_itq_near_dup,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_fuzzy_lines": op7_fuzzy_lines,
        "op8_token_counts": op8_token_counts,
        "op9_toxicity": op9_toxicity,
        "op10_chat_tree": op10_chat_tree,
        "op11_whitening": op11_whitening,
        "op12_sort_means": op12_sort_means,
        "op13_minimax_shards": op13_minimax_shards,
    }


def oracle_sql():
    return {
        "op4_spaced_seeds": decontam.oracle(),
        "op12_sort_means": sortmeans.oracle(),
        "op13_minimax_shards": shard.oracle(),
    }
