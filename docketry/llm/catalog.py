"""The numbered queries: each applies one operator to its whole table."""

from docketry.llm import bpe, decontaminate, infill, licenses, lines, media, ngram_join, quality, secrets, shards, substrings, toxicity, whitening
from docketry.llm.common import table


def op1_grammar_secrets(spark, sf_dir):
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op2_fuzzy_lines(spark, sf_dir):
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark, sf_dir):
    return shards.hilbert_shards(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark, sf_dir):
    return substrings.kept_digests(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return licenses.license_paragraphs(table(spark, sf_dir, "documents"))


def op7_signature_sniffing(spark, sf_dir):
    return media.payload_features(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op9_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).drop("mark")


def op10_forced_boundary_bpe(spark, sf_dir):
    import public_tokenizers  # needed here alone

    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark, sf_dir):
    return infill.output_digests(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents")).drop("longest_repeat", "n_repeats")


OPERATORS = [
    op1_grammar_secrets,
    op2_fuzzy_lines,
    op3_hilbert_shards,
    op4_toxicity,
    op5_substring_dedup,
    op6_license_scan,
    op7_signature_sniffing,
    op8_decontamination,
    op9_ngram_join,
    op10_forced_boundary_bpe,
    op11_embedding_whitening,
    op12_fill_in_middle,
    op13_quality_rules,
]
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLES = {
    "op5_substring_dedup": substrings.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op12_fill_in_middle": infill.ORACLE,
    "op13_quality_rules": quality.ORACLE,
}
