"""The queries of the training-data operators, with production parameters, and their SQL."""

from . import ann, decontaminate, langid, lm, mixing, simhash, suffix_dedup, token_codes, toxicity, warc
from .common import table


def op1_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))[0]


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op4_warc_revisit(spark, sf_dir):
    resolved = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    return resolved.select("record_id", "url", "response_id", "outcome", warc.header_text("headers").alias("headers"))


def op5_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op6_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_token_codes(spark, sf_dir):
    return token_codes.code_report(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op9_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prepared = lm.prepare(docs)
    return lm.score_documents(docs, lm.train(docs, prepared=prepared), prepared=prepared)


def op10_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ann,
        op2_toxicity,
        op3_simhash,
        op4_warc_revisit,
        op5_langid,
        op6_mix,
        op7_token_codes,
        op8_suffix_dedup,
        op9_lm_score,
        op10_decontaminate,
    )
}
ORACLES = {"op4_warc_revisit": warc.ORACLE, "op6_mix": mixing.ORACLE, "op10_decontaminate": decontaminate.ORACLE}
