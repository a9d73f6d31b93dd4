"""Documents to token ids in five stages, each over all that the one before it kept.

toxicity: documents that the grammar rejects go. near_dedup: one document of each SimHash component
stays. decontaminate: documents that overlap a benchmark item go. mix: sources are cut or repeated
to their targets. tokens: the mixed documents as token codes, one row each.
"""

from quillmesh.llm import decontaminate, mixing, simhash, token_codes, toxicity
from quillmesh.llm.common import settle, table


def _toxicity(spark, docs, sf_dir):
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, grammar)


def _near_dedup(spark, docs, sf_dir):
    return simhash.drop_near_copies(docs)


def _decontaminate(spark, docs, sf_dir):
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def _tokens(spark, docs, sf_dir):
    return token_codes.code_report(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("near_dedup", _near_dedup),
    ("decontaminate", _decontaminate),
    ("mix", _mix),
    ("tokens", _tokens),
]

#: The first stage is a learned model and the last a tokenizer; SQL has neither.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each result cut from its lineage before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
