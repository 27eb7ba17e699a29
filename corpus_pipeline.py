"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing, tokenisation.

Each stage works on all that its predecessor kept. Stages read their input twice and more, so `run`
writes each result to the shared folder. All stages but the last return the columns of documents.

Null and empty texts stay, are equal to each other and have no tokens. Rows that repeat id and text are
one after exact dedup. An empty table gives no rows; without labels nothing is toxic and all domains are
equally likely. Other columns are carried through to the last stage, whatever their names.
"""

import public_tokenizers

from tallyline.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from tallyline.llm.common import table
from tallyline.session import written

#: Target shares of the tokens; about half as much junk comes in. Rates are 1 at least, so the mix is
#: reached by repeating documents of the domain that is short, and none that earlier stages kept is lost.
MIX = {"clean": 0.90, "junk": 0.10}


def clean(spark, docs, sf_dir):
    """Documents that the toxicity model, learned from the labels, does not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark, docs, sf_dir):
    """One document of each class of near copies."""
    return near_dedup.keep_first(docs)


def mix(spark, docs, sf_dir):
    """Every document as often as the mix of domains asks for, once at least."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), MIX, least=1.0)


def tokens(spark, docs, sf_dir):
    """Digests of every document's token ids and of the bytes they decode to."""
    return bpe.round_trip(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", clean), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mix), ("byte-level BPE", tokens),
]
#: SQL can't express learned scores, consistent sampling or byte pair merges.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
