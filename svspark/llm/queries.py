"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from .decontaminate import op3_decontaminate
from .language import op9_language
from .line_dedup import op1_line_dedup
from .minhash import op2_minhash
from .ngram_join import op4_ngram_join
from .pii import op10_pii
from .sentencepiece_codec import op5_sentencepiece
from .sstable import op6_sstable
from .suffix_dedup import op7_suffix_dedup
from .url_filter import op8_url_filter


def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    own = (op1_line_dedup, op2_minhash, op3_decontaminate, op4_ngram_join, op5_sentencepiece, op6_sstable, op7_suffix_dedup, op8_url_filter, op9_language, op10_pii)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {}
