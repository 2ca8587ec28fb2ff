"""The queries of this subpackage, by name."""

from orogen.llm.cosine import op7_embedding_near_dedup
from orogen.llm.html import op10_html_extraction
from orogen.llm.langid import op8_language_id
from orogen.llm.mixing import op4_mix_sources
from orogen.llm.oracles import ORACLES
from orogen.llm.pieces import op1_token_counts, op2_sentencepiece
from orogen.llm.quality import op9_quality_classifier
from orogen.llm.secrets import op5_secret_scan
from orogen.llm.simhash import op3_simhash_near_dedup
from orogen.llm.topk import op6_exact_topk

QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_sentencepiece, op3_simhash_near_dedup, op4_mix_sources, op5_secret_scan, op6_exact_topk, op7_embedding_near_dedup, op8_language_id, op9_quality_classifier, op10_html_extraction)
}

__all__ = ["ORACLES", "QUERIES"]
