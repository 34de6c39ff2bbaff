"""Queries of this subpackage and, where SQL can express them, their oracles."""

from netsift.llm.ann import OP4_SQL, op4_ann
from netsift.llm.codec import op6_bpe_codec
from netsift.llm.exact_topk import OP3_SQL, op3_exact_topk
from netsift.llm.main_text import op2_main_text
from netsift.llm.mixing import OP8_SQL, op8_mixing
from netsift.llm.ngram_join import OP10_SQL, op10_ngram_join
from netsift.llm.pii import op1_pii
from netsift.llm.quality import op5_quality
from netsift.llm.token_counts import op7_token_counts
from netsift.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_main_text": op2_main_text,
    "op3_exact_topk": op3_exact_topk,
    "op4_ann": op4_ann,
    "op5_quality": op5_quality,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
}

SQL = {
    "op3_exact_topk": OP3_SQL,
    "op4_ann": OP4_SQL,
    "op8_mixing": OP8_SQL,
    "op10_ngram_join": OP10_SQL,
}
