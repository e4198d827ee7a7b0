"""The operators of this subpackage as registered queries."""

from . import ann, bpe, chat, decontaminate, neardup, secrets, suffix, tokenfile, toxicity, warc
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_arc_to_warc": warc.op1_arc_to_warc,
    "op2_suffix_dedup": suffix.op2_suffix_dedup,
    "op3_chat_prefix_tree": chat.op3_chat_prefix_tree,
    "op4_minhash_near_dedup": neardup.op4_minhash_near_dedup,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_hnsw_search": ann.op6_hnsw_search,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op9_token_files": tokenfile.op9_token_files,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
