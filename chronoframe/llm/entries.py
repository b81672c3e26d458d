"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .ball_tree import OP11_SQL, op11_ball_tree
from .bpe import op13_bpe
from .ctw import op8_ctw
from .decontaminate import op5_decontaminate
from .html_extract import op3_html_text
from .kmeans import OP12_SQL, op12_kmeans
from .mixing import op7_mixing
from .ngram_join import OP4_SQL, op4_ngram_join
from .secrets import op2_secrets
from .spotsigs import OP6_SQL, op6_spotsigs
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .toxicity import op1_toxicity
from .warc import OP9_SQL, op9_warc

QUERIES = {"op5_decontaminate": op5_decontaminate, "op1_toxicity": op1_toxicity, "op4_ngram_join": op4_ngram_join, "op8_ctw": op8_ctw, "op6_spotsigs": op6_spotsigs, "op7_mixing": op7_mixing, "op2_secrets": op2_secrets, "op3_html_text": op3_html_text, "op9_warc": op9_warc, "op10_substring_dedup": op10_substring_dedup, "op11_ball_tree": op11_ball_tree, "op12_kmeans": op12_kmeans, "op13_bpe": op13_bpe}
ORACLES = {"op4_ngram_join": OP4_SQL, "op6_spotsigs": OP6_SQL, "op9_warc": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op11_ball_tree": OP11_SQL, "op12_kmeans": OP12_SQL}
