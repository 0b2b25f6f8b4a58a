"""Queries of the training-data operators, and SQL for those that SQL can express."""

from .bpe import op10_bpe
from .decontaminate import op9_decontaminate
from .imatch import op4_imatch
from .language import op5_language
from .ngramlm import op7_ngramlm
from .pii import op6_pii
from .quality import op8_quality
from .redirects import OP3_SQL, op3_redirects
from .simhash import op1_simhash
from .toxicity import op2_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_redirects": op3_redirects,
    "op4_imatch": op4_imatch,
    "op5_language": op5_language,
    "op6_pii": op6_pii,
    "op7_ngramlm": op7_ngramlm,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_bpe": op10_bpe,
}
ORACLES = {"op3_redirects": OP3_SQL}
