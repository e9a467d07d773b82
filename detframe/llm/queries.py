"""The registered queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from .chat_format import OP5_SQL, op5_chat_format
from .decontamination import OP9_SQL, op9_decontamination
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .jaccard_join import op7_jaccard_join
from .language_id import op2_language_id
from .mixing import OP10_SQL, op10_mixing
from .pii import op8_pii
from .token_files import op3_token_files
from .toxicity import op12_toxicity
from .url_filter import op6_url_filter
from .vector_codes import OP11_SQL, op11_vector_codes
from .warc_revisits import OP1_SQL, op1_warc_revisits

_ALL = (op1_warc_revisits, op2_language_id, op3_token_files, op4_exact_dedup, op5_chat_format, op6_url_filter, op7_jaccard_join, op8_pii, op9_decontamination, op10_mixing, op11_vector_codes, op12_toxicity, op13_hard_negatives)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_warc_revisits": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op5_chat_format": OP5_SQL, "op9_decontamination": OP9_SQL, "op10_mixing": OP10_SQL, "op11_vector_codes": OP11_SQL, "op13_hard_negatives": OP13_SQL}
