"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from .alignment import op12_alignment
from .chat import OP1_SQL, op1_chat
from .decontaminate import op3_decontaminate
from .lexical import OP11_SQL, op11_lexical
from .licenses import op2_licenses
from .mixing import op7_mixing
from .pieces import op13_pieces
from .pii import op4_pii
from .quality import op8_quality
from .simhash import op10_simhash
from .suffixes import op6_suffixes
from .syncmers import op9_syncmers
from .toxicity import op5_toxicity

QUERIES = {
    "op1_chat": op1_chat,
    "op2_licenses": op2_licenses,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_suffixes": op6_suffixes,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_syncmers": op9_syncmers,
    "op10_simhash": op10_simhash,
    "op11_lexical": op11_lexical,
    "op12_alignment": op12_alignment,
    "op13_pieces": op13_pieces,
}

ORACLE_SQL = {
    "op1_chat": OP1_SQL,
    "op11_lexical": OP11_SQL,
}
