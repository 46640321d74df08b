"""Queries of the training-data operators: name -> (function, SQL or None)."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .decontam import op9_decontamination
from .divergence import SQL as op11_sql
from .divergence import op11_source_divergence
from .embed_dedup import op8_embedding_dedup
from .exact_dedup import SQL as op13_sql
from .exact_dedup import op13_exact_dedup
from .hyperminhash import op2_hyperminhash
from .langid import op6_language
from .licenses import op10_licence_windows, op10_licences, oracle_sql
from .periodic import op12_periodic_runs
from .pii import op3_personal_data
from .rollup import op7_token_rollup
from .token_store import op1_token_ids
from .toxicity import op4_toxicity

Q = {
    "op1_token_ids": (op1_token_ids, None),
    "op2_hyperminhash": (op2_hyperminhash, None),
    "op3_personal_data": (op3_personal_data, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_byte_bpe": (op5_byte_bpe, None),
    "op6_language": (op6_language, None),
    "op7_token_rollup": (op7_token_rollup, None),
    "op8_embedding_dedup": (op8_embedding_dedup, None),
    "op9_decontamination": (op9_decontamination, None),
    "op10_licences": (op10_licences, oracle_sql()),
    "op10_licence_windows": (op10_licence_windows, None),
    "op11_source_divergence": (op11_source_divergence, op11_sql),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_exact_dedup": (op13_exact_dedup, op13_sql),
}
