"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from mentionlake.llm.bpe import op2_bpe_round_trip
from mentionlake.llm.decontamination import OP3_SQL, op3_decontamination
from mentionlake.llm.factorisation import op4_quality_classifier
from mentionlake.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from mentionlake.llm.html_layout import op9_html_extraction
from mentionlake.llm.jaccard_join import OP10_SQL, op10_jaccard_join
from mentionlake.llm.merkle import OP13_SQL, op13_merkle
from mentionlake.llm.mixing import OP11_SQL, op11_mixing
from mentionlake.llm.pii import op6_pii
from mentionlake.llm.quality_rules import op1_quality_rules
from mentionlake.llm.suffix_dedup import OP8_SQL, op8_suffix_dedup
from mentionlake.llm.token_counts import op5_token_counts
from mentionlake.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_counts": op5_token_counts,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_mixing": op11_mixing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op7_warc": OP7_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op11_mixing": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
