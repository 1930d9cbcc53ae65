"""The queries of this subpackage and their SQL, for registration."""

from __future__ import annotations

from .language import op6_language
from .packing import op3_packing
from .pieces import op9_sentencepiece
from .quality import OP2_SQL, op2_quality
from .repair import OP11_SQL, op11_repair
from .secrets import op7_secrets
from .shards import OP13_SQL, op13_sharding
from .simhash import op10_simhash
from .simple8b import op1_simple8b
from .toxicity import op8_toxicity
from .warc import OP5_SQL, op5_warc
from .whitening import op12_whitening
from .winnow import op4_winnowing

QUERIES = {
    "op1_simple8b": op1_simple8b,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_winnowing": op4_winnowing,
    "op5_warc": op5_warc,
    "op6_language": op6_language,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
    "op11_repair": op11_repair,
    "op12_whitening": op12_whitening,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {"op2_quality": OP2_SQL, "op5_warc": OP5_SQL, "op11_repair": OP11_SQL, "op13_sharding": OP13_SQL}
