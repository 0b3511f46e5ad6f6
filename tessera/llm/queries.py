"""Queries of the training-data operators, each over its whole table, and the SQL of those that SQL expresses."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.chat import OP4_SQL, op4_chat
from tessera.llm.decontaminate import OP5_SQL, op5_decontaminate
from tessera.llm.licences import op10_licenses
from tessera.llm.media import op1_media
from tessera.llm.neardup import OP9_SQL, op9_neardup
from tessera.llm.negatives import OP11_SQL, op11_negatives
from tessera.llm.pieces import op6_sentencepiece
from tessera.llm.quality import op8_quality
from tessera.llm.repair import OP12_SQL, op12_repair
from tessera.llm.repeats import OP3_SQL, op3_substrings
from tessera.llm.secrets import op2_secrets
from tessera.llm.toxicity import op7_toxicity
from tessera.llm.warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_media": op1_media,
    "op2_secrets": op2_secrets,
    "op3_substrings": op3_substrings,
    "op4_chat": op4_chat,
    "op5_decontaminate": op5_decontaminate,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_neardup": op9_neardup,
    "op10_licenses": op10_licenses,
    "op11_negatives": op11_negatives,
    "op12_repair": op12_repair,
    "op13_warc": op13_warc,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op3_substrings": OP3_SQL, "op4_chat": OP4_SQL, "op5_decontaminate": OP5_SQL, "op9_neardup": OP9_SQL, "op11_negatives": OP11_SQL, "op12_repair": OP12_SQL, "op13_warc": OP13_SQL}
