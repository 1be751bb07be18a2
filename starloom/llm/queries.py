"""The queries of this subpackage, by name."""

from __future__ import annotations

from starloom.llm import embeddings, warc
from starloom.llm.embeddings import op5_embeddings
from starloom.llm.packing import op7_packing
from starloom.llm.pieces import op10_sentencepiece
from starloom.llm.pii import op1_pii
from starloom.llm.quality_classifier import op8_quality_classifier
from starloom.llm.quality_rules import op9_quality_rules
from starloom.llm.sharding import op3_sharding
from starloom.llm.simhash import op4_simhash
from starloom.llm.toxicity import op2_toxicity
from starloom.llm.warc import op6_warc

QUERIES = {f.__name__: f for f in (op1_pii, op2_toxicity, op3_sharding, op4_simhash, op5_embeddings, op6_warc, op7_packing, op8_quality_classifier, op9_quality_rules, op10_sentencepiece)}
#: The others' hashes, models or token ids are beyond SQL; tests hold them against brute force, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {"op5_embeddings": embeddings.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL}
