"""The queries of the operators, and the SQL they agree with where SQL can express them."""

from __future__ import annotations

from tallyspark.llm.byte_bpe import op13
from tallyspark.llm.collocations import OP11_SQL, op11
from tallyspark.llm.decontaminate import op8
from tallyspark.llm.exact_dedup import OP2_SQL, op2
from tallyspark.llm.language_id import op1
from tallyspark.llm.language_model import op9
from tallyspark.llm.licenses import op10
from tallyspark.llm.merkle import OP12_SQL, op12
from tallyspark.llm.mixing import OP7_SQL, op7
from tallyspark.llm.pii import op3
from tallyspark.llm.quality import op6
from tallyspark.llm.simhash import op5
from tallyspark.llm.warc import OP4_SQL, op4

QUERIES = {
    "op1_language_id": op1,
    "op2_exact_dedup": op2,
    "op3_pii": op3,
    "op4_warc": op4,
    "op5_simhash_near_dedup": op5,
    "op6_quality": op6,
    "op7_mixing": op7,
    "op8_decontamination": op8,
    "op9_language_model": op9,
    "op10_licenses": op10,
    "op11_collocations": op11,
    "op12_merkle_manifest": op12,
    "op13_byte_bpe": op13,
}

ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op7_mixing": OP7_SQL,
    "op11_collocations": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
