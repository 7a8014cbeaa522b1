"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audio import op5_telephony_audio
from .decontaminate import op9_qgram_decontamination
from .lattice import op6_subword_lattice
from .line_dedup import OP13_SQL, op13_line_dedup
from .merkle import OP11_SQL, op11_merkle_manifest
from .packing import op8_best_two_fit
from .quality import op4_passage_quality
from .simhash import op10_simhash_pivots
from .token_files import op2_token_files
from .tool_calls import OP1_SQL, op1_tool_calls
from .toxicity import op3_subword_toxicity
from .warc import OP7_SQL, op7_warc
from .whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_tool_calls, op2_token_files, op3_subword_toxicity, op4_passage_quality, op5_telephony_audio, op6_subword_lattice, op7_warc, op8_best_two_fit, op9_qgram_decontamination, op10_simhash_pivots,
        op11_merkle_manifest, op12_embedding_whitening, op13_line_dedup,
    )
}
SQL: dict[str, str] = {"op1_tool_calls": OP1_SQL, "op7_warc": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op13_line_dedup": OP13_SQL}
