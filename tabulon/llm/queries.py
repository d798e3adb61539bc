"""The queries of this subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audio import op2_audio_fingerprints
from .embedding_join import ORACLE as OP3_SQL
from .embedding_join import op3_embedding_near_dedup
from .html_text import op1_html_text
from .language_model import op4_kneser_ney_quality
from .mixing import op9_source_mixing
from .ngram_join import ORACLE as OP7_SQL
from .ngram_join import op7_ngram_jaccard
from .packing import op6_best_fit_packing
from .substring_dedup import ORACLE as OP5_SQL
from .substring_dedup import op5_suffix_array_dedup
from .token_files import op8_token_files
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text, op2_audio_fingerprints, op3_embedding_near_dedup, op4_kneser_ney_quality, op5_suffix_array_dedup, op6_best_fit_packing, op7_ngram_jaccard,
        op8_token_files, op9_source_mixing, op10_toxicity,
    )
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op3_embedding_near_dedup": OP3_SQL, "op5_suffix_array_dedup": OP5_SQL, "op7_ngram_jaccard": OP7_SQL}
