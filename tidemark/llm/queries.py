"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.clusters import OP13_SQL, op13_clusters
from tidemark.llm.conversations import OP12_SQL, op12_conversation_trie
from tidemark.llm.decontaminate import OP8_SQL, op8_decontamination
from tidemark.llm.embeddings import OP4_SQL, op4_embedding_duplicates
from tidemark.llm.encoding import op11_encoding
from tidemark.llm.jaccard import OP1_SQL, op1_jaccard_join
from tidemark.llm.licenses import op3_license_scan
from tidemark.llm.mixing import op5_mixing
from tidemark.llm.packing import op9_packed_rows
from tidemark.llm.quality import op7_quality_classifier
from tidemark.llm.suffix_arrays import op6_suffix_array_dedup
from tidemark.llm.suffix_trees import OP10_SQL, op10_substring_dedup
from tidemark.llm.token_counts import op2_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_duplicates": op4_embedding_duplicates,
    "op5_mixing": op5_mixing,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_packed_rows": op9_packed_rows,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_encoding": op11_encoding,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_clusters": op13_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": OP1_SQL,
    "op4_embedding_duplicates": OP4_SQL,
    "op8_decontamination": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_clusters": OP13_SQL,
}
