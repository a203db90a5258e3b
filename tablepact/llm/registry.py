"""The queries of the operators and the SQL some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tablepact.llm import conversation_repair, hard_negatives, topk_search, url_filter
from tablepact.llm.chosen_path import op9_chosen_path
from tablepact.llm.conversation_repair import op12_conversation_repair
from tablepact.llm.grammar import op1_grammar
from tablepact.llm.hard_negatives import op11_hard_negatives
from tablepact.llm.packing import op8_packing
from tablepact.llm.pii import op3_pii
from tablepact.llm.quality_classifier import op5_quality_classifier
from tablepact.llm.quality_rules import op10_quality_rules
from tablepact.llm.segmentation import op4_segmentation
from tablepact.llm.sharding import op7_sharding
from tablepact.llm.topk_search import op13_topk_search
from tablepact.llm.url_filter import op2_url_filter
from tablepact.llm.weighted_sampling import op6_weighted_sampling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_grammar": op1_grammar,
    "op2_url_filter": op2_url_filter,
    "op3_pii": op3_pii,
    "op4_segmentation": op4_segmentation,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_weighted_sampling": op6_weighted_sampling,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_chosen_path": op9_chosen_path,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_topk_search": op13_topk_search,
    "pipeline": corpus_pipeline.run,
}

#: The other operators' results rest on hashes, tokenizers or models SQL has no words for.
SQL: dict[str, str] = {
    "op2_url_filter": url_filter.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
    "op13_topk_search": topk_search.SQL,
}
