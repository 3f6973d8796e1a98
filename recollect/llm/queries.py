"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from .ann import op9_nearest_neighbours
from .bpe import op10_bpe_round_trip
from .bucketed import op11_cobucketed_pair
from .chat_format import ORACLE as CHAT_ORACLE
from .chat_format import op4_chat_format
from .common import table
from .fingerprints import op3_fingerprints
from .hnsw import op12_embedding_dedup
from .license_scan import op1_license_scan
from .license_scan import oracle as license_oracle
from .mixing import op7_mixing
from .ngram_join import ORACLE as JOIN_ORACLE
from .ngram_join import op5_ngram_jaccard_join
from .quality import op6_quality_classifier
from .ranked_search import ORACLE as SEARCH_ORACLE
from .ranked_search import op13_ranked_search
from .token_counts import op2_token_counts
from .toxicity import op8_toxicity


def queries() -> dict:
    return {
        "op1_license_scan": lambda s, d: op1_license_scan(table(s, d, "documents")),
        "op2_token_counts": lambda s, d: op2_token_counts(table(s, d, "documents")),
        "op3_fingerprints": lambda s, d: op3_fingerprints(table(s, d, "documents")),
        "op4_chat_format": lambda s, d: op4_chat_format(table(s, d, "conversations")),
        "op5_ngram_jaccard_join": lambda s, d: op5_ngram_jaccard_join(table(s, d, "documents")),
        "op6_quality_classifier": lambda s, d: op6_quality_classifier(table(s, d, "documents"), table(s, d, "labels")),
        "op7_mixing": lambda s, d: op7_mixing(table(s, d, "documents")),
        "op8_toxicity": lambda s, d: op8_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op9_nearest_neighbours": lambda s, d: op9_nearest_neighbours(table(s, d, "embeddings")),
        "op10_bpe_round_trip": lambda s, d: op10_bpe_round_trip(table(s, d, "documents")),
        "op11_cobucketed_pair": lambda s, d: op11_cobucketed_pair(table(s, d, "sales"), table(s, d, "sale_lines")),
        "op12_embedding_dedup": lambda s, d: op12_embedding_dedup(table(s, d, "embeddings")),
        "op13_ranked_search": lambda s, d: op13_ranked_search(table(s, d, "documents"), table(s, d, "benchmark")),
    }


def oracle_sql() -> dict:
    return {"op1_license_scan": license_oracle(), "op4_chat_format": CHAT_ORACLE, "op5_ngram_jaccard_join": JOIN_ORACLE, "op13_ranked_search": SEARCH_ORACLE}
