"""The queries of the corpus operators and the pipeline, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from cartulary.llm import ranked_search, source_mix
from cartulary.llm.language_id import op4_language_id
from cartulary.llm.line_dedup import op7_line_dedup
from cartulary.llm.packing import op1_packing
from cartulary.llm.passage_quality import op9_passage_quality
from cartulary.llm.pseudonyms import op2_pseudonyms
from cartulary.llm.quality_rules import op10_quality_rules
from cartulary.llm.ranked_search import op13_ranked_search
from cartulary.llm.secret_scans import op8_secret_scans
from cartulary.llm.sentence_pieces import op3_sentence_pieces
from cartulary.llm.shingle_join import op6_shingle_join
from cartulary.llm.source_mix import op11_source_mix
from cartulary.llm.spelling_variants import op12_spelling_variants
from cartulary.llm.syncmers import op5_syncmers


def queries() -> dict[str, Callable]:
    import corpus_pipeline

    return {
        "op1_packing": op1_packing,
        "op2_pseudonyms": op2_pseudonyms,
        "op3_sentence_pieces": op3_sentence_pieces,
        "op4_language_id": op4_language_id,
        "op5_syncmers": op5_syncmers,
        "op6_shingle_join": op6_shingle_join,
        "op7_line_dedup": op7_line_dedup,
        "op8_secret_scans": op8_secret_scans,
        "op9_passage_quality": op9_passage_quality,
        "op10_quality_rules": op10_quality_rules,
        "op11_source_mix": op11_source_mix,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_ranked_search": op13_ranked_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_source_mix": source_mix.SQL, "op13_ranked_search": ranked_search.SQL}
