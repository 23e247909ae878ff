"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from optika.llm.conversation_repair import op11_conversation_repair
from optika.llm.embedding_join import op5_embedding_near_dedup
from optika.llm.fingerprint import op4_document_fingerprints
from optika.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from optika.llm.html_extraction import op1_html_extraction
from optika.llm.language_id import op8_language_id
from optika.llm.lm_scoring import op10_lm_scoring
from optika.llm.mixing import OP2_SQL, op2_mixing
from optika.llm.near_dedup import op9_minhash_near_dedup
from optika.llm.packing import op7_packing
from optika.llm.substring_dedup import op3_substring_dedup
from optika.llm.url_filter import OP6_SQL, op6_url_filter
from optika.llm.warc import OP13_SQL, op13_warc


def pipeline(spark, sf_dir: str):
    """The stages of corpus_pipeline.py over all documents: one row per piece of a packed sequence."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc": op13_warc,
    "pipeline": pipeline,
}

ORACLES = {"op2_mixing": OP2_SQL, "op6_url_filter": OP6_SQL, "op12_hard_negatives": OP12_SQL, "op13_warc": OP13_SQL}
