"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .chat_format import OP7_SQL, op7_chat_format
from .html_text import op6_html_text
from .language_model import op10_language_model
from .line_dedup import OP4_SQL, op4_line_dedup
from .mixing import OP1_SQL, op1_source_mixing
from .packing import op2_packing
from .quality import OP5_SQL, op5_quality_rules
from .record_files import op12_record_files
from .shingle_join import OP3_SQL, op3_shingle_join
from .spelling import OP11_SQL, op11_spelling_variants
from .vector_codes import OP13_SQL, op13_vector_codes
from .vector_join import OP9_SQL, op9_vector_join
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op11_spelling_variants": op11_spelling_variants,
    "op12_record_files": op12_record_files,
    "op13_vector_codes": op13_vector_codes,
    "op10_language_model": op10_language_model,
    "op6_html_text": op6_html_text,
    "op8_warc": op8_warc,
    "op9_vector_join": op9_vector_join,
    "op1_source_mixing": op1_source_mixing,
    "op2_packing": op2_packing,
    "op3_shingle_join": op3_shingle_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op7_chat_format": op7_chat_format,
}

ORACLES = {
    "op11_spelling_variants": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
    "op8_warc": OP8_SQL,
    "op9_vector_join": OP9_SQL,
    "op1_source_mixing": OP1_SQL,
    "op3_shingle_join": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_chat_format": OP7_SQL,
}
