"""The queries of this subpackage, by name."""

from __future__ import annotations

from roundwise.llm import quality
from roundwise.llm.bpe import op6_byte_bpe
from roundwise.llm.langid import op9_language_id
from roundwise.llm.media import op7_media_columns
from roundwise.llm.mixing import op2_mixing
from roundwise.llm.pages import op10_html_extraction
from roundwise.llm.pii import op4_pii
from roundwise.llm.quality import op1_quality_rules
from roundwise.llm.secrets import op3_secret_scans
from roundwise.llm.simhash import op8_simhash_near_dedup
from roundwise.llm.toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_secret_scans, op4_pii, op5_toxicity, op6_byte_bpe, op7_media_columns, op8_simhash_near_dedup, op9_language_id, op10_html_extraction)}

ORACLES: dict[str, str] = {"op1_quality_rules": quality.ORACLE}
