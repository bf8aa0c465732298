"""Named queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from .exact_dedup import OP7_SQL, op7_exact_dedup
from .line_dedup import OP10_SQL, op10_line_dedup
from .licenses import op4_license_scan
from .mixing import OP8_SQL, op8_mix_sources
from .near_dedup import op6_minhash_near_dedup
from .packing import op3_best_fit_packing
from .privacy import op9_personal_data
from .quality_rules import op2_quality_rules
from .quotes import op1_quotation_links
from .repeats import op5_suffix_array_dedup

QUERIES = {
    "op1_quotation_links": op1_quotation_links,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_personal_data": op9_personal_data,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES = {
    "op7_exact_dedup": OP7_SQL,
    "op8_mix_sources": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
}
