"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fim, language, lines, packing, quality, resampling, simhash, substring, suffixes, token_files, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_output": token_files.op4_token_output,
    "op5_substring": substring.op5_substring,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality": quality.op8_quality,
    "op9_packing": packing.op9_packing,
    "op10_suffix_array": suffixes.op10_suffix_array,
    "op11_resampling": resampling.op11_resampling,
    "op12_language": language.op12_language,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
ORACLE_SQL = {
    "op5_substring": substring.SQL,
    "op6_url_filter": url_filter.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op8_quality": quality.SQL,
    "op10_suffix_array": suffixes.SQL,
    "op11_resampling": resampling.SQL,
    "op13_fill_in_middle": fim.SQL,
}
