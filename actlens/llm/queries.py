"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from actlens.llm import (alignment, chat, decontaminate, extract, fill_in_middle, fingerprint, language, lattice, near_dedup,
                         neighbours, substring_dedup, token_files, warc)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_language": language.op2_language,
    "op3_main_text": extract.op3_main_text,
    "op4_fingerprint": fingerprint.op4_fingerprint,
    "op5_warc": warc.op5_warc,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_chat": chat.op7_chat,
    "op8_token_files": token_files.op8_token_files,
    "op9_sampled_pieces": lattice.op9_sampled_pieces,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op7_chat": chat.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op12_neighbours": neighbours.ORACLE,
}
