"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from larkspur.llm import alignment, decontaminate, infill, lines, minhash, neighbours, quality, secrets, sentencepiece_codec, substrings, toxicity, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1,
    "op2_toxicity": toxicity.op2,
    "op3_neighbours": neighbours.op3,
    "op4_near_duplicates": minhash.op4,
    "op5_substrings": substrings.op5,
    "op6_quality": quality.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_lines": lines.op8,
    "op9_secrets": secrets.op9,
    "op10_paragraphs": lines.op10,
    "op11_fill_in_middle": infill.op11,
    "op12_alignment": alignment.op12,
    "op13_warc": warc.op13,
}
SQL = {"op7_decontaminate": decontaminate.OP7_SQL, "op11_fill_in_middle": infill.OP11_SQL, "op13_warc": warc.OP13_SQL}
