"""The queries of this subpackage by name, with SQL where SQL can express the result."""

from __future__ import annotations

from tidemark.llm import backoff, boilerplate, covertree, exponion, fillmiddle, hyperminhash, lexicon, licences, packing, piecebpe, privacy, quality, quotes

QUERIES = {
    "op1_cover_tree": covertree.op1_cover_tree,
    "op2_quality": quality.op2_quality,
    "op3_site_lines": boilerplate.op3_site_lines,
    "op4_licence_sentences": licences.op4_licence_sentences,
    "op5_backoff": backoff.op5_backoff,
    "op6_quotation_links": quotes.op6_quotation_links,
    "op7_disclosure": privacy.op7_disclosure,
    "op8_sentencepiece": piecebpe.op8_sentencepiece,
    "op9_hyperminhash": hyperminhash.op9_hyperminhash,
    "op10_sum_of_squares_packing": packing.op10_sum_of_squares_packing,
    "op11_fill_in_middle": fillmiddle.op11_fill_in_middle,
    "op12_transducer_lexicon": lexicon.op12_transducer_lexicon,
    "op13_exponion": exponion.op13_exponion,
}
ORACLES = {
    "op4_licence_sentences": licences.ORACLE,
    "op6_quotation_links": quotes.ORACLE,
    "op3_site_lines": boilerplate.ORACLE,
    "op1_cover_tree": covertree.ORACLE,
    "op9_hyperminhash": hyperminhash.ORACLE,
    "op11_fill_in_middle": fillmiddle.ORACLE,
    "op13_exponion": exponion.ORACLE,
}
