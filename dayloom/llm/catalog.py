"""Registered queries of the corpus operators and the SQL that some of them equal."""

from dayloom.llm import html, licenses, lines, minhash, mixing, periods, pieces, quality, repeats, search, sharding, simhash, warc

QUERIES = {
    "op1_html": html.op1_html,
    "op2_licenses": licenses.op2_licenses,
    "op10_lines": lines.op10_lines,
    "op11_periods": periods.op11_periods,
    "op12_warc": warc.op12_warc,
    "op13_search": search.op13_search,
    "op3_fingerprints": minhash.op3_fingerprints,
    "op4_quality": quality.op4_quality,
    "op5_simhash": simhash.op5_simhash,
    "op6_pieces": pieces.op6_pieces,
    "op7_repeats": repeats.op7_repeats,
    "op8_sharding": sharding.op8_sharding,
    "op9_mixing": mixing.op9_mixing,
}

ORACLES = {
    "op2_licenses": licenses.OP2_SQL,
    "op10_lines": lines.OP10_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_search": search.OP13_SQL,
    "op4_quality": quality.OP4_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
