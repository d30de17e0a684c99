"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from leadloom.llm import batches, canonmap, copies, leak, linkage, location, mix, split, survivor, topn

QUERIES = {
    "p1_found": canonmap.p1_found,
    "p1_unmatched": canonmap.p1_unmatched,
    "p2_found": copies.p2_found,
    "p2_counts": copies.p2_counts,
    "p3_found": linkage.p3_found,
    "p3_matches": linkage.p3_matches,
    "p4_found": location.p4_found,
    "p4_locations": location.p4_locations,
    "p5_found": topn.p5_found,
    "p5_report": topn.p5_report,
    "p6_found": batches.p6_found,
    "p6_status": batches.p6_status,
    "p7_found": survivor.p7_found,
    "p7_survivors": survivor.p7_survivors,
    "p8_found": leak.p8_found,
    "p8_items": leak.p8_items,
    "p9_selection": mix.p9_selection,
    "p9_shares": mix.p9_shares,
    "p10_found": split.p10_found,
    "p10_pieces": split.p10_pieces,
}
SQL = {
    "p2_found": copies.P2_SQL,
    "p2_counts": copies.P2_COUNTS_SQL,
    "p5_found": topn.P5_SQL,
    "p7_found": survivor.P7_SQL,
}
