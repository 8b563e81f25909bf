"""Queries of this subpackage and the SQL each is checked against."""

from __future__ import annotations

from steploom.llm import answers, credentials, languages, leakage, packing, pii, runs

QUERIES = {
    "p1_found": runs.p1_found,
    "p1_events": runs.p1_events,
    "p2_found": answers.p2_found,
    "p2_rates": answers.p2_rates,
    "p4_found": pii.p4_found,
    "p4_redacted": pii.p4_redacted,
    "p5_found": credentials.p5_found,
    "p5_redacted": credentials.p5_redacted,
    "p6_containers": packing.p6_containers,
    "p6_fill": packing.p6_fill,
    "p6_certificates": packing.p6_certificates,
    "p6_check": packing.p6_check,
    "p7_found": leakage.p7_found,
    "p7_items": leakage.p7_items,
    "p8_found": languages.p8_found,
    "p8_languages": languages.p8_languages,
    "p8_segments": languages.p8_segments,
}
ORACLES = {
    "p1_found": runs.P1_FOUND_SQL,
    "p1_events": runs.P1_EVENTS_SQL,
    "p6_check": packing.P6_CHECK_SQL,
}
