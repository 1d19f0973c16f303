"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, jaccard, langid, license, media, mixing, pii, secrets, suffix, urls

QUERIES = {
    "op1_media": media.op1_media,
    "op2_personal_data": pii.op2_personal_data,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_suffix_dedup": suffix.op4_suffix_dedup,
    "op5_licenses": license.op5_licenses,
    "op6_mixing": mixing.op6_mixing,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_secrets": secrets.op8_secrets,
    "op9_url_filter": urls.op9_url_filter,
    "op10_language": langid.op10_language,
}
SQL = {"op9_url_filter": urls.SQL}
