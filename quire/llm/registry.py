"""The queries of this subpackage and the SQL of those that SQL can express."""

from quire.llm import decontaminate, langid, license_scan, mixing, quality_vote, repetition, sharding, simhash, substring_dedup, url_filter

QUERIES = {
    "op1_quality_vote": quality_vote.op1_quality_vote,
    "op2_repetition": repetition.op2_repetition,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_mixing": mixing.op4_mixing,
    "op5_langid": langid.op5_langid,
    "op6_sharding": sharding.op6_sharding,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_simhash": simhash.op10_simhash,
}


def __getattr__(name: str):
    """ORACLES is made when it is asked for, since op3's SQL holds the trained model."""
    if name != "ORACLES":
        raise AttributeError(name)
    return _ORACLES | {"op3_license_scan": license_scan.oracle()}


_ORACLES = {
    "op2_repetition": repetition.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
}
