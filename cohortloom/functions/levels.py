"""The levels of a code hierarchy, as (code column, description column, label column)."""

from __future__ import annotations

from typing import NamedTuple


class Level(NamedTuple):
    code: str
    desc: str
    label: str


LEVELS = {
    "icd": Level("icd_code", "icd_desc", "icd"),
    "icd_c": Level("icd_chp_code", "icd_chp_desc", "icd_c"),
    "ccs_s": Level("ccs_code", "ccs_desc", "ccs_s"),
    "ccs1": Level("ccs1_code", "ccs1_desc", "ccs1"),
    "ccs2": Level("ccs2_code", "ccs2_desc", "ccs2"),
    "ccs3": Level("ccs3_code", "ccs3_desc", "ccs3"),
    "snomed": Level("snomed_code", "snomed_desc", "snomed"),
}


def level(name: str) -> Level:
    if name not in LEVELS:
        raise ValueError(f"unknown level {name!r}; choose one of {sorted(LEVELS)}")
    return LEVELS[name]
