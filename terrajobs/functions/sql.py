"""DuckDB SQL of the column functions, for the oracles of the queries."""

from __future__ import annotations

from terrajobs.functions import names


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean_name(x: str) -> str:
    spaced = rf"regexp_replace(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+', ' ', 'g')"
    swap = lambda e: f"CASE {e} WHEN 'paternò' THEN 'paterno paterno' WHEN 'paterno paterno' THEN 'paternò' ELSE {e} END"
    plain = rf"regexp_replace(strip_accents({swap(spaced)}), '[^\x00-\x7F]', '', 'g')"
    return f"(CASE WHEN {x} = '' THEN NULL ELSE {swap(plain)} END)"


def strip_area_prefix(x: str, level: str) -> str:
    for prefix in names.PROVINCE_PREFIXES if level == "provincia" else names.COMUNE_PREFIXES if level == "comune" else ():
        x = f"replace({x}, {quote(prefix)}, '')"
    return x


def english_to_italian(x: str) -> str:
    cases = " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in names.FOREIGN_NAMES.items())
    return f"(CASE {x} {cases} ELSE {x} END)"


def loose_key(x: str) -> str:
    for old, new in names.LOOSE_SUBSTITUTIONS:
        x = f"replace({x}, {quote(old)}, {quote(new)})"
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"
