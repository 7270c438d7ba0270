"""Field lists: names or 0-based places, unique names, pairs of key fields."""

from __future__ import annotations

import re


class UnknownField(ValueError):
    pass


def resolve(header: list[str], spec: str | int, ignore_case: bool = False) -> str:
    """The name of a field given by name or, if no name fits, by place."""
    text = str(spec)
    if text in header:
        return text
    if ignore_case and (hits := [h for h in header if h.strip().lower() == text.strip().lower()]):
        return hits[-1]
    if text.isdigit() and int(text) < len(header):
        return header[int(text)]
    raise UnknownField(f"no field {spec!r} in {header}")


def parse_list(text: str) -> list[str]:
    """Fields parted by ; , or tab, without repeats, in order."""
    return list(dict.fromkeys(x.strip() for x in re.split(r"[;,\t]", text) if x.strip()))


def parse_ints(text: str) -> list[int] | None:
    """Whole numbers parted by commas; None if one is not."""
    try:
        return [int(x) for x in text.split(",") if x.strip()]
    except ValueError:
        return None


def unique_name(name: str, taken: list[str]) -> str:
    """name, or name (stub), name (stub2) and so on."""
    lower, k = {t.lower() for t in taken}, 1
    out = name
    while out.lower() in lower:
        out = f"{name} (stub{'' if k == 1 else k})"
        k += 1
    return out


def unique_header(header: list[str]) -> list[str]:
    out: list[str] = []
    for h in header:
        out.append(unique_name(h, out))
    return out


def synthetic_header(n: int) -> list[str]:
    return [f"COL_{i}" for i in range(n)]


def auto_map(main: list[str], key: list[str], ignore_case: bool = True) -> list[tuple[str, str]]:
    """Pairs of fields with one name."""
    fold = (lambda s: s.strip().lower()) if ignore_case else (lambda s: s)
    known = {}
    for k in key:
        known.setdefault(fold(k), k)
    return [(m, known[fold(m)]) for m in main if fold(m) in known]


def natural_key(name: str) -> list:
    """Sorts file2 before file10, whatever the case."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", name.lower()) if x]
