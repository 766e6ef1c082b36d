"""JSON texts compared as values."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal, InvalidOperation

#: Whole numbers of at most so many digits stand as they are, larger ones as digits and exponent.
MAX_DIGITS = 400
#: Decimal fractions of so many digits are told apart by doubles.
EXACT_DIGITS = 15
#: Marks a number that is neither of them; no text of a JSON object has such a member beside it.
OTHER = "\0number"


def _number(text: str):
    """A number written with a point or exponent, so that equal numbers give equal values."""
    if len(text) <= EXACT_DIGITS + 1 and "e" not in text and "E" not in text:
        x = float(text)
        return int(x) if x.is_integer() else x
    try:
        sign, digits, exponent = Decimal(text).as_tuple()
    except InvalidOperation:
        return {OTHER: text}
    if not isinstance(exponent, int):
        return {OTHER: text}
    return _of("-" * sign, "".join(map(str, digits)).lstrip("0"), exponent)


def _integer(text: str):
    if len(text) <= MAX_DIGITS:
        return int(text)
    sign = "-" if text[0] == "-" else ""
    return _of(sign, text[len(sign):], 0)


def _of(sign: str, digits: str, exponent: int):
    kept = digits.rstrip("0")
    exponent += len(digits) - len(kept)
    if not kept:
        return 0
    if exponent >= 0 and len(kept) + exponent <= MAX_DIGITS:
        return int(sign + kept) * 10**exponent
    if len(kept) <= EXACT_DIGITS and -300 <= exponent < 0:
        return float(f"{sign}{kept}e{exponent}")
    return {OTHER: f"{sign}{kept}e{exponent}"}


def _without_nulls(value):
    if isinstance(value, dict):
        return {k: _without_nulls(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_without_nulls(v) for v in value]
    return value


def parse(text: str):
    return json.loads(text, parse_float=_number, parse_int=_integer)


def canonical(value) -> str:
    """Equal texts for equal values: member order, spacing and escapes don't matter, numbers count by value, a null
    member equals an absent one, list order matters. Of a repeated member the last holds."""
    return json.dumps(_without_nulls(value), sort_keys=True, separators=(",", ":"))


def canonical_text(text: str | None) -> str | None:
    """``canonical`` of a JSON text; a text that is no JSON stands for itself, null stays null."""
    if text is None:
        return None
    try:
        value = parse(text)
        return json.dumps(_without_nulls(value) if "null" in text else value, sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return "\0text" + text


def digest(text: str | None) -> bytes | None:
    """128 bits of the JSON value."""
    value = canonical_text(text)
    return None if value is None else hashlib.md5(value.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
