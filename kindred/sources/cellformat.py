"""What a numeric spreadsheet cell displays: its number under its format code.

Codes have up to four sections (positive, negative, zero, text). A section with letters of a date outside quotes is a date,
any other a number: digits with grouping, fixed and optional decimals, percent and exponents, and literal text around
them. Fractions are shown like general numbers.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

# The built-in formats of the file format's standard.
BUILT_IN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 5: "$#,##0_);($#,##0)", 6: "$#,##0_);[Red]($#,##0)", 7: "$#,##0.00_);($#,##0.00)", 8: "$#,##0.00_);[Red]($#,##0.00)",
    9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
TOKEN = re.compile(r'"[^"]*"|\\.|_.|\*.|\[\$[^\]-]*[^\]]*\]|\[(?:h+|m+|s+)\]|\[[^\]]*\]|AM/PM|A/P|y+|m+|d+|h+|s+|[0#?]+(?:,[0#?]+)*|E[+-]|.', re.I | re.S)
ELAPSED = {"h": 3600, "m": 60, "s": 1}


def general(number: float) -> str:
    return str(int(number)) if number.is_integer() and abs(number) < 1e11 else f"{number:.10g}"


def display(number: float, code: str | None, since_1904: bool = False) -> str:
    """The number as the format code shows it; without one, or for General, as a general number."""
    if not code or code.lower() in ("general", "@"):
        return general(number)
    sections = _sections(code)
    own = 1 if number < 0 and len(sections) > 1 else 2 if number == 0 and len(sections) > 2 else 0
    tokens = TOKEN.findall(sections[own])
    if any(re.fullmatch(r"\[(?:h+|m+|s+)\]|y+|d+|h+|s+|m+", t, re.I) for t in tokens):
        return _date(number, tokens, since_1904) if number >= 0 else general(number)
    if "/" in tokens or sections[own].strip().lower() == "general":
        return general(number)
    return _number(abs(number) if own == 1 else number, tokens)


def _sections(code: str) -> list[str]:
    out = [""]
    for t in re.findall(r'"[^"]*"|\\.|\[[^\]]*\]|.', code, re.S):
        if t == ";":
            out.append("")
        else:
            out[-1] += t
    return out


def _literal(token: str) -> str:
    if token[0] == '"':
        return token[1:-1]
    if token[0] == "\\":
        return token[1:]
    if token[0] in "_*" and len(token) > 1:
        return ""
    if token[0] == "[":
        return token[2:-1].split("-")[0] if token[1:2] == "$" else ""
    return token


def _number(number: float, tokens: list[str]) -> str:
    digits = [i for i, t in enumerate(tokens) if t[0] in "0#?"]
    if not digits:
        return "".join(map(_literal, tokens))
    value = Decimal(repr(number)) * 100 ** sum(t == "%" for t in tokens)
    point = next((i for i, t in enumerate(tokens) if t == "." and (i + 1 in digits or i - 1 in digits)), None)
    power = next((i for i, t in enumerate(tokens) if re.fullmatch("E[+-]", t, re.I)), None)
    mantissa = [i for i in digits if power is None or i < power]
    whole = "".join(tokens[i] for i in mantissa if point is None or i < point)
    part = "".join(tokens[i] for i in mantissa if point is not None and i > point)
    # commas after the last digit divide by a thousand
    scaled = sum(t == "," for t in tokens[mantissa[-1] + 1 :])
    value = value / 1000**scaled if scaled else value
    exponent = 0
    if power is not None:
        width = max(1, len(whole.replace(",", "")))
        while value and abs(value) >= 10**width:
            value, exponent = value / 10, exponent + 1
        while value and abs(value) < 10 ** (width - 1):
            value, exponent = value * 10, exponent - 1
    shown = abs(value).quantize(Decimal(1).scaleb(-len(part)), ROUND_HALF_UP)
    left, _, right = f"{shown:f}".partition(".")
    least = len(part.rstrip("#?"))
    while len(right) > least and right.endswith("0"):
        right = right[:-1]
    left = left.lstrip("0").rjust(whole.count("0"), "0")
    if "," in whole:
        left = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", left)
    text = left + (f".{right}" if right or (point is not None and not part) else "")
    if power is not None:
        sign = "-" if exponent < 0 else "+" if tokens[power][1] == "+" else ""
        text += f"E{sign}{str(abs(exponent)).rjust(sum(tokens[i].count('0') for i in digits if i > power), '0')}"
    first, last = digits[0], digits[-1]
    first = min(first, point) if point is not None else first
    head, tail = "".join(map(_literal, tokens[:first])), "".join(_literal(t) for t in tokens[last + 1 :] if t not in (",", "."))
    return ("-" if value < 0 and shown else "") + head + text + tail


def _date(number: float, tokens: list[str], since_1904: bool) -> str:
    # the calendar of 1900 counts a day in that February that never was
    base = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31 if number < 60 else 30)
    tenths = any(t == "." for t in tokens)
    seconds = Decimal(repr(number)) * 86400
    at = base + timedelta(milliseconds=int(seconds.quantize(Decimal("0.001") if tenths else Decimal(1), ROUND_HALF_UP) * 1000))
    noon = any(t.upper() in ("AM/PM", "A/P") for t in tokens)
    kinds = [t[0].lower() if re.fullmatch("y+|m+|d+|h+|s+", t, re.I) else t[1].lower() if re.fullmatch(r"\[(?:h+|m+|s+)\]", t, re.I) else "" for t in tokens]
    order = [(i, k) for i, k in enumerate(kinds) if k]
    out = []
    for i, t in enumerate(tokens):
        kind, n = kinds[i], len(t)
        if t[0] == "[" and kind:
            out.append(str(int(seconds // ELAPSED[kind])).rjust(n - 2, "0"))
        elif kind == "m":
            k = [j for j, _ in order].index(i)
            minutes = (k > 0 and order[k - 1][1] == "h") or (k + 1 < len(order) and order[k + 1][1] == "s")
            out.append(f"{at.minute:0{min(n, 2)}d}" if minutes else at.strftime("%B" if n == 4 else "%b") if n in (3, 4) else at.strftime("%B")[0] if n == 5 else f"{at.month:0{n}d}")
        elif kind == "y":
            out.append(f"{at.year:04d}" if n > 2 else f"{at.year % 100:02d}")
        elif kind == "d":
            out.append(at.strftime("%A" if n > 3 else "%a") if n > 2 else f"{at.day:0{n}d}")
        elif kind == "h":
            hour = (at.hour % 12 or 12) if noon else at.hour
            out.append(f"{hour:0{min(n, 2)}d}")
        elif kind == "s":
            out.append(f"{at.second:0{min(n, 2)}d}")
        elif t.upper() in ("AM/PM", "A/P"):
            out.append(("AM" if at.hour < 12 else "PM")[: 2 if len(t) > 3 else 1])
        elif t[0] in "0#?" and tenths:
            out.append(f"{at.microsecond // 1000:03d}"[:n])
        else:
            out.append(_literal(t))
    return "".join(out)
