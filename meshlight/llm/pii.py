"""Personal data in texts, by anchors that a parser expands to the left and to the right.

One Aho-Corasick automaton runs over the whole text and stops at anchors: at-signs, dots and plus signs
before a digit, digits, the schemes' ``://``, colons of long addresses, and cues that announce an
identifier or a postal address. Each anchor's parser finds the boundaries around it and checks what it
found: numbers in range, check digits, lengths. A parser begins where its kind's last match ended, so
that matches of a kind are leftmost and never overlap, and every character is looked at by a bounded
number of steps.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` are the base. The method adds ``masked_email`` (at and
dot written out), ``login`` (an address with a user name or password before its host), ``ip6``, ``iban``,
``account`` (a number that a cue announces) and ``street`` (house number, name, kind of street). An
added span that overlaps a base span is left out, but for ``login``.

Rows: a null text counts as empty; empty texts have no spans. Texts are read whole, whatever their
length. Spans that begin at one place are ordered by kind. Rows that repeat have the same spans each; an
input column that has the name of the computed one is replaced; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from ipaddress import AddressValueError, IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight.llm.batches import appended

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "masked_email", "login", "ip6", "iban", "account", "street")
SPANS = "found array<struct<kind:string,start:bigint,end:bigint>>"

NUMBER_CUES = (
    "account number", "account no", "account nr", "account #", "acct no", "acct #", "a/c no", "customer number",
    "customer id", "member id", "patient id", "policy number", "passport number", "passport no", "licence number",
    "license number", "card number", "card no", "routing number", "social security number", "ssn", "tax id",
    "national insurance number", "kontonummer", "steuernummer", "numéro de compte", "número de cuenta", "dni", "nif",
)
STREET_ENDS = ("street", "avenue", "road", "boulevard", "lane", "drive", "square", "court", "terrace", "highway")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_THREE_PARTS = re.compile(r"(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"[ ().0-9-]*")
_MASKED_HOST = re.compile(r"[A-Za-z0-9-]+(?: ?(?:[(\[{] ?dot ?[)\]}]|\bdot\b|\.) ?[A-Za-z0-9-]+)+", re.IGNORECASE)
_USER_AND_HOST = re.compile(r"[^\s/@<>\"']+@[^\s/@<>\"':]+(?::[0-9]+)?(?:/[^\s<>\"']*)?")
_HEX = re.compile(r"[0-9A-Fa-f:]*")
_IBAN = re.compile(r"(?:\s*(?:number|no\.?|nr\.?))?\s*[:#=]?\s*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.IGNORECASE)
_NUMBER = re.compile(r"\.?(?:\s*(?:is|ist|est|es|number|no\.?))?\s*[:#=]?\s*([A-Za-z0-9]+(?:[ -]?[A-Za-z0-9]*[0-9][A-Za-z0-9]*)*)")


def _passes_luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _passes_mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _email(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or not (host := _DOMAIN.match(text, at + 1)):
        return None
    return start, host.end(), True


def _ip(text: str, dot: int, free: int) -> tuple[int, int, bool] | None:
    start = dot
    while start > free and text[start - 1] in _DIGITS:
        start -= 1
    if start == dot or not (rest := _THREE_PARTS.match(text, dot)):
        return None
    parts = [p.lstrip("0") for p in text[start : rest.end()].split(".")]
    return start, rest.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card(text: str, first: int, free: int) -> tuple[int, int, bool]:
    end = _CARD.match(text, first).end()
    valid = False
    if 14 <= end - first < 2 * 19:
        digits = text[first:end].replace(" ", "").replace("-", "")
        valid = 14 <= len(digits) <= 19 and _passes_luhn(digits)
    return first, end, valid


def _phone(text: str, plus: int, free: int) -> tuple[int, int, bool] | None:
    run = text[plus + 2 : _PHONE.match(text, plus + 2).end()].rstrip(" ().-")
    if len(run) < 2:
        return None
    return plus, plus + 2 + len(run), 10 <= 1 + sum(map(run.count, _DIGITS)) <= 15


def _masked_email(text: str, cue: int, free: int, length: int) -> tuple[int, int, bool] | None:
    end = cue
    while end > free and text[end - 1] == " ":
        end -= 1
    start = end
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    after = cue + length
    host = _MASKED_HOST.match(text, after + (text[after : after + 1] == " "))
    if start == end or not host:
        return None
    return start, host.end(), True


def _login(text: str, colon: int, free: int) -> tuple[int, int, bool] | None:
    start = colon
    while start > free and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
        start -= 1
    rest = _USER_AND_HOST.match(text, colon + 3)
    return (start, rest.end(), True) if rest and start < colon else None


def _ip6(text: str, colon: int, free: int) -> tuple[int, int, bool] | None:
    start = colon
    while start > free and text[start - 1] in "0123456789abcdefABCDEF":
        start -= 1
    end = _HEX.match(text, colon).end()
    found = text[start:end].rstrip(":") if not text[start:end].endswith("::") else text[start:end]
    if len(found) < 6 or found.count(":") < 3 or (start and text[start - 1].isalnum()):
        return start, end, False
    try:
        IPv6Address(found)
    except AddressValueError:
        return start, end, False
    return start, start + len(found), not text[start + len(found) : start + len(found) + 1].isalnum()


def _iban(text: str, cue: int, free: int, length: int) -> tuple[int, int, bool] | None:
    found = _IBAN.match(text, cue + length)
    if not found:
        return None
    # The longest beginning that ends at a group's end and passes; later words may look like groups.
    end = found.end(1)
    while end - found.start(1) >= 15:
        iban = text[found.start(1) : end].replace(" ", "").upper()
        if 15 <= len(iban) <= 34 and _passes_mod97(iban):
            return found.start(1), end, True
        end = max(text.rfind(" ", found.start(1), end), 0)
    return None


def _account(text: str, cue: int, free: int, length: int) -> tuple[int, int, bool] | None:
    found = _NUMBER.match(text, cue + length)
    if not found or (cue and text[cue - 1].isalnum()) or text[cue + length : cue + length + 1].isalpha():
        return None
    number = found.group(1)
    digits = sum(c in _DIGITS for c in number)
    return found.start(1), found.end(1), 6 <= digits <= 34 and 2 * digits >= len(number.replace(" ", "").replace("-", ""))


def _street(text: str, cue: int, free: int, length: int) -> tuple[int, int, bool] | None:
    """House number, one to four capitalised words and the kind of street that the cue names."""
    after = text[cue + length : cue + length + 1]
    words = text[max(free, cue - 120) : cue].split(" ")
    if after.isalnum() or words.pop() != "":
        return None
    begin = cue
    for taken, word in enumerate(reversed(words)):
        begin -= len(word) + 1
        number = word[:-1] if word[-1:].isalpha() else word
        if taken and 1 <= len(number) <= 5 and number.isascii() and number.isdigit():
            return begin, cue + length, True
        if taken == 4 or not word[:1].isupper():
            return None
    return None


def _variants(cue: str) -> set[str]:
    return {cue, cue.upper(), cue.title(), cue.capitalize()}


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    # Anchor: the kind whose parser it starts, its length, and whether the parser is told that length.
    anchors: dict[str, list[tuple[str, int, bool]]] = {}

    def add(anchor: str, kind: str, told: bool = False) -> None:
        anchors.setdefault(anchor, []).append((kind, len(anchor), told))

    add("@", "email")
    add("://", "login")
    for d in "0123456789":
        add("." + d, "ip")
        add(d, "card")
        add("+" + d, "phone")
    for c in "0123456789abcdefABCDEF:":
        add(":" + c, "ip6")
    for mark in ("(at)", "[at]", "{at}", "( at )", "[ at ]", "(AT)", "[AT]"):
        add(mark, "masked_email", True)
    for variant in _variants("iban"):
        add(variant, "iban", True)
    for cue in NUMBER_CUES:
        for variant in _variants(cue):
            add(variant, "account", True)
    for cue in STREET_ENDS:
        for variant in {cue.capitalize(), cue.upper()}:
            add(variant, "street", True)
    for anchor, starts in anchors.items():
        found.add_word(anchor, starts)
    found.make_automaton()
    return found


_PARSERS = {
    "email": _email, "ip": _ip, "card": _card, "phone": _phone, "masked_email": _masked_email, "login": _login,
    "ip6": _ip6, "iban": _iban, "account": _account, "street": _street,
}
_ORDER = {kind: i for i, kind in enumerate(KINDS)}
_shared: list = []


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans of a text, sorted."""
    if not _shared:
        _shared.append(_automaton())
    free = dict.fromkeys(KINDS, 0)
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    for last, starts in _shared[0].iter(text):
        for kind, length, told in starts:
            at = last - length + 1
            if at < free[kind]:
                continue
            match = _PARSERS[kind](text, at, free[kind], length) if told else _PARSERS[kind](text, at, free[kind])
            if match:
                start, end, valid = match
                free[kind] = end
                if valid:
                    found[kind].append((start, end))
    taken = sorted(s for kind in BASE for s in found[kind])
    out = [(start, _ORDER[kind], end) for kind in (*BASE, "login") for start, end in found[kind]]
    if any(found[kind] for kind in KINDS[len(BASE) :]):
        starts, ends = np.array([s for s, _ in taken]), np.maximum.accumulate([e for _, e in taken])
        for kind in KINDS[len(BASE) :]:
            if kind != "login":
                for start, end in found[kind]:
                    before = int(np.searchsorted(starts, end))  # base spans that begin before the end
                    if not before or ends[before - 1] <= start:
                        out.append((start, _ORDER[kind], end))
    return sorted(out)


def _columns(texts: pa.Array) -> dict[str, object]:
    found = [spans(t) for t in texts.to_pylist()]
    flat = np.array([s for own in found for s in own], np.int64).reshape(-1, 3)
    kinds = pa.array(KINDS).take(pa.array(flat[:, 1]))
    structs = pa.StructArray.from_arrays([kinds, pa.array(flat[:, 0]), pa.array(flat[:, 2])], ["kind", "start", "end"])
    offsets = np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32)
    return {"found": pa.ListArray.from_arrays(pa.array(offsets), structs)}


def scanned(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (its ``keep`` columns) with ``found``: kind, start and end of every span, in code points."""
    return appended(df, text, SPANS, _columns, keep)


def of_kind(found: Column, kinds: Sequence[str]) -> Column:
    """The spans of the given kinds."""
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def written_out(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
