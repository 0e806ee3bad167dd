"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Patterns run in linear time on texts of any length. Spans of one kind do not overlap; spans of different kinds may.
Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame

from briefloom.llm.common import map_batches

#: Kinds in the order in which spans with equal starts are listed. The first four are always reported.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")  # the start of one
_IBAN_NEXT = re.compile(r" ?([A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")

# Lengths of international bank account numbers by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28,
    EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26,
    IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30,
    NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23,
    TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)


@dataclass(frozen=True)
class Context:
    """Score of a kind without context, and the words that raise or lower it."""

    score: float
    raising: frozenset[str]
    lowering: frozenset[str] = frozenset()


CONTEXTS = {
    "email": Context(0.8, frozenset("email mail contact write correo courriel".split())),
    "ip": Context(0.5, frozenset("ip host server address client login".split()), frozenset("version release section chapter build".split())),
    "card": Context(0.7, frozenset("card credit debit visa mastercard amex payment karte tarjeta carte".split()), frozenset("order invoice isbn tracking serial".split())),
    "phone": Context(0.6, frozenset("phone tel telephone call mobile cell fax telefon teléfono téléphone".split()), frozenset("score version".split())),
    "iban": Context(0.8, frozenset("iban account bank transfer konto cuenta compte".split())),
    "ssn": Context(0.3, frozenset("ssn social security taxpayer".split()), frozenset("part model serial order".split())),
}
STEP = 0.3  # what a context word adds or takes
REACH = 40  # code points on either side that count as nearby


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number without spaces has valid check digits."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Each at sign with a local part before it and a domain behind it: nothing is scanned twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
        # Only what follows the last at sign can belong to the next local part.
        done = max(done, text.rfind("@", done, at) + 1) if at >= 0 else done
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split("."))]


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def cards(text: str) -> list[tuple[int, int]]:
    found = ((m.span(), m[0]) for m in _CARD.finditer(text) if m.end() - m.start() >= 12)
    return [span for span, x in found if 12 <= len(d := _digits(x)) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers from each possible start, read to the length of their country and confirmed by the checksum."""
    out, m = [], _IBAN.search(text)
    while m:
        need, end, chars = IBAN_LENGTHS.get(m[0][:2], 0), m.end(), list(m[0])
        while len(chars) < need and (c := _IBAN_NEXT.match(text, end)):
            chars.append(c[1])
            end = c.end()
        whole = end == len(text) or not text[end].isalnum()
        confirmed = len(chars) == need and whole and mod97("".join(chars))
        if confirmed:
            out.append((m.start(), end))
        m = _IBAN.search(text, end if confirmed else m.start() + 1)
    return out


def ssns(text: str) -> list[tuple[int, int]]:
    found = (m for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000")
    return [m.span() for m in found]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones, ibans, ssns)))


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's score, moved by context words on either side; between 0 and 1."""
    context = CONTEXTS[kind]
    near = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    words = {w.lower() for w in _WORD.findall(near)}
    return min(1.0, max(0.0, context.score + STEP * bool(words & context.raising) - STEP * bool(words & context.lowering)))


def spans(text: str, threshold: float = 0.5) -> list[dict]:
    """All spans of a text by start and kind. Kinds beyond the first four need ``threshold``."""
    found = [
        {"kind": kind, "start": a, "end": b, "score": s, "base": kind in BASE_KINDS}
        for kind, find in FINDERS.items()
        for a, b in find(text)
        if (s := score(text, kind, a, b)) >= threshold or kind in BASE_KINDS
    ]
    return sorted(found, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col, spans array<struct<kind, start, end, score, base>>`` of every whole text.

    Null and empty texts have an empty list. One row per input row, repeated rows included, null identifiers pass
    through; other columns are not read. A projection without a shuffle.
    """
    span = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
    return map_batches(docs, id_col, text_col, f"spans {span}", lambda texts: {"spans": [spans(x, threshold) for x in texts]})


def redact(text: str, found: list[dict]) -> str:
    """The text with every span replaced by its kind; overlapping spans give one mark, that of the first."""
    out, done = [], 0
    for x in found:
        if x["start"] >= done:
            out += [text[done : x["start"]], f"<{x['kind'].upper()}>"]
        done = max(done, x["end"])
    return "".join([*out, text[done:]])
