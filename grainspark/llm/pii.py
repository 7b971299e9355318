"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, scheme marks and identifier cues such
as ``password``. At each anchor a local parser expands to the boundaries of an e-mail address, an IP address, a card
or phone number, a URL with a login, or a secret, and validates it. Every parser keeps the end of its last match, so
matches of a kind are leftmost and do not overlap, and no stretch of text is read more than a few times.

Kinds email, ip, card and phone are the base; secret (a value behind a cue, or a cloud access key) and login (user
information in a URL) are added by this method.

Edge cases: null is an empty text without spans; positions are code points, end exclusive; a match that fails its
validation is used up and dropped; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from grainspark.llm.common import map_texts, named

KINDS = ("email", "ip", "card", "phone", "secret", "login")
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_VALUE = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.\-]{8,})")
_ACCESS_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_USERINFO = re.compile(r"[^\s/@:<>\"']+(?::[^\s/@<>\"']*)?@(?=[A-Za-z0-9])")
CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "api-key", "access_key", "private_key", "auth_key")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    found.add_word("AKIA", ("access", 4))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def spans(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then by the order of ``KINDS``."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    email_end = ip_end = card_end = phone_end = secret_end = login_end = 0
    for last, (what, width) in automaton.iter(text):
        at = last - width + 1
        if what == "digit":
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, m.end(), "card"))
            if at >= ip_end:
                if m := _IP.match(text, at):
                    ip_end = m.end()
                    if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups()):
                        out.append((at, m.end(), "ip"))
                else:
                    ip_end = _DIGITS.match(text, at).end()
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append((start, m.end(), "email"))
        elif what == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((at, m.end(), "phone"))
        elif what == "cue":
            if at >= secret_end and (m := _VALUE.match(text, last + 1)) and any("0" <= c <= "9" for c in m[1]):
                secret_end = m.end()
                out.append((m.start(1), m.end(1), "secret"))
        elif what == "access":
            if at >= secret_end and (not at or not text[at - 1].isalnum()) and (m := _ACCESS_KEY.match(text, last + 1)):
                secret_end = m.end()
                out.append((at, m.end(), "secret"))
        elif at >= login_end and (m := _USERINFO.match(text, last + 1)):
            login_end = m.end()
            out.append((last + 1, m.end() - 1, "login"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def find_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end, value), by start and kind."""

    def start():
        automaton = anchors()

        def run(texts):
            return None, [[[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, b, k in spans(t, automaton)] for t in texts]]

        return run

    base = docs.select(named(id_col).cast("long").alias("doc_id"), named(text).alias("text"))
    return map_texts(base, "text", ["doc_id"], "spans array<struct<kind string, start long, end long, value string>>", start)
