"""Personal data by anchor expansion: one Aho-Corasick pass finds anchors, and local parsers expand and validate what is around them.

Anchors are at-signs, digits, `://`, `::` and identifier cues. A parser sees only the text around its anchor: it moves left and right
over the characters its kind allows, up to the end of the span of that kind before it, and checks the result (parts of an address, Luhn
and ISO 7064 check digits, number ranges). Each kind keeps the end of what it has read, so a text is read once per kind at most.

Base kinds are email, ip, card and phone. Added kinds, kept only where no base span lies:

- `mail`: addresses with letters of any script, quoted names or a bracketed IP, and those spelt with (at) and (dot);
- `login`: user information in front of the host of a URL, also where its end looks like an address; `ip6`: IPv6 addresses;
- `iban`: account numbers with a country code and valid check digits; `account`, `ssn`: numbers after a cue that names them.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, slim, texts_of

Span = tuple[str, int, int]

BASE = ("email", "ip", "card", "phone")
ADDED = ("mail", "login", "ip6", "iban", "account", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PARTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PHONE = re.compile(r"[ ().0-9-]*")
WIDE_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+|\[[0-9.]+\]")
SPELT = re.compile(r"\s?([\w-]+)((?:\s?(?:\.|[(\[]dot[)\]])\s?[\w-]+)+)", re.IGNORECASE)
AUTHORITY = re.compile(r"[^\s/?#\"<>]*")
HEX_RUN = re.compile(r"[0-9A-Fa-f:.]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
IBAN_LEAD = re.compile(r"\s{0,3}(?:(?:no|nr|number)\b\.?)?[\s:=#]{0,4}", re.IGNORECASE)
ACCOUNT = re.compile(r"\s{0,3}(?:(?:no|nr|num|number|nummer)\b\.?)?[\s:=#]{0,4}([0-9](?:[ -]?[0-9]){6,16})(?![0-9])", re.IGNORECASE)
SSN = re.compile(r"\s{0,3}(?:(?:no|number)\b\.?)?[\s:=#]{0,4}(([0-9]{3})-([0-9]{2})-([0-9]{4}))(?![0-9-])", re.IGNORECASE)
#: Cues by the kind they announce; each is looked for in small, capital and title letters.
CUES = {
    "iban": ("iban",), "ssn": ("ssn", "social security"), "account": ("account", "acct", "konto", "kontonummer", "cuenta", "compte"),
    "mail": ("(at)", "[at]"),
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in CUES.items():
        for word in words:
            for form in (word, word.upper(), word.title()):
                found.add_word(form, (kind, len(form)))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for mark in ("@", "://", "::"):
        found.add_word(mark, (mark, len(mark)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def iban_valid(written: str) -> bool:
    code = written.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def whole_word(text: str, lo: int, hi: int) -> bool:
    """Whether neither side of the span goes on with a letter, a digit or an underscore."""
    before, after = text[lo - 1 : lo], text[hi : hi + 1]
    return not (before.isalnum() or before == "_" or after.isalnum() or after == "_")


class Reader:
    """The spans of one text; `read` takes its anchors from left to right."""

    def __init__(self, text: str):
        self.text, self.base, self.added = text, [], []
        self.ends = dict.fromkeys((*BASE, *ADDED), 0)

    def digit(self, at: int) -> None:
        text = self.text
        if at >= self.ends["card"]:
            found = CARD.match(text, at)
            self.ends["card"] = found.end() if found else at + 1
            if found:
                digits = found.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    self.base.append(("card", at, found.end()))
        if at >= self.ends["ip"]:
            parts = PARTS.match(text, at).group().split(".")
            lo = at
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                hi = lo + len(".".join(four))
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in four):
                    self.base.append(("ip", lo, hi))
                lo = hi + 1
            self.ends["ip"] = at + len(".".join(parts))
        if at and text[at - 1] == "+" and at > self.ends["phone"]:
            run = PHONE.match(text, at + 1).group()
            last = len(run.rstrip(" ().-"))
            if last > 1:
                hi = at + 1 + last
                self.ends["phone"] = hi
                if 10 <= sum(c.isdigit() for c in text[at:hi]) <= 15:
                    self.base.append(("phone", at - 1, hi))

    def at_sign(self, at: int) -> None:
        text, lo = self.text, at
        while lo > self.ends["email"] and text[lo - 1] in LOCAL:
            lo -= 1
        found = DOMAIN.match(text, at + 1) if lo < at else None
        if found:
            self.ends["email"] = found.end()
            self.base.append(("email", lo, found.end()))
        self.wide_mail(at, at + 1)

    def wide_mail(self, at: int, after: int) -> None:
        """Addresses beyond ASCII, with a quoted name or an IP in brackets; the base form is left to the base kind."""
        text, lo, least = self.text, at, self.ends["mail"]
        if at - 1 > least and text[at - 1] == '"':
            lo = max(text.rfind('"', max(least, at - 66), at - 1), least)
            if text[lo] != '"' or lo + 2 > at - 1 or "\n" in text[lo:at]:
                return
        else:
            while lo > least and at - lo < 64 and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-"):
                lo -= 1
        found = WIDE_DOMAIN.match(text, after)
        if lo < at and found and (not found.group().startswith("[") or self.four(found.group()[1:-1])):
            hi = found.end()
            last = text[lo:hi].rsplit(".", 1)[-1]
            if text[hi - 1] == "]" or (len(last) > 1 and last.isalpha()):
                self.ends["mail"] = hi
                self.added.append(("mail", lo, hi))

    @staticmethod
    def four(text: str) -> bool:
        parts = text.split(".")
        return len(parts) == 4 and all(p and len(p) < 4 and int(p) < 256 for p in parts)

    def spelt_mail(self, lo: int, hi: int) -> None:
        """name (at) host (dot) domain."""
        text = self.text
        at = lo
        while at > self.ends["mail"] and lo - at < 3 and text[at - 1] == " ":
            at -= 1
        start = at
        while start > self.ends["mail"] and at - start < 64 and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        found = SPELT.match(text, hi, hi + 256)
        if start < at and found:
            last = re.split(r"[.)\]]\s?", found.group(2))[-1]
            if len(last) > 1 and last.isalpha():
                self.ends["mail"] = found.end()
                self.added.append(("mail", start, found.end()))

    def scheme(self, at: int, after: int) -> None:
        authority = AUTHORITY.match(self.text, after, after + 2_048).group()
        user, sign, _ = authority.rpartition("@")
        if sign and ":" in user and after >= self.ends["login"]:
            self.ends["login"] = after + len(user)
            self.added.append(("login", after, after + len(user)))

    def colons(self, at: int) -> None:
        text, lo = self.text, at
        while lo > self.ends["ip6"] and at - lo < 45 and (text[lo - 1] in ":." or text[lo - 1] in "0123456789abcdefABCDEF"):
            lo -= 1
        hi = HEX_RUN.match(text, at).end()
        self.ends["ip6"] = hi
        while hi > at + 2 and text[hi - 1] == ".":
            hi -= 1
        if hi - lo > 45 or not whole_word(text, lo, hi) or sum(bool(p) for p in text[lo:hi].split(":")) < 3:
            return
        try:
            ipaddress.IPv6Address(text[lo:hi])
        except ValueError:
            return
        self.added.append(("ip6", lo, hi))

    def cue(self, kind: str, lo: int, hi: int) -> None:
        text = self.text
        if kind == "mail":
            return self.spelt_mail(lo, hi)
        if hi < self.ends[kind] or not whole_word(text, lo, hi):
            return
        if kind == "iban":
            found = IBAN.match(text, IBAN_LEAD.match(text, hi).end())
            # The last groups may be words that follow the number.
            while found and not iban_valid(found.group()):
                cut = found.group().rfind(" ")
                found = IBAN.fullmatch(text, found.start(), found.start() + cut) if cut > 0 else None
            if found:
                self.ends[kind] = found.end()
                self.added.append((kind, found.start(), found.end()))
            return
        found = (SSN if kind == "ssn" else ACCOUNT).match(text, hi)
        if found and (kind != "ssn" or (found[2] not in ("000", "666") and found[2] < "900" and found[3] != "00" and found[4] != "0000")):
            self.ends[kind] = found.end(1)
            self.added.append((kind, found.start(1), found.end(1)))

    def read(self) -> list[Span]:
        for last, (kind, size) in automaton().iter(self.text):
            if kind == "digit":
                self.digit(last)
            elif kind == "@":
                self.at_sign(last)
            elif kind == "://":
                self.scheme(last - 2, last + 1)
            elif kind == "::":
                if last - 1 >= self.ends["ip6"]:
                    self.colons(last - 1)
            else:
                self.cue(kind, last + 1 - size, last + 1)
        rank = {k: i for i, k in enumerate((*BASE, *ADDED))}
        base = sorted(self.base, key=lambda s: (s[1], rank[s[0]]))
        return sorted(base + free_of(base, sorted(set(self.added), key=lambda s: (s[1], rank[s[0]]))), key=lambda s: (s[1], rank[s[0]]))


def free_of(base: Sequence[Span], added: Sequence[Span]) -> list[Span]:
    """Those of `added` that no base span overlaps, and logins; both by start."""
    out, i, reach = [], 0, 0
    for span in added:
        while i < len(base) and base[i][1] < span[2]:
            reach = max(reach, base[i][2])
            i += 1
        # Spans of `base` that begin before this one ends; all of them end by `reach`.
        if reach <= span[1] or span[0] == "login":
            out.append(span)
    return out


def masked(text: str, spans: Sequence[Span]) -> str:
    """The text with each span, overlaps together, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, lo, hi in spans:
        if lo >= at:
            out += [text[at:lo], f"<{kind}>"]
        at = max(at, hi)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end in code points; by start, then kind) and, with `mask`, masked_text.

    Base kinds are found leftmost without overlaps within a kind; spans of different kinds may overlap, and an added span that meets a
    base span is left out. Null and empty texts have no spans. Equal rows give equal rows, null ids stay null, other columns are left
    out, an empty table gives an empty result. Each text is read whole by one pass in its task; nothing is shuffled.
    """
    ddl = f"doc_id bigint, spans {SPANS}" + (", masked_text string" if mask else "")
    out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            found = [Reader(t).read() for t in texts]
            columns = [batch.column("doc_id"), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], out.field("spans").type)]
            if mask:
                columns.append(pa.array([masked(t, s) for t, s in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return slim(docs, doc_id=id_col, text=text_col).mapInArrow(run, ddl)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
