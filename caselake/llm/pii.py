"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and cues of
identifiers. A local parser for each kind expands an anchor to the span around it and checks it;
the rest of a text is never looked at by Python.

Base kinds, leftmost and not overlapping within a kind: ``email``, ``ip``, ``card`` (Luhn),
``phone``. Kinds the method adds: ``account`` (name or number behind a cue such as "user:" or
"account no."), ``handle`` (@name that is no email), ``secret`` (long token behind a cue such as
"token =", at least 16 characters and a digit) and ``userinfo`` (name and password in an address,
scheme://name:password@host). Each value is expanded to its end, however far that is, and judged then.

Positions count code points, ends are exclusive. Null texts count as empty and have no spans; rows that
repeat are searched each; an empty table gives none. ``find`` reads no other columns. A text may be of any length: each parser moves on from the end of its
last match, so the work is linear in the text."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.llm.textwords import slices

# The kinds in the order of results, and the patterns of the base kinds.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "account", "handle", "secret", "userinfo"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HANDLE = re.compile(r"[A-Za-z0-9_]{3,}+(?![A-Za-z0-9_@.])")
_ACCOUNT = re.compile(r"(?:[ ]?(?:id|no|nr|name|number)\b\.?)?[ ]?[:=#][ ]?[\"']?([A-Za-z0-9][A-Za-z0-9._-]{2,}+)")
_SECRET = re.compile(r"[ ]?[:=][ ]?[\"']?([A-Za-z0-9_+/-]{16,}+={0,2})")
_USERINFO = re.compile(r"([^\s/?#@:]+:[^\s/?#@]+)@(?=[A-Za-z0-9])")
_SCHEMES = frozenset(["http", "https", "ftp", "ftps", "sftp", "ssh", "git", "postgres", "postgresql", "mysql",
                      "mongodb", "redis", "amqp", "smtp", "imap", "ldap", "jdbc"])
_CUES = {"account": ["account", "acct", "user", "login", "customer", "member"],
         "secret": ["token", "secret", "password", "passwd", "api_key", "apikey", "access_key"]}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, "digit")
    for anchor in ("@", "+", "://"):
        found.add_word(anchor, anchor)
    for kind, cues in _CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, kind)
    found.make_automaton()
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


class Finder:
    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end), by kind as listed, then start."""
        out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
        ends = dict.fromkeys(KINDS, 0)
        handles = []
        for last, anchor in self.anchors.iter(text):
            if anchor == "digit":
                if last >= ends["ip"] and (last == ends["ip"] or text[last - 1] not in "0123456789"):
                    if m := _IP.match(text, last):
                        ends["ip"] = m.end()
                        if all(map(_small, m[0].split("."))):
                            out["ip"].append(m.span())
                if last >= ends["card"] and (m := _CARD.match(text, last)):
                    ends["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        out["card"].append(m.span())
            elif anchor == "@":
                start = last
                while start > ends["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < last and (m := _DOMAIN.match(text, last + 1)):
                    out["email"].append((start, m.end()))
                    ends["email"] = m.end()
                elif (last == 0 or not text[last - 1].isalnum()) and (m := _HANDLE.match(text, last + 1)):
                    handles.append((last, m.end()))
            elif anchor == "+":
                if last >= ends["phone"] and (m := _PHONE.match(text, last)):
                    ends["phone"] = m.end()
                    if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                        out["phone"].append(m.span())
            elif anchor == "://":
                start = last - 2
                while start > 0 and last - start < 16 and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if text[start:last - 2].lower() in _SCHEMES and (m := _USERINFO.match(text, last + 1)):
                    out["userinfo"].append(m.span(1))
            else:
                pattern = _ACCOUNT if anchor == "account" else _SECRET
                if last + 1 >= ends[anchor] and (m := pattern.match(text, last + 1)):
                    value = m[1].rstrip(".-")
                    if anchor == "account" or any(c in "0123456789" for c in value):
                        out[anchor].append((m.start(1), m.start(1) + len(value)))
                        ends[anchor] = m.end()
        out["handle"] = handles
        return [(kind, a, b) for kind in KINDS for a, b in out[kind]]


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        finder = Finder()
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in finder.spans(text)] if text else []
                         for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, _SPAN_TYPE)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans {_SPANS}")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one, named
    after the kind listed first. A null text stays null."""
    schema = docs.schema

    def run(batches):
        finder = Finder()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                texts = [text and masked(text, finder.spans(text)) for text in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    joined: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(b, joined[-1][2])
            joined[-1][0] = min(kind, joined[-1][0], key=KINDS.index)
        else:
            joined.append([kind, a, b])
    parts, at = [], 0
    for kind, a, b in joined:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def listed(spans: str, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined, as text."""
    chosen = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
