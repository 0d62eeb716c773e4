"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digit pairs, digit-dot pairs, scheme
separators and identifier cues.  From each anchor a deterministic local parser expands to the boundaries of an
address or number and validates it.  Spans are code points, end exclusive.

Base kinds (email, ip, card, phone) equal leftmost non-overlapping regex matches per kind, of which failing ones are
dropped without retries.  Added kinds: account, iban (after a cue), url (around a scheme) and secret: the value that is
assigned to a cue like ``token`` or ``password``, of twelve characters or more with letters and digits.

Defined cases: a null text is empty and has no spans; every row gives a row, repeated or not; other columns stay
untouched, whatever their names; texts of any length are searched whole; matches that start at the same place (ties) are
listed by kind; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "iban", "url", "secret")
#: Identifier cues.
CUES = ("account", "acct", "iban", "konto", "cuenta", "compte", "ssn", "passport", "customer id", "user id", "member id")
#: Cues of assigned secrets.
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "api key", "access_key", "private_key", "auth_key")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|id|#))?\x20?[:=#]?\x20?([A-Za-z]{0,4}[0-9][A-Za-z0-9-]{4,33})(?![A-Za-z0-9])")
_IBAN = re.compile(r"\x20?[:=#]?\x20?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8})(?![A-Za-z0-9])")
_SECRET = re.compile(r"""["']?\x20{0,4}(?:=>|:=|[=:])\x20{0,4}["']?([A-Za-z0-9+/_.~=-]{12,})""")
_URL_REST = re.compile(r"[^\s<>\"'`]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
_machine = None


def automaton():
    """The anchors' automaton; its values are (anchor class, length)."""
    global _machine
    if _machine is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", ("email", 1))
        a.add_word("+", ("phone", 1))
        a.add_word("://", ("url", 3))
        for d in "0123456789":
            a.add_word(f"{d}.", ("ip", 2))
            for e in "0123456789":
                for gap in ("", " ", "-"):
                    a.add_word(f"{d}{gap}{e}", ("card", 2 + len(gap)))
        for cue in CUES:
            for form in {cue, cue.capitalize(), cue.upper()}:
                a.add_word(form, ("account", len(form)))
        for cue in SECRET_CUES:
            for form in {cue, cue.capitalize(), cue.upper()}:
                a.add_word(form, ("secret", len(form)))
        a.make_automaton()
        _machine = a
    return _machine


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    code = text.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind as listed, then start."""
    if not text:
        return []
    found = {k: [] for k in BASE + ADDED}
    over = dict.fromkeys(BASE + ADDED, 0)  # where the last match of a kind ended
    n = len(text)
    for last, (kind, size) in automaton().iter(text):
        start = last - size + 1
        if kind == "card":
            if start >= over["card"]:
                m = _CARD.match(text, start)
                over["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((start, m.end()))
        elif kind == "ip":
            if start >= over["ip"]:
                while start > over["ip"] and text[start - 1] in _DIGITS:
                    start -= 1
                if m := _IP.match(text, start):
                    over["ip"] = m.end()
                    if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
                        found["ip"].append((start, m.end()))
        elif kind == "email":
            low = last
            while low > over["email"] and text[low - 1] in _LOCAL:
                low -= 1
            if low < last and (m := _DOMAIN.match(text, last + 1)):
                over["email"] = m.end()
                found["email"].append((low, m.end()))
        elif kind == "phone":
            if start >= over["phone"] and (m := _PHONE.match(text, start)):
                over["phone"] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found["phone"].append((start, m.end()))
        elif kind == "url":
            low = start
            while low > over["url"] and text[low - 1] in _SCHEME:
                low -= 1
            while low < start and not text[low].isalpha():
                low += 1
            if low < start and (m := _URL_REST.match(text, last + 1)):
                rest = m[0].rstrip(".,;:!?)]}")
                if rest:
                    over["url"] = last + 1 + len(rest)
                    found["url"].append((low, over["url"]))
        elif kind == "secret":
            if (start == 0 or not text[start - 1].isalnum()) and (m := _SECRET.match(text, last + 1)) and m.start(1) >= over["secret"]:
                value = m[1].rstrip(".")
                if len(value) >= 12 and any(c in _DIGITS for c in value) and any(c.isalpha() for c in value):
                    over["secret"] = m.start(1) + len(value)
                    found["secret"].append((m.start(1), over["secret"]))
        elif (start == 0 or not text[start - 1].isalnum()) and (last + 1 < n):
            if (m := _IBAN.match(text, last + 1)) and m.start(1) >= over["iban"] and _iban_ok(m[1]):
                over["iban"] = m.end(1)
                found["iban"].append((m.start(1), m.end(1)))
            elif (m := _ACCOUNT.match(text, last + 1)) and m.start(1) >= over["account"] and sum(c in _DIGITS for c in m[1]) >= 5:
                over["account"] = m.end(1)
                found["account"].append((m.start(1), m.end(1)))
    return [(k, a, b) for k in BASE + ADDED for a, b in found[k]]


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    own = sorted(((a, -b, k) for k, a, b in spans(text)))
    if not own:
        return text
    out, at = [], 0
    for a, b, k in own:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = -b
        else:
            at = max(at, -b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) of every row."""

    def search(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            own = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, kind)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(search, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans, the string of all spans, and the numbers of secrets and of all spans."""

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    more = [count("secret"), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), *more)


def redact(docs: DataFrame) -> DataFrame:
    """The rows with personal data in ``text`` replaced; every other column as it was, n_chars fitted to the new text."""
    place = docs.columns.index("text")

    def swap(batches):
        for batch in batches:
            text = pa.array([redacted(t) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if k == place else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    out = docs.mapInArrow(swap, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
