"""Personal data by anchor expansion: cues found by Aho-Corasick, spans grown and checked by local parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Kinds in the order of the output; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "account", "userinfo")
BASE_KINDS = KINDS[:4]

#: Words that announce an account number.
_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "customer no", "member id")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED, _SPACED = re.compile(r"[0-9.]+"), re.compile(r"[0-9\x20-]+")
_CHAIN, _PART = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\W{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|n°|#|id))? ?[:#=]? ?([0-9][0-9-]{4,20}[0-9])(?![0-9-])", re.I)
_USERINFO = re.compile(r"([^\s/@:\"'<>]+:[^\s/@\"'<>]+)@[A-Za-z0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_made = None


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def addresses(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Each four numbers of a chain of numbers joined by single dots, where none exceeds 255; leading zeros do not count.

    The chain is walked once, so long runs of digits cost their length only.
    """
    out = []
    for chain in _CHAIN.finditer(text, start, end):
        parts = [m.span() for m in _PART.finditer(text, *chain.span())]
        for four in (parts[i : i + 4] for i in range(0, len(parts) - 3, 4)):
            plain = [text[a:b].lstrip("0") for a, b in four]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in plain):
                out.append((four[0][0], four[3][1]))
    return out


def _automaton():
    """Cues by what they announce: '@', '+', digits, '://', IBAN and account words in three spellings."""
    global _made
    if _made is None:
        import ahocorasick

        _made = ahocorasick.Automaton()
        for cue, kind in [("@", "email"), ("+", "phone"), ("://", "scheme"), *((d, "digit") for d in "0123456789")]:
            _made.add_word(cue, (kind, 1))
        for cue, kind in [("iban", "iban"), *((c, "account") for c in _CUES)]:
            for spelling in {cue, cue.upper(), cue.capitalize()}:
                _made.add_word(spelling, (kind, len(spelling)))
        _made.make_automaton()
    return _made


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in ``KINDS`` and then by start.

    Within each base kind spans are the leftmost non-overlapping matches of the kind's pattern that pass its check; a
    match that fails is dropped and search goes on behind it.
    """
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    email_end = dotted_end = spaced_end = 0
    for last, (cue, _) in _automaton().iter(text):
        if cue == "digit":
            if last >= dotted_end:
                zone = _DOTTED.match(text, last)
                dotted_end = zone.end()
                if dotted_end - last >= 7:
                    found["ip"] += addresses(text, last, dotted_end)
            if last >= spaced_end:
                zone = _SPACED.match(text, last)
                spaced_end = zone.end()
                if spaced_end - last >= 13:
                    for m in _CARD.finditer(text, last, spaced_end):
                        digits = _NOT_DIGIT.sub("", m[0])
                        if 13 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append(m.span())
        elif cue == "email":
            if last < email_end:
                continue
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, last + 1)
            if start < last and domain:
                email_end = domain.end()
                found["email"].append((start, email_end))
        elif cue == "phone":
            m = _PHONE.match(text, last)
            if m and 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
        elif cue == "scheme":
            m = _USERINFO.match(text, last + 1)
            if m:
                found["userinfo"].append(m.span(1))
        elif cue == "iban":
            m = _IBAN.match(text, last + 1)
            if m and iban_valid(m[1]):
                found["iban"].append(m.span(1))
        else:
            m = _ACCOUNT.match(text, last + 1)
            if m and (not found["account"] or m.start(1) >= found["account"][-1][1]):
                found["account"].append(m.span(1))
    return [(kind, *span) for kind in KINDS for span in found[kind]]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(text.as_py() or "")] for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points, for every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Repeated rows and null ids are treated like any row. Very long texts, runs of digits and
    chains of dots among them, are scanned whole in time linear in their length. Of spans that start at the same place each kind has
    at most one. An empty table gives no rows; other columns, whatever their names, are ignored. Nothing is shuffled.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return source.mapInArrow(_scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
