"""Secret scan: candidate strings judged by a random forest that was trained on labelled findings."""

from __future__ import annotations

import bisect
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import Forest, fit_forest
from .summing import partition_sums
from .words import ALNUM_FOLDED, Words, slices, text_arrays

#: A candidate is a maximal run of at least 12 of these, or the value of at least 6 characters that a telling name is given.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{12,}")
_JOINT = re.compile(r"[=:]")
_NAMED = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|credential|auth|private_key)[A-Za-z0-9_]{0,16}[\"']?[ \t]{0,2}\Z", re.I)
_VALUE = re.compile(r"[ \t]{0,2}(?:\"([^\"\s]{6,128})\"|'([^'\s]{6,128})'|([^\s\"',;]{6,128}))")
_NAME_REACH = 40
_TRIM = re.compile(r"^(?:[A-Za-z_-]{2,20}=)+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CUE = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api|apikey|key|credential|auth|bearer|private)", re.I)
_DIGEST = re.compile(r"(?:sha\d*|md5|commit|digest|checksum|hash|etag|uuid|version|revision|integrity|image|base64)", re.I)
_PLACEHOLDER = re.compile(r"(?:example|changeme|change|your|dummy|sample|test|placeholder|xxxx|redacted|insert|here)", re.I)
_PATH_CODE = re.compile(r"(?:\.env|\.ya?ml|\.json|\.ini|\.cfg|\.conf|\.properties|\.py|\.js|\.sh)$", re.I)
_PATH_NOISE = re.compile(r"(?:test|fixture|example|\.lock|\.min\.js|vendor)", re.I)
_SLOTS, _CLASSES = 1 << 16, 40


def _classes() -> np.ndarray:
    out = np.full(256, _CLASSES - 1, np.int64)
    for letter in range(26):
        out[97 + letter] = out[65 + letter] = letter
    out[48:58] = 26 + np.arange(10)
    return out


_CLASS = _classes()


@dataclass(frozen=True)
class CorpusStatistics:
    """Log-probabilities of a character class after another, and which word slots are frequent; both of fixed size."""

    transitions: np.ndarray
    frequent: np.ndarray

    @staticmethod
    def of(docs: DataFrame) -> CorpusStatistics:
        """Counts over all texts of ``docs``."""

        def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(_CLASSES * _CLASSES + _SLOTS)
            for batch in slices(batches, "text"):
                data, offsets = text_arrays(batch.column("text"))
                kind = _CLASS[data]
                total[: _CLASSES * _CLASSES] += np.bincount(kind[:-1] * _CLASSES + kind[1:], minlength=_CLASSES * _CLASSES)
                slot = (Words(data, offsets, ALNUM_FOLDED).hashes() % np.uint64(_SLOTS)).astype(np.int64)
                total[_CLASSES * _CLASSES :] += np.bincount(slot, minlength=_SLOTS)
            return total

        total = partition_sums(docs.select("text"), sums, _CLASSES * _CLASSES + _SLOTS)
        pairs = total[: _CLASSES * _CLASSES].reshape(_CLASSES, _CLASSES) + 1
        slots = total[_CLASSES * _CLASSES :]
        return CorpusStatistics(np.log(pairs / pairs.sum(1, keepdims=True)), slots >= max(3.0, 2 * slots.mean()))


def named_values(text: str) -> list[tuple[int, int]]:
    """Spans of the values that names such as ``password`` are given by "=" or ":", in quotes or up to white space."""
    out: list[tuple[int, int]] = []
    for m in _JOINT.finditer(text):
        if out and m.start() < out[-1][1] or not _NAMED.search(text[max(0, m.start() - _NAME_REACH) : m.start()]):
            continue
        value = _VALUE.match(text, m.end())
        if value:
            start, end = value.span(value.lastindex)
            if value.lastindex == 3:
                end = start + len(value[3].rstrip(".)]}>"))
            if end - start >= 6:
                out.append((start, end))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidate strings by their places, none in another; a leading ``name=`` is no part of one."""
    out = named_values(text)
    taken, after = [start for start, _ in out], [end for _, end in out]
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        at = bisect.bisect_left(after, start + 1)
        if at < len(taken) and taken[at] < end:
            continue
        if name := _TRIM.match(m[0].rstrip("=")):
            start += name.end()
        while end > start and text[end - 1] in "-_/":
            end -= 1
        if end - start >= 12:
            out.append((start, end))
    return sorted(out)


_SHARES = tuple(map(frozenset, (string.digits, string.ascii_uppercase, string.ascii_lowercase, "abcdef0123456789", string.punctuation)))


def features(text: str, spans: list[tuple[int, int]], path: str, corpus: CorpusStatistics) -> np.ndarray:
    """Length, entropy, character shares and transitions, dictionary coverage, path, and neighbouring words of each span."""
    rows = []
    for start, end in spans:
        word = text[start:end]
        n = len(word)
        counts = Counter(word)
        share = [sum(k for c, k in counts.items() if c in chars) / n for chars in _SHARES]
        entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
        kind = _CLASS[np.frombuffer(word.encode(), np.uint8)]
        parts = [p for p in _PARTS.findall(word) if len(p) >= 3 and p.isalpha()]
        known = 0
        if parts:
            joined = pa.array(parts, pa.string())
            slot = Words(*text_arrays(joined), ALNUM_FOLDED).hashes() % np.uint64(_SLOTS)
            known = sum(len(p) for p, hit in zip(parts, corpus.frequent[slot.astype(np.int64)], strict=True) if hit)
        before, after = text[max(0, start - 32) : start], text[end : end + 16]
        near = before.rsplit("\n", 1)[-1]
        changes = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(word, word[1:], strict=False))
        rows.append(
            [n, entropy, *share, corpus.transitions[kind[:-1], kind[1:]].mean(), changes / n, known / n]
            + [bool(_CUE.search(near[-24:])), bool(_DIGEST.search(near[-16:])), near.rstrip()[-1:] in ("=", ":"), before[-1:] in ("'", '"', "`"), after[:1] in ("'", '"', "`")]
            + [bool(_PLACEHOLDER.search(word)), bool(_CUE.search(after)), bool(_PATH_CODE.search(path)), bool(_PATH_NOISE.search(path))]
        )
    return np.array(rows, float).reshape(len(spans), 19)


@dataclass(frozen=True)
class Finding:
    """A candidate in its text, with its path and whether it is a secret."""

    text: str
    start: int
    end: int
    path: str
    secret: bool


#: Words around the made-up findings; fixed values.
_PROSE = "the service reads its settings when it starts and writes a line for each request that fails please see release notes for more details about this change".split()


def labelled_findings(n: int = 6000, seed: int = 5) -> list[Finding]:
    """Made-up labelled findings, half of them secrets: keys, tokens and passwords as they are leaked, and look-alikes."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: rng.choice(_PROSE)
    syllable = lambda: pick("bcdfghlmnprstvz", 1) + pick("aeiou", 1) + pick("nrstl", rng.randint(0, 1))
    coined = lambda: "".join(syllable() for _ in range(rng.randint(6, 10)))
    quote = lambda s: rng.choice([s, f'"{s}"', f"'{s}'"])
    cue = lambda: rng.choice(["password", "passwd", "token", "secret", "api_key", "API_KEY", "auth_token", "client_secret", "private_key"])
    joint = lambda: rng.choice(["=", " = ", ": "])
    symbols = "!@#$%&*?+"
    mixed = lambda k: "".join(rng.sample(pick(alnum, k - 3) + pick(string.digits, 2) + pick(symbols, 1), k))
    secrets = [
        lambda: ("", "AKIA" + pick(string.ascii_uppercase + string.digits, 16)),
        lambda: ("", rng.choice(["ghp_", "gho_", "sk-", "xoxb-", "glpat-"]) + pick(alnum, rng.randint(20, 48))),
        lambda: (cue() + joint(), pick(hexes, rng.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: (cue() + joint(), pick(alnum + "+/", rng.randint(16, 48))),
        lambda: ("Authorization: Bearer ", pick(alnum + "-_", rng.randint(24, 80))),
        lambda: (cue() + joint(), mixed(rng.randint(8, 16))),
        lambda: (cue() + joint(), word().capitalize() + pick("!@#$%&*", 1) + pick(string.digits, rng.randint(2, 4)) + pick(alnum, 2)),
    ]
    others = [
        lambda: (rng.choice(["sha256:", "commit ", "etag ", "digest: ", "checksum = ", "md5 "]), pick(hexes, rng.choice([32, 40, 64]))),
        lambda: ("", "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))),
        lambda: ("", "".join(word() for _ in range(rng.randint(3, 6)))[: rng.randint(12, 40)].ljust(12, "e")),
        lambda: ("", rng.choice([str.lower, str.upper, str.capitalize])(coined())),
        lambda: ("", "-".join([coined(), coined()]).upper()),
        lambda: ("", "_".join(word() for _ in range(rng.randint(3, 5))) + "_value"),
        lambda: ("", word() + "".join(word().capitalize() for _ in range(4)) + "Id"),
        lambda: ("https://site.org/", "/".join([word(), word(), word(), pick(string.digits, 4)]) + "/page"),
        lambda: (cue() + joint(), rng.choice(["changeme_please", "your_token_here", "example_password", "xxxxxxxxxxxxxxxx", "insert-secret-here"])),
        lambda: ("", pick(string.digits, rng.randint(12, 19))),
        lambda: (cue() + joint(), rng.choice(["required", "optional", "string", "hidden", "disabled", "expired", "missing", "invalid", word().ljust(6, "s"), coined()])),
        lambda: (cue() + joint(), rng.choice(["${" + word().upper() + "_SECRET}", "$PASSWORD", "<your-token>", "{{ token }}", "os.environ[" + word() + "]", "getpass()", "********", "None,None"])),
        lambda: ("data:image/png;base64,", pick(alnum + "+/", rng.randint(60, 200)) + "=="),
        lambda: ("", rng.choice(string.ascii_lowercase) * rng.randint(12, 40)),
        lambda: ("", rng.choice("-=_") * rng.randint(12, 60)),
        lambda: ("", "2024-01-02T" + pick(string.digits, 6) + "Z-" + word()),
    ]
    out = []
    while len(out) < n:
        secret = len(out) % 2 == 0
        lead, value = rng.choice(secrets if secret else others)()
        lead = " ".join(word() for _ in range(rng.randint(0, 6))) + rng.choice([" ", "\n"]) + lead
        shown = quote(value) if secret or rng.random() < 0.3 else value
        text = lead + shown + rng.choice([" ", "\n", ". "]) + " ".join(word() for _ in range(rng.randint(0, 6)))
        start = len(lead) + (shown != value)
        found = [s for s in candidates(text) if s[0] <= start + 2 and s[1] >= start + len(value) - 3]
        if found:
            path = rng.choice(["", "", "conf/app.yaml", "src/main.py", ".env", "tests/fixtures/a.json", "package.lock", "notes.txt"])
            out.append(Finding(text, *found[0], path, secret))
    return out


def learn_secrets(findings: list[Finding], corpus: CorpusStatistics) -> Forest:
    x = np.concatenate([features(f.text, [(f.start, f.end)], f.path, corpus) for f in findings])
    return fit_forest(x, np.array([f.secret for f in findings], float))


def scan_secrets(docs: DataFrame, path: str | None = "source", findings: list[Finding] | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, secrets (start, end, score) for every row of ``docs`` (doc_id, text and the column ``path``).

    A candidate is a run of at least 12 of letters, digits and ``+/=_-``, without a leading ``name=``, or a value of 6 to 128 characters that a name like
    ``password`` is given. Those the forest scores ``least`` or more, ties among them, are secrets.
    The forest learns from ``findings``, by default made-up ones; its character transitions and dictionary are counted over all texts of
    ``docs``. Null texts have no candidates, null paths are empty. Repeated rows and null ids are treated like any row; very long texts are
    scanned whole; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), (F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path")
    )
    corpus = CorpusStatistics.of(source)
    shared = docs.sparkSession.sparkContext.broadcast((learn_secrets(findings or labelled_findings(), corpus), corpus))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, statistics = shared.value
        for batch in slices(batches, "text"):
            spans, x = [], []
            for text, where in zip(batch.column("text"), batch.column("path"), strict=True):
                found = candidates(text.as_py() or "")
                spans.append(found)
                if found:
                    x.append(features(text.as_py(), found, where.as_py(), statistics))
            scores = forest.score(np.concatenate(x)) if x else np.empty(0)
            at, secrets = 0, []
            for found in spans:
                own = scores[at : at + len(found)]
                at += len(found)
                secrets.append([{"start": s, "end": e, "score": float(p)} for (s, e), p in zip(found, own, strict=True) if p >= least])
            columns = [batch.column("doc_id"), pa.array([len(f) for f in spans], pa.int64()), pa.array(secrets, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_candidates", "secrets"])

    return source.mapInArrow(run, "doc_id long, n_candidates long, secrets array<struct<start: long, end: long, score: double>>")
