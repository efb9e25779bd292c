"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the votes.

Candidates are the matches of the base patterns, checked or failed, and of looser ones (numbers without a country code,
addresses written out in words). A pattern, a gazetteer, a context and a boundary labeler vote on each. How often each
combination of votes occurs is counted over all documents; expectation-maximisation on these counts estimates every labeler's
reliability, and a logistic span classifier is fitted to its posteriors. Checked base matches are always spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.shared import PIECE_BYTES, binary_texts, frugal, shipped, slices, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = 4
# Fixed value: the base patterns' parts. A match starts at the start of its run of digits, so the look-behinds drop nothing.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])")
LOOSE_EMAIL = re.compile(
    r"(?<![\w.])[\w.+-]{2,64}\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{2,63}\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z]{2,10}(?!\w)", re.IGNORECASE
)
HINTS = {
    "email": ("mail", "contact", "write to", "reach", "address", "@"),
    "ip": ("ip", "host", "server", "address", "login from", "client"),
    "card": ("card", "visa", "master", "amex", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "dial", "number", "telefon", "llam"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "chapter", "section", "release", "build", "sku")
DOMAINS = frozenset("com org net edu gov info io de fr es uk it nl ch at eu us ca au jp cn br in example test".split())
# Share of true spans and votes assumed before any text is seen, as counts: (labeler's vote -1, 0, 1) for false and for true spans.
PRIOR = np.array([[4.0, 4.0, 2.0], [1.0, 4.0, 5.0]])


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        at = text.find("@", max(free, at + 1))


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it is a checked base match) of all candidates; loose ones lie outside every base match."""
    found = [("email", start, end, True) for start, end in _emails(text)]
    if re.search("[0-9]", text):
        found += [("ip", m.start(), m.end(), all(map(_small, m[0].split(".")))) for m in IP.finditer(text)]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19:
                found.append(("card", m.start(), m.end(), _luhn(digits)))
        if "+" in text:
            found += [("phone", m.start(), m.end(), 10 <= sum(map(str.isdigit, m[0])) <= 15) for m in PHONE.finditer(text)]
        loose = [("phone", m.start(), m.end()) for m in LOOSE_PHONE.finditer(text)]
    else:
        loose = []
    lower = text.lower()
    if any(dot in lower for dot in ("(dot)", "[dot]", " dot ")):
        loose += [("email", m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text)]
    if loose:
        taken = sorted((start, end) for _, start, end, _ in found)
        starts, ends = [t[0] for t in taken], np.maximum.accumulate([t[1] for t in taken] or [0])
        for kind, start, end in loose:
            before = np.searchsorted(starts, end)
            if not before or ends[before - 1] <= start:
                found.append((kind, start, end, False))
    return found


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """Votes (1 for, -1 against, 0 none) of the pattern, gazetteer, context and boundary labelers."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    failed = not base and (kind in ("ip", "card") or kind == "phone" and span[0] == "+")
    if kind == "email":
        known = 1 if re.split(r"\W+", span.lower().rstrip())[-1] in DOMAINS else -1
    elif kind == "ip":
        first = int(span.split(".")[0].lstrip("0")[:4] or 0)
        known = 1 if 1 <= first <= 223 and len(digits) >= 5 else -1
    elif kind == "card":
        known = 1 if len(digits) in (15, 16) and (digits[0] in "45" or digits[:2] in ("34", "37", "60", "65") or "22" <= digits[:2] <= "27") else -1
    else:
        known = -1 if len(set(digits)) < 3 else 1 if 10 <= len(digits) <= 13 else 0
    around = text[max(0, start - 40) : start].lower()
    context = 1 if any(hint in around for hint in HINTS[kind]) else -1 if any(hint in around for hint in AGAINST) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edge = 1 if not (left.isalnum() or right.isalnum()) else -1
    return (1 if base else -1 if failed else 0), known, context, edge


SPANS = "spans array<struct<kind:string,start:int,end:int,base:boolean,votes:int>>"


def _code(vote: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(vote))


def _uncoded(code: int) -> list[int]:
    return [code // 3**k % 3 - 1 for k in range(LABELERS)]


def _candidates(text: str) -> list[dict]:
    return [{"kind": kind, "start": start, "end": end, "base": base, "votes": _code(votes(text, kind, start, end, base))} for kind, start, end, base in matches(text)]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the candidate spans of every whole text in code points, with their votes as one number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32())]))
        for batch in slices(batches, "text", PIECE_BYTES):
            spans = [_candidates(value.decode("utf-8", "replace")) for value in binary_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, shape)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, {SPANS}")


@dataclass
class SpanClassifier:
    """For each kind the labelers' reliabilities, and a probability for every combination of votes."""

    reliability: dict[str, np.ndarray] = field(default_factory=dict)  # [false or true, labeler, vote + 1]
    accepted: dict[tuple[str, int], float] = field(default_factory=dict)

    def keeps(self, span: dict) -> bool:
        return span["base"] or self.accepted.get((span["kind"], span["votes"]), 0.0) >= 0.5


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(reliability [2, labeler, vote + 1], posterior of each pattern) for a hidden true or false behind independent votes."""
    rates = np.repeat((PRIOR / PRIOR.sum(axis=1, keepdims=True))[:, None, :], LABELERS, axis=1)
    share = np.array([0.5, 0.5])
    for _ in range(rounds):
        joint = np.log(share) + np.array([[sum(np.log(rates[y, k, p[k] + 1]) for k in range(LABELERS)) for y in (0, 1)] for p in patterns])
        posterior = np.exp(joint - joint.max(axis=1, keepdims=True))
        posterior = posterior[:, 1] / posterior.sum(axis=1)
        weights = np.stack([counts * (1 - posterior), counts * posterior])
        share = (weights.sum(axis=1) + 5) / (counts.sum() + 10)
        for y, k, v in product((0, 1), range(LABELERS), (-1, 0, 1)):
            rates[y, k, v + 1] = (weights[y][patterns[:, k] == v].sum() + PRIOR[y, v + 1]) / (weights[y].sum() + PRIOR[y].sum())
    return rates, posterior


def classifier(patterns: np.ndarray, posterior: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression on the votes (one input per labeler for and against), fitted to the posteriors."""
    x = np.concatenate([np.ones((len(patterns), 1)), patterns == 1, patterns == -1], axis=1).astype(float)
    weights, share = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(rounds):  # damped Newton steps with a small ridge
        p = 1 / (1 + np.exp(-x @ weights))
        slope = x.T @ (share * (p - posterior)) + 1e-3 * weights
        weights -= np.linalg.solve((x.T * (share * p * (1 - p))) @ x + 1e-2 * np.eye(len(weights)), slope)
    return weights


def train(found: DataFrame) -> SpanClassifier:
    """Learns from the candidates of all documents, through the counts of their vote combinations (at most 81 per kind)."""
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()
    model = SpanClassifier()
    for kind in KINDS:
        rows = sorted((row["votes"], row["n"]) for row in counted if row["kind"] == kind)
        if rows:
            patterns, counts = np.array([_uncoded(code) for code, _ in rows]), np.array([n for _, n in rows], float)
            model.reliability[kind], posterior = expectation_maximisation(patterns, counts)
            weights = classifier(patterns, posterior, counts)
            scores = np.concatenate([np.ones((len(rows), 1)), patterns == 1, patterns == -1], axis=1) @ weights
            model.accepted |= {(kind, code): float(1 / (1 + np.exp(-s))) for (code, _), s in zip(rows, scores)}
    return model


def listed(spans: Iterable[dict]) -> str:
    """``kind:start:end`` by start, then kind in the order of KINDS, joined by commas."""
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"])))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    The counts and the hash are over checked base matches; ``spans`` also lists what the classifier adds. A null text is an empty
    one, without spans. Null and repeated ids are carried along; other columns are not read. Texts are scanned whole, in
    time linear in their length.
    """
    found = written(candidates(docs), "pii-candidates")
    load = shipped(docs.sparkSession, train(found))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
        for batch in batches:
            rows = []
            for spans in batch.column("spans").to_pylist():
                base = [s for s in spans if s["base"]]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((*(sum(s["kind"] == kind for s in base) for kind in KINDS), digest, listed(filter(model.keeps, spans))))
            columns = [pa.array(column) for column in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return found.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, such as ``[email]``; overlapping spans by one.

    All columns of ``docs`` stay as they are but ``text``; a null text stays null.
    """
    load = shipped(docs.sparkSession, train(written(candidates(docs), "pii-candidates")))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in slices(batches, "text", PIECE_BYTES):
            texts = []
            for value in batch.column(at).to_pylist():
                spans = [] if value is None else sorted((s["start"], -s["end"], s["kind"]) for s in _candidates(value) if model.keeps(s))
                parts, done = [], 0
                for start, end, kind in spans:
                    if start >= done:
                        parts += [value[done:start], f"[{kind}]"]
                    done = max(done, -end)
                texts.append(value if not spans else "".join([*parts, value[done:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], batch.schema.names)

    return docs.mapInArrow(frugal(run), docs.schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and empty tables: see :func:`personal_data`."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
