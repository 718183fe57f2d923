"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, and a classifier of spans that is trained on the result decides."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.columns import pick
from sparkweave.llm.storage import small_batches, written
from sparkweave.llm.textblocks import chunks, trim_memory

#: Kinds of spans. The first four are the base kinds; their valid matches are always reported.
KINDS = ("email", "ip", "card", "phone", "national_id", "local_phone", "bank_account", "masked_email", "person", "card_like")
BASE_KINDS = 4

LABELERS = ("format", "checksum", "gazetteer", "cue_before", "contrary_cue", "isolated", "varied", "near_another")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MORE = (
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("local_phone", re.compile(r"(?<![0-9+.)-])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")),
    ("bank_account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
_MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
_PERSON = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?\b")

# Gazetteers and cue words, as public lists give them. A domain also counts as known if its last label has two letters, as those of countries have.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx app dev page blog shop online site store tech cloud email".split())
FIRST_NAMES = frozenset(
    """james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george
    edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory frank alexander raymond patrick jack dennis
    mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily donna michelle dorothy carol amanda melissa deborah
    stephanie rebecca sharon laura cynthia kathleen amy angela shirley anna brenda pamela emma nicole helen samantha katherine christine debra rachel carolyn janet catherine maria heather
    hans peter klaus jürgen wolfgang stefan andreas thomas uwe ursula monika petra sabine renate helga karin brigitte ingrid pierre jean michel philippe alain nicolas marie nathalie
    isabelle sylvie françoise monique jacques jose antonio manuel francisco juan carlos luis miguel javier carmen josefa isabel dolores pilar teresa ana lucia sofia""".split()
)
CUES = re.compile(r"e-?mail|mail|phone|tel|call|fax|mobile|contact|card|visa|credit|account|iban|ssn|social|address|ip|host|name|dear|telefon|adresse|correo|tarjeta|carte", re.IGNORECASE)
CONTRARY = re.compile(r"version|ver\.|release|isbn|order|sku|serial|build|hash|commit|invoice|part no|figure|section", re.IGNORECASE)

_SPANS = "doc_id long, spans array<struct<start:int,rank:int,kind:string,end:int,base:boolean,probability:double>>"
_VOTED = _SPANS.replace("probability:double", "pattern:int,features:array<smallint>")

_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _mod97(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base expression, found from each @: the run before it back to the last match, then the domain. Linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, whether a base rule reports it) of all spans that labelers vote on; they may overlap."""
    found = [(a, b, "email", True) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(int(x) <= 255 for x in m[0].split(".") if len(x) < 1000) and all(len(x) < 1000 for x in m[0].split(".")):
                found.append((m.start(), m.end(), "ip", True))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                good = luhn(digits)
                found.append((m.start(), m.end(), "card" if good else "card_like", good))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone", True))
        for kind, pattern in _MORE:
            found += [(m.start(), m.end(), kind, False) for m in pattern.finditer(text)]
    if re.search(r"[\[(]at[\])]", text, re.IGNORECASE):
        found += [(m.start(), m.end(), "masked_email", False) for m in _MASKED.finditer(text)]
    found += [(m.start(), m.end(), "person", False) for m in _PERSON.finditer(text)]
    return sorted(found)


def votes(text: str, start: int, end: int, kind: str, near: bool) -> list[int]:
    """One vote per labeler: 1 for personal data, -1 against, 0 for none."""
    span = text[start:end]
    digits = [c for c in span if c.isdigit()]
    before = text[max(0, start - 48) : start].rpartition("\n")[2]
    glued = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_-.")) or (end < len(text) and (text[end].isalnum() or text[end] == "_"))
    checksum = gazetteer = 0
    if kind in ("card", "card_like"):
        checksum = 1 if kind == "card" else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == "bank_account":
        checksum = 1 if _mod97(span) else -1
    elif kind == "national_id":
        checksum = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" else 1
    elif kind == "ip":
        checksum = -1 if any(len(x) > 1 and x[0] == "0" for x in span.split(".")) else 1
    if kind in ("email", "masked_email"):
        label = re.split(r"[^A-Za-z]+", span.rstrip(")]"))[-1].lower()
        gazetteer = 1 if label in TOP_DOMAINS or len(label) == 2 else -1
    elif kind == "person":
        gazetteer = 1 if span.split(" ")[1].lower() in FIRST_NAMES else 0
    form = {"email": not span.startswith(".") and ".." not in span, "phone": span.count("(") == span.count(")"), "ip": True, "local_phone": span[0] == "(" or len(digits) == 10}.get(kind)
    return [
        0 if form is None else 1 if form else -1,
        checksum,
        gazetteer,
        1 if CUES.search(before) else 0,
        -1 if CONTRARY.search(before) else 0,
        -1 if glued else 1,
        -1 if len(digits) >= 7 and len(set(digits)) <= 2 else 0,
        1 if near else 0,
    ]


def encode(kind: str, cast: Sequence[int]) -> int:
    """Kind and votes as one number, so the votes of a whole corpus are a table of few rows."""
    code = KINDS.index(kind)
    for v in cast:
        code = code * 3 + v + 1
    return code


def decode(code: int) -> tuple[str, list[int]]:
    cast = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        cast.append(v - 1)
    return KINDS[code], cast[::-1]


#: Characters whose presence is a feature of a span's shape, and the numbers of hash buckets for the two words before a span and the one after.
_MARKS = "-. ()+@_%"
_BEFORE, _AFTER = 64, 32
_LENGTHS, _SHARES = (8, 12, 16, 24), (0.25, 0.5, 0.75, 0.999)

#: Where each group of features begins: the constant, kinds, votes, lengths, shares of digits and of capitals, marks, the characters beside the span, words before and after.
_GROUPS = dict(zip(("one", "kind", "vote", "length", "digits", "capitals", "mark", "left", "right", "before", "after", "end"), np.cumsum([0, 1, len(KINDS), 2 * len(LABELERS), len(_LENGTHS) + 1, len(_SHARES) + 1, len(_SHARES) + 1, len(_MARKS), 6, 6, _BEFORE, _AFTER]).tolist(), strict=True))
FEATURES = _GROUPS["end"]


def _class_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".,;:!?" else 5


def features(text: str, start: int, end: int, kind: str, cast: Sequence[int]) -> list[int]:
    """The features that a span has, by number: its kind, votes, shape, and the characters and words around it."""
    span, size, g = text[start:end], end - start, _GROUPS
    out = [g["one"], g["kind"] + KINDS.index(kind)]
    out += [g["vote"] + 2 * j + (v > 0) for j, v in enumerate(cast) if v]
    out.append(g["length"] + sum(size > x for x in _LENGTHS))
    out.append(g["digits"] + sum(sum(map(str.isdigit, span)) / size > x for x in _SHARES))
    out.append(g["capitals"] + sum(sum(map(str.isupper, span)) / size > x for x in _SHARES))
    out += [g["mark"] + i for i, c in enumerate(_MARKS) if c in span]
    out += [g["left"] + _class_of(text[start - 1 : start]), g["right"] + _class_of(text[end : end + 1])]
    for words, base, buckets in ((_WORDS.findall(text, max(0, start - 40), start)[-2:], g["before"], _BEFORE), (_WORDS.findall(text, end, end + 24)[:1], g["after"], _AFTER)):
        out += [base + zlib.crc32(w.lower().encode()) % buckets for w in words]
    return sorted(set(out))


@dataclass(frozen=True)
class Supervision:
    """What expectation-maximisation learned: of each labeler the probability of votes -1, 0, 1 given not personal and personal; of each kind the prior; and each pattern's posterior."""

    reliability: np.ndarray
    prior: dict[str, float]
    posterior: dict[int, float]


def supervise(counts: dict[int, int], rounds: int = 50) -> Supervision:
    """Expectation-maximisation over the counts of vote patterns.

    It begins with the majority of the votes; base kinds, whose format is strict, have a vote more. One vote of each value is added to each labeler's counts, so
    that no reliability is 0 or 1.
    """
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    kinds = np.array([KINDS.index(decode(c)[0]) for c in codes], int)
    cast = np.array([decode(c)[1] for c in codes], int).reshape(len(codes), len(LABELERS))
    q = 1 / (1 + np.exp(-(cast.sum(1) + (kinds < BASE_KINDS))))
    reliability = np.full((len(LABELERS), 2, 3), 1 / 3)
    prior = np.full(len(KINDS), 0.5)
    for _ in range(rounds if codes else 0):
        for j in range(len(LABELERS)):
            for y, weight in enumerate((n * (1 - q), n * q)):
                seen = np.bincount(cast[:, j] + 1, weight, 3) + 1
                reliability[j, y] = seen / seen.sum()
        for k in range(len(KINDS)):
            own = kinds == k
            prior[k] = ((n * q)[own].sum() + 1) / (n[own].sum() + 2)
        odds = np.log(prior[kinds] / (1 - prior[kinds]))
        for j in range(len(LABELERS)):
            odds += np.log(reliability[j, 1] / reliability[j, 0])[cast[:, j] + 1]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-9:
            break
    return Supervision(reliability, dict(zip(KINDS, prior.tolist(), strict=True)), dict(zip(codes, q.tolist(), strict=True)))


def fit_classifier(spans: Sequence[Sequence[int]], target: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """A logistic classifier of spans, given by the numbers of their features, with targets between 0 and 1, by Newton's method with a ridge penalty."""
    w = np.zeros(FEATURES)
    if not len(spans):
        return w
    x = np.zeros((len(spans), FEATURES), np.float32)
    for i, f in enumerate(spans):
        x[i, f] = 1
    share = weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (target - p)) - ridge * w
        curve = (x * (share * p * (1 - p)).astype(np.float32)[:, None]).T @ x + ridge * np.eye(FEATURES)
        step = np.linalg.solve(curve.astype(float), gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def decided(spans: Sequence[dict], sure: Sequence[float], threshold: float) -> list[tuple[dict, float]]:
    """The spans that stay and their probabilities, by start and kind: base spans, and of the others over the threshold the most probable ones that don't overlap."""
    scored = list(zip(spans, sure, strict=True))
    likely = sorted((x for x in scored if not x[0]["base"] and x[1] >= threshold), key=lambda x: (-x[1], x[0]["start"] - x[0]["end"], x[0]["start"], x[0]["rank"]))
    starts: list[int] = []
    ends: list[int] = []
    stay = [x for x in scored if x[0]["base"]]
    for x in likely:
        a, b = x[0]["start"], x[0]["end"]
        at = bisect.bisect(starts, a)
        if (at and ends[at - 1] > a) or (at < len(starts) and starts[at] < b):
            continue
        starts.insert(at, a)
        ends.insert(at, b)
        stay.append(x)
    return sorted(stay, key=lambda x: (x[0]["start"], x[0]["rank"], x[0]["end"]))


def find_personal_data(docs: DataFrame, threshold: float = 0.5, spans_per_kind: int = 4000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``spans``, an array of (start, rank, kind, end, base, probability) in code points, by start and kind.

    Method. Expressions for formats, gazetteers and context words are labelers that vote on candidate spans of the whole text. The votes of all documents
    are counted by pattern, of which there are at most len(KINDS) * 3**len(LABELERS), whatever the size of the corpus; from these
    counts expectation-maximisation estimates how reliable each labeler is and how probable each pattern. A logistic classifier is then fitted to these
    probabilities on a sample of at most ``spans_per_kind`` spans of each kind, the first ones by a hash; it sees a span's shape and
    the characters and words around it besides the votes, and gives every span its final probability.
    Spans that the base rules report stay; others are added if the classifier gives them at least ``threshold`` and they overlap no base span. All
    of these vote; where some that reach the threshold overlap each other, the most probable one stays, at equal probability the longest, then the first.

    Defined cases: a null text counts as empty and has no spans; a null doc_id and repeated rows are rows of their own; without candidates nothing
    is learned or reported. Whole texts are searched. An empty table gives an empty result. Further columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32()), ("features", pa.list_(pa.int16()))]
        for batch in batches:
            for part in chunks(batch):
                out = []
                for text in part.column("text").to_pylist():
                    found = candidates(text) if text else []
                    taken = []
                    base = [(a, b) for a, b, _, is_base in found if is_base]  # where base spans begin and end, to drop others that overlap them
                    starts, ends = np.array([a for a, _ in base]), np.maximum.accumulate([b for _, b in base]) if base else np.array([])
                    for i, (a, b, k, is_base) in enumerate(found):
                        if not is_base:
                            before = int(np.searchsorted(starts, b)) - 1
                            if before >= 0 and ends[before] > a:
                                continue
                        near = (i > 0 and a - found[i - 1][1] <= 80) or (i + 1 < len(found) and found[i + 1][0] - b <= 80)
                        cast = votes(text, a, b, k, near)
                        taken.append({"start": a, "rank": KINDS.index(k), "kind": k, "end": b, "base": is_base, "pattern": encode(k, cast), "features": features(text, a, b, k, cast)})
                    out.append(taken)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(out, pa.list_(pa.struct(fields)))], names=["doc_id", "spans"])
                del out
            trim_memory()

    voted = written(pick(docs, "doc_id", "text").mapInArrow(run, _VOTED), "span-votes")
    every = voted.select("doc_id", F.explode("spans").alias("s"))
    counts = {r["pattern"]: r["count"] for r in every.groupBy(F.col("s.pattern").alias("pattern")).count().collect()}
    learned = supervise(counts)
    weights = _fitted(every, counts, learned, spans_per_kind)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_()), ("probability", pa.float64())]))
        for batch in batches:
            out = []
            for spans in batch.column("spans").to_pylist():
                sure = [float(1 / (1 + np.exp(-np.clip(weights[s["features"]].sum(), -30, 30)))) for s in spans]
                out.append([{**{x: s[x] for x in ("start", "rank", "kind", "end", "base")}, "probability": p} for s, p in decided(spans, sure, threshold)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return voted.mapInArrow(decide, _SPANS)


def _fitted(every: DataFrame, counts: dict[int, int], learned: Supervision, spans_per_kind: int) -> np.ndarray:
    """The classifier's weights, from a bounded sample of the spans ``s`` of each kind that stands for all of them."""
    of_kind: dict[str, int] = {}
    for pattern, n in counts.items():
        kind = decode(pattern)[0]
        of_kind[kind] = of_kind.get(kind, 0) + n
    limits = [x for kind, n in sorted(of_kind.items()) for x in (F.lit(kind), F.lit(min(1.0, (1.3 * spans_per_kind + 200) / n) * (1 << 30)))]
    if not limits:
        return np.zeros(FEATURES)
    key = F.xxhash64("doc_id", "s.start", "s.end", "s.kind")
    # A hash under a kind's threshold pre-selects spans where they are read; the window then takes the exact number.
    keyed = every.select("s.kind", "s.pattern", "s.features", key.alias("key")).where(F.pmod("key", F.lit(1 << 30)) < F.element_at(F.create_map(*limits), F.col("kind")))
    first = Window.partitionBy("kind").orderBy(F.pmod("key", F.lit(1 << 30)), "pattern")
    sample = keyed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= spans_per_kind).select("kind", "pattern", "features").orderBy("kind", "pattern", "features").toArrow()
    kinds = sample.column("kind").to_pylist()
    sampled = {kind: kinds.count(kind) for kind in set(kinds)}
    weight = np.array([of_kind[k] / sampled[k] for k in kinds])
    target = np.array([learned.posterior[c] for c in sample.column("pattern").to_pylist()])
    return fit_classifier(sample.column("features").to_pylist(), target, weight)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
