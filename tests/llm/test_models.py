import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import katz, language_id, pii

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Brute:
    """The same model by dictionaries and recursion."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for words in texts:
            for k in range(1, order + 1):
                padded = ["<s>"] * (k - 1) + words
                self.counts[k].update(tuple(padded[j : j + k]) for j in range(len(words)))
        self.total, self.kinds = sum(self.counts[1].values()), len(self.counts[1])
        self.after = [defaultdict(list) for _ in range(order + 1)]
        self.factors = [None] * (order + 1)
        for k in range(2, order + 1):
            for g in self.counts[k]:
                self.after[k][g[:-1]].append(g[-1])
            seen = Counter(self.counts[k].values())
            self.factors[k] = katz.discounts([seen[r] for r in range(1, 7)], 5)

    def left(self, k, gram):
        c = self.counts[k][gram]
        return c * self.factors[k][c] if c <= 5 else c

    def p(self, k, history, w):
        if k == 1:
            return (self.counts[1][(w,)] + 0.1) / (self.total + 0.1 * (self.kinds + 1))
        total = sum(self.counts[k][(*history, x)] for x in self.after[k][history])
        if not total:
            return self.p(k - 1, history[1:], w)
        total += total > 5  # one more event, for tokens that are new after a frequent history
        if self.counts[k][(*history, w)]:
            return self.left(k, (*history, w)) / total
        seen = self.after[k][history]
        alpha = (1 - sum(self.left(k, (*history, x)) for x in seen) / total) / (1 - sum(self.p(k - 1, history[1:], x) for x in seen))
        return alpha * self.p(k - 1, history[1:], w)

    def score(self, words):
        padded = ["<s>"] * (self.order - 1) + words
        return sum(math.log10(self.p(self.order, tuple(padded[j : j + self.order - 1]), w)) for j, w in enumerate(words))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_matches_brute_force(docs, fixture_docs, order):
    rows = [r for r in fixture_docs if r[1] is None or len(r[1]) < 4000]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</s>"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    model = Brute([words(t) for i, t, *_ in rows if not held(i)], order)
    small = docs.where("text IS NULL OR length(text) < 4000")
    found = katz.katz_scores(small, katz.crc32_of_id(F.col("doc_id")) % 10 != 0, order=order).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6), round(r.score, 6)) for r in found)
    want = []
    for i, t, *_ in rows:
        w = words(t)
        base = sum(math.log10(model.p(1, (), x)) for x in w)
        want.append((i is None, i or 0, len(w), sum(model.counts[1][(x,)] > 0 for x in w), held(i), round(base, 6), round(model.score(w), 6)))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-5)
    assert {r.train_tokens for r in found} == {model.total}


def test_katz_histories_add_up(fixture_docs):
    texts = [(t or "").split() + ["</s>"] for _, t, *_ in fixture_docs[:60]]
    model = Brute(texts, 2)
    for history in list(model.after[2])[:20]:
        known = sum(model.p(2, history, w) for (w,) in model.counts[1])
        assert known + model.p(2, history, "never seen") == pytest.approx(1)


def test_katz_of_empty_table(empty):
    assert katz.katz_scores(empty, F.lit(True)).count() == 0


SYLLABLES = {"en": "the ing er on th sh ly", "de": "sch ein ung ü keit cht pf", "fr": "eau oi é ment que è oux"}


def test_language_id_on_held_out_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        lang = list(SYLLABLES)[i % 3]
        parts = SYLLABLES[lang].split()
        rows.append((i, " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(30)), lang))
    rows += [(1000, None, "en"), (1001, "123 !?", "de"), (1002, "", None), (None, "the thing", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.fit_filters(frame, F.col("doc_id") % 2 == 0, bits=16)
    found = {r.doc_id: r for r in language_id.identify_languages(frame, filters).collect()}
    odd = [r for r in rows[:600] if r[0] % 2]
    assert sum(found[i].lang_pred == lang for i, _, lang in odd) >= 0.98 * len(odd)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1000, 1001, 1002))
    assert found[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in found.values())


def test_filters_return_all_languages_of_a_gram(spark):
    frame = spark.createDataFrame([(1, "shared alpha", "a"), (2, "shared beta", "b")], "doc_id long, text string, lang string")
    filters = language_id.fit_filters(frame, bits=16)
    grams, _ = language_id.grams_of(np.frombuffer(b"shared", np.uint8), np.array([0, 6]), (4,))
    assert set(filters.masks(grams)[0].tolist()) == {3}


def plain_grams(text, sizes=(3, 4, 5)):
    """Byte n-grams of lower-cased words with a space on either side, by plain strings."""
    data = text.translate(LOWER).encode()
    squeezed, inside = bytearray(), False
    for b in data:
        word = 97 <= b <= 122 or b >= 128
        if word:
            squeezed.append(b)
        elif inside:
            squeezed.append(32)
        inside = word
    return [bytes(squeezed[i : i + n]) for n in sizes for i in range(len(squeezed) - n + 1)]


@pytest.mark.parametrize("languages", [3, 70])
def test_language_hits_match_plain_sets(spark, languages):
    """With one n-gram set for each language, as plain Python sets, the counts and the decision are the same; 70 languages take two masks."""
    rng = random.Random(2)
    names = [f"l{i:02d}" for i in range(languages)]
    parts = {name: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäéß", k=3)) for _ in range(6)] for name in names}
    prose = lambda name, n: " ".join("".join(rng.choices(parts[name], k=2)) for _ in range(n))
    rows = [(n, prose(name, 25), name) for n, name in enumerate(names * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.fit_filters(frame, F.lit(True), bits=20, hashes=4, min_share=0)
    assert filters.languages == tuple(names) and len(filters.slices) == -(-languages // 64)
    sets = {name: set() for name in names}
    for _, text, name in rows:
        sets[name].update(plain_grams(text))
    asked = [(1000 + n, prose(name, 12) + (" 12, Zz" if n % 2 else ""), name) for n, name in enumerate(names)] + [(2000, "same same", None)] * 2
    found = language_id.identify_languages(spark.createDataFrame(asked, "doc_id long, text string, lang string"), filters).collect()
    for r in found:
        text = next(t for i, t, _ in asked if i == r.doc_id)
        grams = plain_grams(text)
        hits = [sum(g in sets[name] for g in grams) for name in names]
        assert r.n_grams == len(grams)
        assert list(r.hits) == pytest.approx(hits, abs=1.5)
        top = [names[i] for i, h in enumerate(hits) if h >= max(hits) - 3]
        assert r.lang_pred in top
        assert r.score == pytest.approx(max(hits) / max(1, len(grams)), abs=0.1)


def test_equal_hits_go_to_the_language_that_sorts_first(spark):
    rows = [(1, "shared words", "b"), (2, "shared words", "a"), (3, "shared words", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify_languages(frame.select("doc_id", "text"), language_id.fit_filters(frame, bits=16)).collect()
    assert [r.lang_pred for r in found] == ["a"] * 3


def test_language_id_without_labels(spark, empty):
    filters = language_id.fit_filters(empty, bits=10)
    assert filters.languages == ()
    frame = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language_id.identify_languages(frame, filters).collect()] == [("und", 0.0)]
    assert language_id.identify_languages(empty, filters).count() == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= sum(map(str.isdigit, s)) <= 19 and pii.luhn("".join(filter(str.isdigit, s)))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(map(str.isdigit, s)) <= 15),
)


def test_base_spans_match_the_plain_expressions():
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "@", ".", "1", "25", "4111 1111 1111 1111", "+1 (555) 010-2020", "10.0.0.1", "-", " ", "_", "%", "300.1.1.1", "x@y.zz", "+", "(", "12345678901234567890", "é"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        want = sorted((m.start(), m.end(), kind) for kind, pattern, good in BASE for m in re.finditer(pattern, text) if good(m[0]))
        assert sorted((a, b, k) for a, b, k, base in pii.candidates(text) if base) == want, text


def test_personal_data_spans(spark):
    rows = [(i, f"contact mail{i}: user{i}@mail.example.com phone +1 (555) 010-{2000 + i}", None) for i in range(40)]
    rows += [(100 + i, f"call me, phone 555-010-{3000 + i} please", None) for i in range(20)]
    rows += [(200, None, None), (201, "", None), (None, "clean text of no interest", None), (202, "ascii " * 20000, None)]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert [s.kind for s in found[3]] == ["email", "phone"] and all(s.base for s in found[3])
    assert not found[200] and not found[201] and not found[None] and not found[202]
    assert all(not s.base and s.probability >= 0.5 for i in range(100, 120) for s in found[i])


def test_number_before_phone_or_national_id_does_not_hide_it(spark):
    rows = [(i, f"contact mail{i}: user{i}@mail.example.com phone +1 (555) 010-{2000 + i}") for i in range(40)]
    rows += [(100 + i, f"call me, phone 555-010-{3000 + i} please") for i in range(20)]
    rows += [(150 + i, f"mail: user{i}@mail.example.com, social number: 123-45-{6000 + i}, phone +1 (555) 010-{4000 + i}") for i in range(20)]
    rows += [(300 + i, f"order serial {9000123412340 + 37 * i}_x") for i in range(80) if not pii.luhn(str(9000123412340 + 37 * i))]
    texts = {200: ("phone Since 2019 555-123-4567 ok", "local_phone", "555-123-4567"), 201: ("social in 2023 123-45-6789 ok", "national_id", "123-45-6789")}
    rows += [(i, t) for i, (t, *_) in texts.items()]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (t, kind, part) in texts.items():
        assert [(s.kind, t[s.start : s.end]) for s in found[i]] == [(kind, part)]


def test_most_probable_of_overlapping_spans_stays():
    span = lambda a, b, code, base=False: {"start": a, "rank": code, "kind": str(code), "end": b, "base": base, "pattern": code}
    sure = {1: 0.6, 2: 0.9, 3: 0.4, 4: 0.1}
    spans = [span(0, 9, 1), span(5, 12, 2), span(10, 20, 1), span(12, 15, 1), span(30, 35, 3), span(40, 45, 4, True)]
    assert [(s["start"], p) for s, p in pii.decided(spans, [sure[s["pattern"]] for s in spans], 0.5)] == [(5, 0.9), (12, 0.6), (40, 0.1)]


def test_expectation_maximisation_finds_the_unreliable_labeler():
    rng = np.random.default_rng(0)
    counts = Counter()
    for _ in range(5000):
        true = rng.random() < 0.5
        vote = lambda right: 1 if (rng.random() < right) == true else -1
        counts[pii.encode("person", [vote(0.9), vote(0.85), vote(0.9), 0, 0, vote(0.5), 0, 0])] += 1
    learned = pii.supervise(counts)
    assert learned.reliability[0, 1, 2] == pytest.approx(0.9, abs=0.05)
    assert learned.reliability[5, 1, 2] == pytest.approx(0.5, abs=0.05)
    assert learned.posterior[pii.encode("person", [1, 1, 1, 0, 0, -1, 0, 0])] > 0.9
    assert learned.posterior[pii.encode("person", [-1, -1, -1, 0, 0, 1, 0, 0])] < 0.1


def test_expectation_maximisation_matches_one_over_single_spans():
    """The same steps written out span by span, without counts of patterns or arrays."""
    rng = random.Random(1)
    spans = []
    for _ in range(300):
        kind = rng.choice(["email", "person", "card_like"])
        true = rng.random() < {"email": 0.9, "person": 0.5, "card_like": 0.1}[kind]
        spans.append((kind, tuple(rng.choice([0, 1 if (rng.random() < 0.8) == true else -1]) for _ in pii.LABELERS)))
    learned = pii.supervise(Counter(pii.encode(*s) for s in spans), rounds=12)

    q = [1 / (1 + math.exp(-(sum(cast) + (kind == "email")))) for kind, cast in spans]
    for _ in range(12):
        table = {}
        for j in range(len(pii.LABELERS)):
            for y in (0, 1):
                seen = {v: 1 + sum((p if y else 1 - p) for p, (_, cast) in zip(q, spans, strict=True) if cast[j] == v) for v in (-1, 0, 1)}
                table[j, y] = {v: n / sum(seen.values()) for v, n in seen.items()}
        prior = {}
        for k in pii.KINDS:
            own = [p for p, (kind, _) in zip(q, spans, strict=True) if kind == k]
            prior[k] = (sum(own) + 1) / (len(own) + 2)
        new = []
        for kind, cast in spans:
            yes, no = prior[kind], 1 - prior[kind]
            for j, v in enumerate(cast):
                yes, no = yes * table[j, 1][v], no * table[j, 0][v]
            new.append(yes / (yes + no))
        q = new
    for (kind, cast), p in zip(spans, q, strict=True):
        assert learned.posterior[pii.encode(kind, cast)] == pytest.approx(p, abs=1e-9)


def test_classifier_learns_from_shape_and_context():
    """Spans of one kind without votes, told apart by the word before them alone."""
    none = [0] * len(pii.LABELERS)
    spans, target = [], []
    for i in range(200):
        text = f"{'ring' if i % 2 else 'lot'} 555-010-{2000 + i} now"
        at = text.index("555")
        spans.append(pii.features(text, at, at + 12, "local_phone", none))
        target.append(0.95 if i % 2 else 0.05)
    w = pii.fit_classifier(spans, np.array(target), np.ones(len(spans)))
    sure = [1 / (1 + math.exp(-w[f].sum())) for f in spans]
    assert all((p > 0.8) == (i % 2 == 1) for i, p in enumerate(sure))


def labelled_spans(rng, n):
    """Texts with spans beyond the base kinds in many contexts, and look-alikes that aren't personal: (text, wanted spans)."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    filler = lambda: " ".join(rng.choice("the report was sent on time and all of it is fine so far".split()) for _ in range(rng.randrange(3, 12)))

    def account():
        body = "DE00" + "".join(digits(4) for _ in range(4)) + digits(2)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        plain = f"DE{check:02d}{body[4:]}"
        return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))

    good = {
        "local_phone": lambda: (rng.choice(["call me at ", "phone: ", "my mobile is ", "tel. "]), f"{rng.randrange(200, 999)}-{digits(3)}-{digits(4)}"),
        "national_id": lambda: (rng.choice(["ssn ", "social number: ", "my social security number is "]), f"{rng.randrange(100, 660)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        "bank_account": lambda: (rng.choice(["iban ", "account: ", "pay to my account "]), account()),
        "masked_email": lambda: (rng.choice(["mail ", "contact: ", "e-mail "]), f"user{digits(2)} [at] example{digits(1)} [dot] {rng.choice(['com', 'org', 'de'])}"),
        "person": lambda: (rng.choice(["contact ", "dear ", "name: "]), f"{rng.choice(['Mr', 'Mrs', 'Dr'])} {rng.choice(['John', 'Maria', 'Peter', 'Susan'])} {rng.choice(['Miller', 'Lopez', 'Brown'])}"),
    }
    bad = [
        lambda: ("serial ", f"{rng.randrange(200, 999)}-{digits(3)}-{digits(4)}_a"),
        lambda: ("invoice part no ", f"{digits(4)} {digits(4)} {digits(4)}1"),
        lambda: ("build ", f"9{digits(2)}-00-{digits(4)}"),
        lambda: ("version ", "AB12 " + " ".join("".join(rng.choice("ABCDEFGH0123456789") for _ in range(4)) for _ in range(4))),
        lambda: ("order sku ", f"{rng.choice('12')}{digits(13)}_x"),
    ]
    out = []
    for i in range(n):
        if i % 2:
            kind = list(good)[i // 2 % len(good)]
            cue, span = good[kind]()
        else:
            kind = None
            cue, span = rng.choice(bad)()
            while kind is None and "sku" in cue and pii.luhn(span[:14]):
                cue, span = bad[4]()
        head = filler() + " " + cue
        out.append((head + span + " " + filler(), [(len(head), len(head) + len(span), kind)] if kind else []))
    return out


def test_added_spans_on_a_labelled_fixture(spark):
    rng = random.Random(12)
    fixture = labelled_spans(rng, 800)
    base = [(10_000 + i, f"mail: user{i}@mail.example.com phone +1 (555) 010-{2000 + i} from 10.0.0.{i % 250}") for i in range(100)]
    rows = [(i, text) for i, (text, _) in enumerate(fixture)] + base
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans if not s.base] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = {(i, *s) for i, (_, spans) in enumerate(fixture) for s in spans}
    got = {(i, *s) for i, spans in found.items() for s in spans}
    assert len(wanted & got) >= 0.9 * len(wanted)
    assert len(wanted & got) >= 0.9 * len(got)


def test_personal_data_of_empty_table(empty):
    assert pii.find_personal_data(empty).count() == 0
